"""Writing a corpus: as a table that replaces whole slugs, or as one file a manual."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import upserted


def stage(spark: SparkSession, folder: str, new: DataFrame, key: str = "slug") -> str:
    """Put the rows of new into the corpus at folder in place of those with the same key; gives the new version's folder.

    Every version is a folder of its own; which one holds is said by the file CURRENT, replaced by a rename after the
    version is complete.  So a reader sees the old corpus or the new one.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    old = current(spark, folder)
    out = f"{folder}/v-{datetime.now(timezone.utc).strftime('%Y%m%dT%H%M%S%f')}"
    (upserted(old, new, key) if old is not None else new).write.parquet(out)
    temp = path(f"{folder}/_CURRENT.new")
    stream = fs.create(temp, True)
    stream.write(bytearray(out.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(folder).toUri(), conf)
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context.rename(context.makeQualified(temp), context.makeQualified(path(f"{folder}/CURRENT")), options)
    return out


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The corpus at folder; None if there is none yet."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")
    if not at.getFileSystem(conf).exists(at):
        return None
    name = spark.read.text(f"{folder}/CURRENT", wholetext=True).first()[0]
    return spark.read.parquet(name)


def raw_pages(pages: DataFrame) -> DataFrame:
    """(slug, file, text): raw pages as a file tree holds them: numbered names, and the source in a comment first."""
    name = F.format_string("%04d-%s.%s", "ord", "stem", "ext")
    return pages.select("slug", F.concat("slug", F.lit("/raw/"), name).alias("file"), F.concat(F.lit("<!-- source: "), "source_url", F.lit(" -->\n"), "body").alias("text"))


def file_tree(files: DataFrame, folder: str) -> DataFrame:
    """Write (file, text) rows as files below a folder that all executors share; gives (file, bytes) of what was written."""

    def write(batches):
        import os

        import pandas as pd

        for pdf in batches:
            done = []
            for name, text in zip(pdf["file"], pdf["text"]):
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"unsafe name {name!r}")
                data = text.encode()
                target = os.path.join(folder, name)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.tmp", "wb") as f:
                    f.write(data)
                os.replace(f"{target}.tmp", target)
                done.append((name, len(data)))
            yield pd.DataFrame(done, columns=["file", "bytes"])

    return files.select("file", "text").mapInPandas(write, "file string, bytes long")
