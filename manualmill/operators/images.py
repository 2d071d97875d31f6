"""Image references of deliverables: reuse, supersede, download, prune; the records of local copies."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, urls


def references(docs: DataFrame) -> DataFrame:
    """(slug, pos, url, decoded): the remote images of each deliverable in reading order, each once."""
    rows = docs.select("slug", F.posexplode(markup.remote_images("content")).alias("pos", "url"))
    return rows.withColumn("decoded", markup.unescape_basic(F.col("url")))


def classified(refs: DataFrame, sidecar: DataFrame, probes: DataFrame) -> DataFrame:
    """(slug, url, decoded, local, action): reuse if the record's file is unchanged, supersede if it changed, else download.

    sidecar is (slug, source_url, local, on_disk), probes (url, not_modified).  Without a record nothing is probed.
    """
    s = sidecar.select("slug", F.col("source_url").alias("decoded"), "local", "on_disk")
    p = probes.groupBy(F.col("url").alias("decoded")).agg(F.bool_or("not_modified").alias("_304"))
    both = refs.join(s, ["slug", "decoded"], "left").join(p, "decoded", "left")
    action = (
        F.when(F.col("local").isNull() | ~F.coalesce("on_disk", F.lit(False)), "download").when(F.coalesce("_304", F.lit(False)), "reuse").otherwise("supersede")
    )
    return both.select("slug", "url", "decoded", "local", action.alias("action"))


def merged_sidecar(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records of both, the new one of each (slug, source_url) winning, of equal ones the first by local name; a grouped
    maximum, so it combines map-side."""
    rest = [c for c in old.columns if c not in ("slug", "source_url")]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    least = both.groupBy("slug", "source_url").agg(F.min(F.struct(-F.col("_new"), "local", *[c for c in rest if c != "local"])).alias("_m"))
    return least.select(*[F.col(c) if c not in rest else F.col(f"_m.{c}").alias(c) for c in old.columns])


def sidecar_json(records: DataFrame) -> DataFrame:
    """(slug, body): the records of each slug as one JSON text, sorted by source."""
    fields = ("source_url", "local", "etag", "last_modified", "sha256", "bytes")
    sorted_rows = F.array_sort(F.collect_list(F.struct(*fields)))
    shaped = F.transform(sorted_rows, lambda r: F.struct(r["local"].alias("local"), *[r[f].alias(f) for f in fields if f != "local"]))
    body = F.to_json(F.struct(F.lit(1).alias("schema_version"), shaped.alias("images")), {"ignoreNullFields": "false"})
    return records.groupBy("slug").agg(body.alias("body"))


def broken(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, path): local references whose file is missing."""
    refs = docs.select("slug", F.explode(markup.local_images("content")).alias("path"))
    return refs.join(files.select("slug", "path").distinct(), ["slug", "path"], "left_anti")


def broken_references(refs: DataFrame, files: DataFrame) -> DataFrame:
    """broken() of references (slug, path) that were taken before, so that no text is moved."""
    return refs.select("slug", "path").distinct().join(files.select("slug", "path").distinct(), ["slug", "path"], "left_anti")


def localized(refs: DataFrame, sidecar: DataFrame, probes: DataFrame, responses: DataFrame) -> DataFrame:
    """(slug, localized, reused, remaining): what one pass over the remote references of each deliverable does.

    In the order of the pass: a reference whose file is known and unchanged is reused, the others are fetched, and those
    that don't answer stay remote.  refs is references(), sidecar and probes as for classified(), responses (url, status).
    """
    acted = classified(refs.select("slug", "url", "decoded").distinct(), sidecar, probes)
    ok = responses.where("status = 200").select(F.col("url").alias("decoded"), F.lit(True).alias("_got")).distinct()
    both = acted.join(ok, "decoded", "left")
    reused, got = F.col("action") == "reuse", F.coalesce("_got", F.lit(False))
    return both.groupBy("slug").agg(F.count_if(~reused & got).alias("localized"), F.count_if(reused).alias("reused"), F.count_if(~reused & ~got).alias("remaining"))


def orphans(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, path): files that the deliverable doesn't name; none of a slug that still has remote references."""
    refs = docs.select("slug", F.explode(markup.local_images("content")).alias("path"))
    done = docs.where(F.size(markup.remote_images("content")) == 0).select("slug").distinct()
    return files.select("slug", "path").distinct().join(done, "slug", "left_semi").join(refs, ["slug", "path"], "left_anti")


def provenance(fetched: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, source_url, sha256, local): which file holds which download; each file and each download once.

    Both sides are numbered within (slug, sha256), those whose proposed name is a file's name first, and paired by number.
    """
    named = fetched.withColumn("proposed", urls.image_name(F.col("source_url")))
    hit = files.select("slug", "sha256", F.col("local").alias("proposed"), F.lit(1).alias("_hit")).distinct()
    a = named.join(hit, ["slug", "sha256", "proposed"], "left")
    a = a.withColumn("_n", F.row_number().over(Window.partitionBy("slug", "sha256").orderBy(F.col("_hit").desc_nulls_last(), "proposed", "seq")))
    want = named.select("slug", "sha256", F.col("proposed").alias("local"), F.lit(1).alias("_hit")).distinct()
    b = files.join(want, ["slug", "sha256", "local"], "left")
    b = b.withColumn("_n", F.row_number().over(Window.partitionBy("slug", "sha256").orderBy(F.col("_hit").desc_nulls_last(), "local")))
    return a.join(b.select("slug", "sha256", "local", "_n"), ["slug", "sha256", "_n"], "left").select("slug", "source_url", "sha256", "local")


def retarget(text: str, changes: list[tuple[str, str]]) -> str:
    """References replaced where they stand whole; one that is the beginning of another is not touched in it."""
    if not changes:
        return text
    table = dict(changes)
    either = "|".join(re.escape(u) for u in sorted(table, key=len, reverse=True))
    pattern = re.compile(rf"""(\]\(|\bsrc=["'])({either})(?=[)"'\s])""")
    return pattern.sub(lambda m: m.group(1) + table[m.group(2)], text)


def retargeted(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """docs with the references of changes (slug, url, local) pointed to local files."""
    own = changes.groupBy("slug").agg(F.collect_list(F.struct("url", F.concat(F.lit("images/"), "local").alias("to"))).alias("_c"))

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            yield pd.Series(
                [t if t is None or c is None else retarget(t, [(x["url"], x["to"]) for x in c]) for t, c in zip(texts, lists)], dtype=object
            )

    return docs.join(own, "slug", "left").withColumn("content", run("content", "_c")).drop("_c")


def lower_case_names(files: DataFrame) -> DataFrame:
    """(slug, local, target): files to rename to lower case, except where another file has that name already."""
    w = files.select("slug", "local", F.lower("local").alias("target")).where("local <> target")
    first = w.groupBy("slug", "target").agg(F.min("local").alias("local"))
    taken = files.select("slug", F.col("local").alias("target")).distinct()
    return first.join(taken, ["slug", "target"], "left_anti").select("slug", "local", "target")


def decoded(url: Column) -> Column:
    """Every character reference decoded; for the five of markup alone markup.unescape_basic() stays in the JVM."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda u: None if u is None else html.unescape(u))

    return run(url)
