"""Archives (zip, tar, EPUB) as tables of members, in reading order."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

# Members that are pages.
TEXTS = (".txt", ".md", ".rst")
PAGES = (".html", ".htm")
SCHEMA = "source string, member string, ext string, text string, error string"


#: Bytes that the texts of one archive may have together when unpacked.
MOST_BYTES = 1 << 28


def _suffix(name: str) -> str:
    dot = re.search(r"\.[A-Za-z0-9]+$", name)
    return dot.group(0).lower() if dot else ""


def _wanted(name: str) -> bool:
    return _suffix(name) in (*TEXTS, *PAGES, ".opf") and not name.startswith("/") and ".." not in name.split("/")


def _members(data: bytes, most: int) -> Iterator[tuple[str, bytes]]:
    """Names and bodies of the members that are wanted; stops with an error once they hold more than most bytes."""

    def bounded(stream) -> bytes:
        nonlocal most
        body = stream.read(most + 1)
        most -= len(body)
        if most < 0:
            raise OSError("too large")
        return body

    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir() and _wanted(info.filename):
                    with z.open(info) as f:
                        yield info.filename, bounded(f)
    else:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for info in t:
                if info.isfile() and _wanted(info.name) and (f := t.extractfile(info)):
                    yield info.name, bounded(f)


def _rows(source: str, data: bytes | None, most: int) -> list[tuple]:
    """The rows of one archive; one with the error of an archive that can't be read (broken, encrypted, too large)."""
    try:
        return [(source, n, _suffix(n), body.decode("utf-8", "replace"), None) for n, body in _members(bytes(data or b""), most)]
    except Exception as e:  # whatever is wrong with one archive must not end the others
        return [(source, None, None, None, "too large" if str(e) == "too large" else type(e).__name__)]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for source, data in zip(pdf["source"], pdf["data"]):
            yield pd.DataFrame(_rows(source, data, MOST_BYTES), columns=["source", "member", "ext", "text", "error"])


def members(files: DataFrame) -> DataFrame:
    """SCHEMA: the texts, pages and package files of archives (source, data); a broken archive is one row with its error."""
    return files.select("source", "data").mapInPandas(_read, SCHEMA)


def reading_order(rows: DataFrame) -> DataFrame:
    """(source, member, text, kind, ord): the pages of each archive.

    The kind is html if any member is; members of the other kind are left out.  An EPUB's spine orders its members by
    file name, the last of equal names counting; what the spine lacks follows in natural order.
    """
    good = rows.where("error IS NULL")
    kind = good.groupBy("source").agg(F.when(F.bool_or(F.col("ext").isin(*PAGES)), "html").otherwise("markdown").alias("kind"))
    pages = good.where(F.col("ext") != ".opf").join(kind, "source")
    pages = pages.where(F.col("ext").isin(*PAGES) == (F.col("kind") == "html"))
    opf = good.where(F.col("ext") == ".opf").groupBy("source").agg(F.min(F.struct("member", "text")).alias("o")).select("source", F.col("o.text").alias("opf"))
    item = F.regexp_extract_all("opf", F.lit(r"(?s)(<(?:\w+:)?item\b[^>]*>)"), F.lit(1))
    refs = F.regexp_extract_all("opf", F.lit(r'(?s)<(?:\w+:)?itemref\b[^>]*\bidref="([^"]*)"'), F.lit(1))
    hrefs = opf.select("source", F.explode(item).alias("i")).select(
        "source", F.regexp_extract("i", r'\bid="([^"]*)"', 1).alias("id"), F.substring_index(F.regexp_extract("i", r'\bhref="([^"]*)"', 1), "/", -1).alias("base")
    )
    spine = opf.select("source", F.posexplode(refs).alias("at", "id")).join(hrefs, ["source", "id"]).groupBy("source", "base").agg(F.min("at").alias("at"))
    named = pages.withColumn("base", F.substring_index("member", "/", -1))
    last = named.groupBy("source", "base").agg(F.max("member").alias("_last"))
    placed = named.join(last, ["source", "base"]).join(spine, ["source", "base"], "left")
    place = F.when(F.col("member") == F.col("_last"), F.col("at"))
    order = Window.partitionBy("source").orderBy(F.coalesce(place, F.lit(1 << 30)), urls.natural_key(F.col("member")))
    return placed.select("source", "member", "text", "kind", (F.row_number().over(order) - 1).cast("bigint").alias("ord"))
