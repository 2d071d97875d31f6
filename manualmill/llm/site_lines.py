"""Problem 3: lines repeated across one site's documents.

For every site a graph is built: a node is a line (by its normal form) with the
number of different documents that hold it as weight, an edge joins lines that
follow one another in a document.  Nodes and edges of high support are kept,
their connected components are the site's boilerplate blocks, and every
occurrence of a line of a block is a line to remove.

Plan: one pass over the texts gives (line hash, document, line number) rows; a
site's lines are spread by (site, line), so a site that holds a third of all
rows is not in one task, and a line's documents are counted from
distinct (site, line, document) rows with map-side combine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import checkpointed, small_batches
from .words import TAG


@dataclass(frozen=True)
class LineRules:
    least_chars: int = 30
    least_documents: int = 8
    #: An edge is kept from this share of the documents of its rarer line on.
    edge_share: float = 0.5
    #: Kept lines up to this number are broadcast (16 bytes each), more are joined by shuffle.
    broadcast_lines: int = 500_000


_NOT_ALNUM = re.compile(r"[\W_]+")


def normal_form(line: str) -> str:
    """The line without tags, in lower case, letters and digits only."""
    if "<" in line:
        line = TAG.sub("", line)
    return _NOT_ALNUM.sub("", line.lower())


def site_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; NULL without a host."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":\d*$", "")
    return F.when(host != "", host)


def sites(manifests: DataFrame) -> DataFrame:
    """(slug, site) by each slug's row of the latest ingested_at; slugs without a site have the site NULL."""
    latest = manifests.where("slug IS NOT NULL").groupBy("slug").agg(
        F.max(F.struct(F.coalesce("ingested_at", F.lit("")).alias("t"), F.coalesce("source_url", F.lit("")).alias("u"))).alias("m")
    )
    return latest.select("slug", site_of(F.col("m.u")).alias("site"))


def _line_batches(rules: LineRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            doc, lines, numbers, counts = [], [], [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                n = 0
                for k, line in enumerate(text.split("\n"), 1):
                    if len(line) < rules.least_chars:
                        continue
                    form = normal_form(line)
                    if len(form) >= rules.least_chars:
                        lines.append(digest(form))
                        numbers.append(k)
                        n += 1
                doc.append(key)
                counts.append(n)
            at = np.repeat(np.arange(len(doc)), counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.string()).take(pa.array(at)),
                    pa.array(np.array(lines, np.uint64).view(np.int64)),
                    pa.array(numbers, pa.int32()),
                ],
                ["key", "line", "line_no"],
            )

    return run


def occurrences(docs: DataFrame, key: str, text: str, site: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """(site, line, key, line_no) of all lines that are long enough, of documents with a site."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    rows = own.mapInArrow(_line_batches(rules), "key string, line long, line_no int")
    return rows.join(site.where("site IS NOT NULL").withColumnRenamed("slug", "key"), "key")


def nodes(rows: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """(site, line, documents) of the lines of high support."""
    each = rows.select("site", "line", "key").distinct()
    return each.groupBy("site", "line").agg(F.count("*").alias("documents")).where(F.col("documents") >= rules.least_documents)


def kept_nodes(docs: DataFrame, key: str, text: str, site: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """(key, line_no, site, line, documents): the occurrences of the lines of high support in their sites."""
    rows = occurrences(docs, key, text, site, rules).withColumn("line", F.xxhash64("site", "line"))
    rows = checkpointed(rows.select("key", "site", "line", "line_no").distinct())
    kept = checkpointed(nodes(rows, rules).select("line", "documents"))
    return checkpointed(rows.join(_bounded(kept, rules), "line").select("key", "line_no", "site", "line", "documents"))


def _bounded(lines: DataFrame, rules: LineRules) -> DataFrame:
    """lines, to be broadcast if there are few; it must be cheap to read again."""
    return F.broadcast(lines) if lines.limit(rules.broadcast_lines + 1).count() <= rules.broadcast_lines else lines


def repeated_lines(docs: DataFrame, key: str, text: str, site: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """(key, line_no, site, line, documents, block): every occurrence of a line of one of its site's boilerplate blocks.

    A block is a component of the graph of kept nodes and edges; a kept line without a strong neighbour is a block of its own.
    NULL and empty texts have none; a row that is given twice counts once; documents without a site have none.
    """
    found = kept_nodes(docs, key, text, site, rules)
    member = checkpointed(blocks(found, rules).select("line", "block"))
    return found.join(_bounded(member, rules), "line").select("key", "line_no", "site", "line", "documents", "block")


def blocks(found: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """(site, line, documents, block, block_lines): the kept lines with the boilerplate block they belong to.

    found is what kept_nodes() gives.  Lines are neighbours if no other kept line lies between them in a document.
    """
    after = F.lead("line").over(Window.partitionBy("key").orderBy("line_no"))
    pairs = found.select("key", "line", after.alias("next")).where("next IS NOT NULL AND line <> next").distinct()
    edges = pairs.groupBy("line", "next").agg(F.count("*").alias("support"))
    weight = found.select("site", "line", "documents").distinct()
    edges = edges.join(weight.select("line", F.col("documents").alias("d1")), "line").join(
        weight.select(F.col("line").alias("next"), F.col("documents").alias("d2")), "next"
    )
    strong = edges.where((F.col("support") >= rules.least_documents) & (F.col("support") >= rules.edge_share * F.least("d1", "d2")))
    group = connected_components(strong, "line", "next").withColumnRenamed("node", "line")
    named = weight.join(group, "line", "left").withColumn("block", F.coalesce("component", "line"))
    size = named.groupBy("block").agg(F.count("*").alias("block_lines"))
    return named.join(size, "block").select("site", "line", "documents", "block", "block_lines")


def _drop_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            if text is not None and gone:
                drop = set(gone)
                text = "\n".join(line for k, line in enumerate(text.split("\n"), 1) if k not in drop)
            out.append(text)
        removed = [len(set(g or ())) for g in batch.column("gone").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(out, pa.string()), pa.array(removed, pa.int64())], ["key", "text", "removed"]
        )


def without_repeated_lines(docs: DataFrame, key: str, text: str, site: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """(key, text, removed): every document once, without the occurrences of its site's boilerplate blocks; NULL texts stay NULL.

    Texts are dealt by key once: repeated rows, told by hash, and what is to be removed meet them there.
    """
    gone = repeated_lines(docs, key, text, site, rules).groupBy("key").agg(F.collect_set("line_no").alias("gone"))
    own = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).withColumn("_id", F.md5("text"))
    own = own.repartition("key").dropDuplicates(["key", "_id"]).select("key", "text")
    return own.join(gone, "key", "left").mapInArrow(_drop_batches, "key string, text string, removed long")
