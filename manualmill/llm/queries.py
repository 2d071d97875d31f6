"""The registered queries of problems 1 and 3 to 9, and the SQL that checks those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import checks, encoding, leak, near_dup, packing, repetition, residue_table, site_lines, split, style_tree

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of slugs with at least 0.6 of their runs of four words in common."""
    pairs = near_dup.near_duplicate_keys(table(spark, sf_dir, "deliverables"), "slug", "content")
    return pairs.select(F.col("a").alias("slug_a"), F.col("b").alias("slug_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slug with its class of exact copies, its group of near copies and its number of links."""
    groups = near_dup.near_duplicate_groups(table(spark, sf_dir, "deliverables"), "slug", "content")
    return groups.select(F.col("key").alias("slug"), "class_id", "group_id", "links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of lines that at least 8 slugs of a site have."""
    site = site_lines.sites(table(spark, sf_dir, "manifests"))
    found = site_lines.repeated_lines(table(spark, sf_dir, "deliverables"), "slug", "content", site)
    return found.select(F.col("key").alias("slug"), F.col("line_no").cast("int").alias("line_no"))


def p3_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boilerplate blocks of every site: their number of lines and the documents of their rarest and commonest line."""
    site = site_lines.sites(table(spark, sf_dir, "manifests"))
    lines = site_lines.blocks(site_lines.kept_nodes(table(spark, sf_dir, "deliverables"), "slug", "content", site))
    return lines.groupBy("site", "block").agg(
        F.count("*").alias("n_lines"), F.min("documents").alias("least_documents"), F.max("documents").alias("most_documents")
    )


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every deliverable without the repeated lines of its site."""
    site = site_lines.sites(table(spark, sf_dir, "manifests"))
    clean = site_lines.without_repeated_lines(table(spark, sf_dir, "deliverables"), "slug", "content", site)
    return clean.select(F.col("key").alias("slug"), F.col("text").alias("content"), "removed")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs whose content had to be split."""
    pieces = _pieces(spark, sf_dir)
    return pieces.where("pieces > 1").select(F.col("key").alias("slug")).distinct()


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(table(spark, sf_dir, "deliverables"), table(spark, sf_dir, "split_limits"), "slug", "kind", "content")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized deliverable."""
    return _pieces(spark, sf_dir).withColumnRenamed("key", "slug")


def p5_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of the oversized deliverables put together again from their pieces; whether every piece is within its
    limit, and repeats the wanted end of the piece before it up to three bytes."""
    limits = table(spark, sf_dir, "split_limits").groupBy("kind").agg(F.min("max_bytes").alias("m"), F.max("overlap_bytes").alias("o"))
    data = F.encode("piece", "utf-8")
    own = F.expr("substring(d, cast(own_start - start_byte + 1 as int), cast(end_byte - own_start as int))")
    rows = _pieces(spark, sf_dir).withColumn("d", data).withColumn("own", own).join(F.broadcast(limits), "kind")
    again = F.col("own_start") - F.col("start_byte")
    right = (F.col("piece_no") == 1) | again.between(F.col("o") - 3, F.col("o"))
    parts = F.array_sort(F.collect_list(F.struct("piece_no", F.decode("own", "utf-8").alias("t"))))["t"]
    out = rows.groupBy("key").agg(F.sha2(F.array_join(parts, ""), 256).alias("sha256"), F.bool_and(F.octet_length("d") <= F.col("m")).alias("fits"), F.bool_and(right).alias("overlaps"))
    return out.withColumnRenamed("key", "slug")


def p7_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every spec and text its parts and their tokens, and whether all the containers they are in hold what they can."""
    rows = _packed(spark, sf_dir).groupBy("spec_id", "doc_id").agg(F.count("*").alias("parts"), F.sum("tokens").alias("tokens"), F.bool_and(F.col("fill") <= F.col("capacity")).alias("fits"))
    return rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judged(table(spark, sf_dir, "deliverables"), "slug", "content").withColumnRenamed("key", "slug")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of whose runs of five words at least a quarter occurred before."""
    return _judged(spark, sf_dir).where("is_candidate AND is_case").select("slug").distinct()


def p6_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every deliverable with its repeated shares and the posterior probability of being repetitive."""
    return _judged(spark, sf_dir)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"), "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be split for a spec."""
    return _packed(spark, sf_dir).where("parts > 1").select("spec_id", F.col("doc_id").cast("bigint").alias("doc_id")).distinct()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assignment of all texts to containers."""
    return _packed(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items of which they hold 12 words in a row."""
    found = leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text")
    return found.select(F.col("doc").cast("bigint").alias("doc_id"), F.col("item").cast("bigint").alias("item_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliverables and the foreign markups they hold."""
    found = residue_table.residues(table(spark, sf_dir, "deliverables"), "slug", "kind", "content")
    return found.select(F.col("key").alias("slug"), "markup")


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoding.garbled(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.withColumn("doc_id", F.col("key").cast("bigint")).drop("key")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with wrongly decoded text."""
    return _garbled(spark, sf_dir).select("doc_id").distinct()


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restored texts, with what was repaired and what is lost."""
    return _garbled(spark, sf_dir)


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every deliverable as clean text without the unimportant branches of its site."""
    site = site_lines.sites(table(spark, sf_dir, "manifests"))
    clean = style_tree.cleaned(table(spark, sf_dir, "deliverables"), "slug", "kind", "content", site)
    return clean.withColumnsRenamed({"key": "slug", "text": "content"})


def p7_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers of each spec are filled."""
    return packing.used(_packed(spark, sf_dir))


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which all words of a passage of an item stand close together, in any order."""
    found = leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text", span=16)
    return found.select(F.col("doc").cast("bigint").alias("doc_id"), F.col("item").cast("bigint").alias("item_id"), "passages")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p3_found": p3_found,
    "p3_blocks": p3_blocks,
    "p3_clean": p3_clean,
    "p4_found": p4_found,
    "p4_clean": p4_clean,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_rejoined": p5_rejoined,
    "p6_found": p6_found,
    "p6_scored": p6_scored,
    "p7_found": p7_found,
    "p7_containers": p7_containers,
    "p7_parts": p7_parts,
    "p7_used": p7_used,
    "p8_found": p8_found,
    "p8_near": p8_near,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}
SQL: dict[str, str] = checks.SQL
