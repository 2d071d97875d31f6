"""Merging ordered pages into one deliverable, and the counters of a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from .ordering import numbered

#: What stands between the pages of a Markdown deliverable.
RULE = "\n\n---\n\n"


def joined(by: list[str], order: str, body: str, separator: str) -> Column:
    """The bodies of a group in their order; a group's pages are one deliverable, which is one string by definition."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, body))), lambda x: x[body]), separator)


def merge_markdown(pages: DataFrame, by: list[str], order: str, body: str) -> DataFrame:
    """(by..., content, pages): pages without a body are left out; a manual without any page is missing, never an empty file."""
    return pages.where(F.col(body).isNotNull()).groupBy(*by).agg(joined(by, order, body, RULE).alias("content"), F.count("*").alias("pages"))


def merge_html(pages: DataFrame, by: list[str], order: str, body: str, title: str, h1: bool = True, suffix: str = "") -> DataFrame:
    """(by..., content, pages): an HTML document with the title of the group's first page that has one."""
    first = F.min(F.when(F.col(title).isNotNull(), F.struct(order, title)))[title]
    out = pages.where(F.col(body).isNotNull()).groupBy(*by).agg(
        joined(by, order, body, "\n").alias("_b"), first.alias("_t"), F.count("*").alias("pages")
    )
    name = markup.escape(F.concat(F.coalesce("_t", F.lit("")), F.lit(suffix)))
    head = F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), name, F.lit("</title></head><body>\n"))
    head = F.concat(head, F.lit("<h1>"), name, F.lit("</h1>\n")) if h1 else head
    return out.select(*by, F.concat(head, "_b", F.lit("\n</body></html>\n")).alias("content"), "pages")


def crawl_counters(attempts: DataFrame, by: list[str], ok: Column, cut: Column) -> DataFrame:
    """(by..., pages, lost, truncated) of what a crawl tried: saved pages, lost ones, and whether it was cut short."""
    return attempts.groupBy(*by).agg(
        F.count_if(ok).alias("pages"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("lost"), F.coalesce(F.bool_or(cut), F.lit(False)).alias("truncated")
    )


def in_table_order(pages: DataFrame, toc: DataFrame, by: list[str], key: str) -> DataFrame:
    """Pages in the order of a table of contents (by..., key, ord), those it lacks after it by name, with level 2."""
    first = toc.groupBy(*by, key).agg(F.min(F.struct("ord", "level")).alias("_t"))
    listed = pages.join(first, [*by, key]).select(*pages.columns, F.lit(0).alias("_rest"), F.col("_t.ord").alias("_at"), F.col("_t.level").alias("level"))
    other = pages.join(first, [*by, key], "left_anti").select(*pages.columns, F.lit(1).alias("_rest"), F.lit(0).alias("_at"), F.lit(2).alias("level"))
    return numbered(listed.unionByName(other), by, ["_rest", "_at", key]).drop("_rest", "_at")
