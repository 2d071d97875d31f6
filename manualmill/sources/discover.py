"""Discovery: from a fetched index (sitemap, search index, table of contents, listing) to the ordered pages of a source.

Every function takes rows of sources with the body of their index and gives (source..., ord, url) rows; ord is the
place in the index.  Filters are plain Columns, so they run before any join with responses.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.ordering import first_seen, numbered

# Patterns and names of the indexes.
VERSION_SEGMENT = r"^(?:\d+\.(?:\d+|x)[^/]*|next)$"
MARKDOWN_URL = r"""(https?://[^\s)\]"'<>]+\.md)"""
GITBOOK_URL = r"(https?://[^\s)]+\.md)"
CLICKHELP_ID = r'"e"\s*:\s*"([^"]+)"'
PALIGO_URL = r'"url"\s*:\s*"([^"]+)"'
SPHINX_SKIP_DIRS = ("_static", "_sources", "_modules", "_images", "_downloads")
SPHINX_SKIP_PAGES = ("genindex", "genindex-all", "search", "py-modindex")
REPOSITORY_META = ("documentation.md", "readme.md", "license.md", "contributing.md", "changelog.md")
ADOBE_DENY = ("/photoshop-elements-editor/", "/premiere-elements-editor/")


def under(url: Column, base: Column) -> Column:
    return (url == base) | url.startswith(F.concat(base, F.lit("/")))


def _exploded(df: DataFrame, items: Column, keys: list[str], name: str = "url") -> DataFrame:
    return df.select(*keys, F.posexplode(items).alias("ord", name))


def sitemap_locs(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """The loc entries of a sitemap or sitemap index; a body that is none gives no rows."""
    locs = F.transform(F.regexp_extract_all(body, F.lit(r"<loc>\s*([^<]*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return _exploded(df, locs, keys).where("url <> ''")


def sitemap_kind(body: Column) -> Column:
    """index, urlset or NULL: what a body is."""
    return F.when(body.rlike(r"(?i)<sitemapindex[\s>]"), "index").when(body.rlike(r"(?i)<urlset[\s>]"), "urlset")


def docusaurus_pages(df: DataFrame, body: str, base: Column, keys: list[str]) -> DataFrame:
    """Sitemap pages under the base that belong to no other version."""
    out = sitemap_locs(df.withColumn("_base", base), body, [*keys, "_base"])
    first = F.get(F.split(F.regexp_replace(F.substring(F.col("url"), F.length("_base") + 1, F.lit(1 << 20)), "^/+", ""), "/"), F.lit(0))
    return out.where(under(F.col("url"), F.col("_base")) & ~first.rlike(VERSION_SEGMENT)).drop("_base")


def hugo_pages(df: DataFrame, body: str, base: Column, keys: list[str]) -> DataFrame:
    """Sitemap pages under the base that are neither print nor taxonomy pages."""
    out = sitemap_locs(df.withColumn("_base", base), body, [*keys, "_base"])
    path = F.concat(urls.path(F.col("url")), F.lit("/"))
    skip = path.contains("/print/") | path.contains("/categories/") | path.contains("/tags/")
    return out.where(under(F.col("url"), F.col("_base")) & ~skip).drop("_base")


def ancestor_sitemaps(df: DataFrame, url: str, keys: list[str]) -> DataFrame:
    """(keys..., depth, candidate): where a sitemap may be, the deepest folder first by depth."""
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    parts = urls.segments(urls.base_dir(F.col(url), any_dot=True))
    depths = df.withColumn("_o", origin).withColumn("_s", parts).select(*keys, "_o", "_s", F.explode(F.sequence(F.lit(0), F.size("_s"))).alias("depth"))
    folder = F.when(F.col("depth") == 0, F.col("_o")).otherwise(F.concat("_o", F.lit("/"), F.array_join(F.slice("_s", F.lit(1), F.greatest("depth", F.lit(1))), "/")))
    return depths.select(*keys, "depth", F.concat(folder, F.lit("/sitemap.xml")).alias("candidate"))


def sphinx_wanted(url: Column, prefix: Column) -> Column:
    """Is a link one of the manual's pages: same prefix, no utility folder or page."""
    parts = urls.segments(url)
    stem = F.regexp_replace(F.get(parts, F.size(parts) - 1), r"\.html?$", "")
    return url.startswith(prefix) & ~F.arrays_overlap(parts, F.array(*map(F.lit, SPHINX_SKIP_DIRS))) & ~F.coalesce(stem.isin(*SPHINX_SKIP_PAGES), F.lit(False))


def clickhelp_topics(df: DataFrame, script: str, keys: list[str]) -> DataFrame:
    return first_seen(_exploded(df, F.regexp_extract_all(script, F.lit(CLICKHELP_ID), F.lit(1)), keys, "topic"), [*keys, "topic"], ["ord"])


def paligo_pages(df: DataFrame, script: str, keys: list[str]) -> DataFrame:
    found = _exploded(df, F.regexp_extract_all(script, F.lit(PALIGO_URL), F.lit(1)), keys, "page")
    return first_seen(found.withColumn("page", urls.without_fragment(F.col("page"))).where("page <> ''"), [*keys, "page"], ["ord"])


def llms_pages(df: DataFrame, index: str, keys: list[str], section: str | None = None, pattern: str = MARKDOWN_URL) -> DataFrame:
    """Markdown pages of an index whose path ends in .md, first-seen, under the section if one is given."""
    found = _exploded(df, F.regexp_extract_all(index, F.lit(pattern), F.lit(1)), keys + ([section] if section else []))
    found = found.where(urls.path(F.col("url")).endswith(".md"))
    if section:
        found = found.where(F.col(section).isNull() | F.col("url").startswith(F.col(section))).drop(section)
    return first_seen(found, [*keys, "url"], ["ord"])


def mkdocs_bodies(df: DataFrame, index: str, keys: list[str]) -> DataFrame:
    """(keys..., ord, path, title, body): the pages of a search index as Markdown, in first-seen order.

    The record of a whole page holds its sections' text again, so only what stands before its first section is kept.
    """
    schema = "struct<docs:array<struct<location:string,title:string,text:string>>>"
    rows = df.select(*keys, F.posexplode(F.from_json(index, schema)["docs"]).alias("pos", "r"))
    rows = rows.select(*keys, "pos", *[F.trim(F.coalesce(f"r.{c}", F.lit(""))).alias(c) for c in ("location", "title", "text")])
    rows = rows.withColumn("path", urls.without_fragment(F.col("location"))).withColumn("anchored", F.col("location").contains("#"))
    rows = rows.withColumn("anchored", F.col("anchored") & ~F.col("location").endswith("#"))
    page = F.max(F.when(~F.col("anchored"), F.struct("pos", "title", "text")))
    parts = F.array_sort(F.collect_list(F.when(F.col("anchored"), F.struct("pos", "title", "text"))))
    grouped = rows.groupBy(*keys, "path").agg(F.min("pos").alias("ord"), page.alias("page"), parts.alias("parts"))
    first = F.get(F.col("parts.text"), F.lit(0))
    text, title = F.coalesce("page.text", F.lit("")), F.coalesce("page.title", F.lit(""))
    cut = F.when((F.length(first) > 0) & text.contains(first), F.trim(F.call_function("substring_index", text, first, F.lit(1)))).otherwise(text)
    head = F.when(title != "", F.concat(F.lit("# "), title, F.when(cut != "", F.concat(F.lit("\n\n"), cut)).otherwise(""))).otherwise(cut)
    sections = F.transform("parts", lambda p: F.when(p["title"] != "", F.concat(F.lit("## "), p["title"], F.lit("\n\n"), p["text"])).otherwise(p["text"]))
    body = F.array_join(F.filter(F.concat(F.array(head), sections), lambda b: F.trim(b) != ""), "\n\n")
    return grouped.select(*keys, F.col("ord").cast("bigint").alias("ord"), "path", title.alias("title"), body.alias("body"))


def repository_pages(tree: DataFrame, toc: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., path, ord): Markdown files of a listing, those of its table of contents first.

    tree is (keys..., path, type), toc (keys..., body).  Meta files are left out, in either letter case.
    """
    files = tree.where((F.col("type") == "blob") & F.lower("path").endswith(".md")).select(*keys, "path").distinct()
    files = files.where(~F.lower(F.substring_index("path", "/", -1)).isin(*REPOSITORY_META))
    targets = _exploded(toc, F.regexp_extract_all("body", F.lit(r"\]\(([^)]+)\)"), F.lit(1)), keys, "target")
    name = F.substring_index(F.regexp_replace(F.regexp_replace("target", r"[#?].*$", ""), "/+$", ""), "/", -1)
    listed = targets.select(*keys, F.concat(F.regexp_replace(name, r"\.md$", ""), F.lit(".md")).alias("path"), "ord")
    listed = listed.groupBy(*keys, "path").agg(F.min("ord").alias("at"))
    placed = files.join(listed, [*keys, "path"], "left").withColumn("at", F.coalesce("at", F.lit(1 << 30)))
    return numbered(placed, keys, ["at", "path"]).drop("at")


def zendesk_endpoint(url: Column) -> Column:
    """The articles request for a help center URL, narrowed to the article, section or category it names."""
    origin = F.concat(urls.scheme(url), F.lit("://"), urls.netloc(url))
    base = F.concat(origin, F.lit("/api/v2/help_center/"), urls.locale(url))
    article = F.regexp_extract(urls.path(url), r"/articles/(\d+)", 1)
    scope = F.regexp_extract(urls.path(url), r"/(sections|categories)/(\d+)", 1)
    number = F.regexp_extract(urls.path(url), r"/(sections|categories)/(\d+)", 2)
    return (
        F.when(article != "", F.concat(base, F.lit("/articles/"), article, F.lit(".json")))
        .when(scope != "", F.concat(base, F.lit("/"), scope, F.lit("/"), number, F.lit("/articles.json?per_page=100")))
        .otherwise(F.concat(base, F.lit("/articles.json?per_page=100")))
    )


def zendesk_articles(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """(keys..., ord, title, body, html_url) of one response, a list of articles or a single one."""
    article = "struct<title:string,body:string,html_url:string>"
    got = F.from_json(body, f"struct<articles:array<{article}>,article:{article}>")
    items = F.coalesce(got["articles"], F.when(got["article"].isNotNull(), F.array(got["article"])))
    return df.select(*keys, F.posexplode(items).alias("ord", "a")).select(*keys, "ord", "a.title", "a.body", "a.html_url")


# How a tree of topics names its parts.
_TREE_SCHEMA = "array<struct<ord:int,depth:int,kind:string,text:string,href:string>>"


def _first_array(text: str | None) -> list:
    """The first JSON array in a script; empty if there is none that can be read."""
    at = text.find("[") if isinstance(text, str) else -1
    try:
        return json.JSONDecoder().raw_decode(text[at:])[0] if at >= 0 else []
    except (ValueError, RecursionError):
        return []


def _topic_rows(text: str | None) -> list[dict]:
    """Topics depth first, without recursion."""
    out: list[dict] = []
    stack = [(n, 1) for n in reversed(_first_array(text))]
    while stack:
        node, depth = stack.pop()
        if not isinstance(node, dict):
            continue
        inner = node.get("nodes")
        branch = isinstance(inner, list)
        name, href = html.unescape(str(node.get("text") or "")), str(node.get("href") or ("" if branch else f"{node.get('id', '')}.html"))
        out.append({"ord": len(out), "depth": depth, "kind": "branch" if branch else "leaf", "text": name, "href": href})
        stack += [(n, depth + 1) for n in reversed(inner)] if branch else []
    return out


def topic_tree(script: Column | str) -> Column:
    """Topics of a script that assigns a nested list (text, href, nodes), depth first; empty if it holds none."""

    @F.pandas_udf(_TREE_SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_topic_rows(t) for t in texts], dtype=object)

    return run(script)
