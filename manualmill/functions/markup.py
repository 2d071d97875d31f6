"""HTML and Markdown scalars that built-in functions can express."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of index banners, agent footers, image references and headings.
BANNER = r"(?m)^(?:> ## Documentation Index[^\n]*\n(?:>[^\n]*\n?)*|> For the complete documentation index[^\n]*\n)\n*"
FOOTER = r"\n#{1,6}\s+Agent Instructions(?::\s+Querying This Documentation)?\s*\n"
LOCAL_IMAGE = r"""(?:src=["']|\]\()(images/[^"')\s]+)"""
REMOTE_IMAGE = r"""(?i)(?:<img\b[^>]*?\bsrc=["']|!\[[^\]]*\]\()(https?://[^"')\s]+)"""
ROOT_TARGET = r"\]\((/[^)]*)\)"
ROOT_ATTRIBUTE = r"""((?:src|href)=["'])(/[^"']*)"""
MARKDOWN_HEADING = r"(?m)^#{1,6} "
HTML_HEADING = r"(?i)<h[1-6][\s>]"


def strip_scripts(html: Column) -> Column:
    out = html
    for name in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
    return out


def unescape_basic(text: Column) -> Column:
    """The five entities of markup and the no-break space; &amp; last, so nothing is decoded twice."""
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def page_title(html: Column) -> Column:
    """Text of the first title element, NULL if there is none or it is empty."""
    found = F.trim(unescape_basic(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.when(found != "", found)


def generator_meta(html: Column) -> Column:
    """Content of the generator meta element in lower case, empty without one."""
    tag = F.regexp_extract(html, r"""(?is)(<meta\b[^>]*\bname\s*=\s*["']?generator["']?[^>]*>)""", 1)
    return F.lower(F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1))


def heading_count(text: Column, kind: Column) -> Column:
    md = F.regexp_count(text, F.lit(MARKDOWN_HEADING))
    html = F.regexp_count(text, F.lit(HTML_HEADING))
    return F.when(kind == "markdown", md).when(kind == "html", html).otherwise(F.lit(0)).cast("bigint")


def visible_text(html: Column) -> Column:
    text = F.regexp_replace(strip_scripts(html), "(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(text, "[ \t\r\n]+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""href="([^"]*)\""""), F.lit(1))


def absolutize_root(text: Column, origin: Column) -> Column:
    """Root-relative Markdown targets and src or href values under an origin."""
    out = F.regexp_replace(text, F.lit(ROOT_TARGET), F.concat(F.lit("]("), origin, F.lit("$1)")))
    return F.regexp_replace(out, F.lit(ROOT_ATTRIBUTE), F.concat(F.lit("$1"), origin, F.lit("$2")))


def strip_index_banner(md: Column) -> Column:
    """Without the banner that points to a documentation index, block quote or single line."""
    return F.regexp_replace(md, BANNER, "")


def strip_agent_footer(md: Column) -> Column:
    """Without the appended section for agents and the rule before it."""
    head = F.get(F.split(md, FOOTER, 2), F.lit(0))
    head = F.regexp_replace(head, r"\s+$", "")
    return F.when(head.endswith("---"), F.regexp_replace(F.regexp_replace(head, "---$", ""), r"\s+$", "")).otherwise(head)


def declared_width(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?i)[?&](?:wid|width|w)=(\d+)", 1).try_cast("bigint"), F.lit(0))


def srcset_candidates(srcset: Column, rank: int) -> Column:
    """Array of (width, density, -rank, url) of a srcset; nothing of one that is inline data, nor of its parts that are."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.startswith("data:"))

    def one(part: Column) -> Column:
        url = F.regexp_extract(part, r"^(\S+)", 1)
        width = F.nullif(F.regexp_extract(part, r"^\S+(?:\s.*)?\s(\d+)w(?:\s|$)", 1).try_cast("bigint"), F.lit(0))
        density = F.regexp_extract(part, r"^\S+(?:\s.*)?\s(\d*\.?\d+)x(?:\s|$)", 1).try_cast("double")
        return F.struct(
            F.coalesce(width, declared_width(url)).alias("width"),
            F.coalesce(density, F.lit(0.0)).alias("density"),
            F.lit(-rank).alias("rank"),
            url.alias("url"),
        )

    empty = F.array().cast("array<struct<width:bigint,density:double,rank:int,url:string>>")
    return F.when(srcset.startswith("data:") | srcset.isNull(), empty).otherwise(F.transform(parts, one))


def best_candidate(candidates: Column) -> Column:
    """URL of the widest, then densest, then best-ranked candidate; of equal ones the greatest URL."""
    return F.array_max(candidates)["url"]


def remote_images(text: Column) -> Column:
    """Distinct remote image references of HTML or Markdown."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(REMOTE_IMAGE), F.lit(1)))


def local_images(text: Column) -> Column:
    """Distinct references to files of the images folder."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(LOCAL_IMAGE), F.lit(1)))
