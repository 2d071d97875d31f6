"""What single content systems need besides discovery and extraction: their bases, titles, slugs, contents trees and images."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom, markup, urls
from .profiles import extract_column

# Patterns and names of the systems.
PALIGO_GENERATOR = r'(?i)name="generator"\s+content="paligo"'
PALIGO_LOCALE = r'href="([a-z]{2}(?:-[A-Za-z]{2})?)/[^"/]+\.html"'
ST4_TITLE = r'projectTitle\s*=\s*"([^"]*)"'
CLICKHELP_GENERIC = ("manual", "manuals", "html", "docs")
OPENSTAX_SUFFIX = " | OpenStax"
RTD_LANGUAGE = r"^[a-z]{2}(?:-[a-z]{2,4})?$"
IMAGE_PROXY = r"""~gitbook/image\?url=([^&"'\s]+)"""
FILE_REFERENCE = r"/files/[A-Za-z0-9_-]+"
APPLE_TOPIC = r"/guide/[^/]+/([^/]+)/"
SHORTEST_BODY = 200


def folder(url: Column) -> Column:
    return F.regexp_replace(url, r"/[^/]*$", "")


def clickhelp_root(url: Column) -> Column:
    return F.regexp_replace(folder(url), "/HTML$", "")


def clickhelp_slug(url: Column) -> Column:
    """Last folder of the publication with a name of its own."""
    named = F.filter(urls.segments(clickhelp_root(url)), lambda s: ~F.lower(s).isin(*CLICKHELP_GENERIC))
    slug = urls.slugify(F.get(named, F.size(named) - 1))
    return F.when(F.coalesce(slug, F.lit("")) == "", "manual").otherwise(slug)


def paligo_base(url: Column, body: Column) -> Column:
    """Folder of the topics: that of a topic page, or the one a portal links into."""
    found = F.regexp_extract(body, PALIGO_LOCALE, 1)
    return F.when(body.rlike(PALIGO_GENERATOR) | (found == ""), folder(url)).otherwise(F.concat(folder(url), F.lit("/"), found))


def st4_title(script: Column) -> Column:
    """Name of the manual without the tag of its output format; NULL without one."""
    title = F.trim(F.regexp_replace(F.regexp_extract(script, ST4_TITLE, 1), r"^\[[^\]]*\]", ""))
    return F.when(title != "", title)


def book_title(html: Column) -> Column:
    """Name of the book in a page title of the form page - book | site."""
    title = markup.page_title(html)
    bare = F.trim(F.when(title.endswith(OPENSTAX_SUFFIX), F.left(title, F.length(title) - len(OPENSTAX_SUFFIX))).otherwise(title))
    last = F.trim(F.substring_index(bare, " - ", -1))
    return F.when(last != "", last)


def language_and_version(url: Column) -> Column:
    s = urls.segments(url)
    named = (F.size(s) >= 2) & F.get(s, F.lit(0)).rlike(RTD_LANGUAGE)
    language = F.when(named, F.get(s, F.lit(0))).otherwise("en")
    return F.struct(language.alias("language"), F.when(named, F.get(s, F.lit(1))).otherwise("latest").alias("version"))


def pdf_slug(url: Column) -> Column:
    name = F.try_url_decode(F.replace(urls.last_segment(url), F.lit("+"), F.lit("%2B")))
    own = urls.slugify(F.regexp_replace(name, r"(?i)\.pdf$", ""))
    site = urls.slugify(F.get(F.split(F.regexp_replace(urls.netloc(url), r"^www\.", ""), r"\."), F.lit(0)))
    slug = F.when(F.lower(name).endswith(".pdf"), own).otherwise(site)
    return F.when(F.coalesce(slug, F.lit("")) == "", "manual").otherwise(slug)


def is_pdf(data: Column) -> Column:
    """The magic of a PDF within the first 1,024 bytes of a body (binary)."""
    return F.contains(F.substring(data, 1, 1024), F.lit(b"%PDF-"))


def support_article(pages: DataFrame, html: str, url: str) -> DataFrame:
    """pages with title and body of a support article; shells without a title and with little text are dropped, not lost.

    A page without an article has a NULL body, which is lost; a title that is missing is made from the address.
    """
    out = pages.withColumn("body", extract_column(F.col(html), F.col(url), "microsoft_support"))
    h1 = F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    out = out.withColumn("title", markup.unescape_basic(markup.visible_text(h1)))
    out = out.where(~F.coalesce((F.col("title") == "") & (F.length("body") < SHORTEST_BODY), F.lit(False)))
    name = F.replace(urls.last_segment(F.col(url)), F.lit("-"), F.lit(" "))
    made = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1 << 20)))
    return out.withColumn("title", F.when(F.col("body").isNotNull() & (F.col("title") == ""), made).otherwise(F.col("title")))


def folded_slug(text: Column) -> Column:
    """Slug with accents folded to ASCII; NULL if nothing is left, which names no manual."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            plain = unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower()
            return re.sub(r"[^a-z0-9]+", "-", plain).strip("-") or None

        return s.map(one)

    return run(text)


def unaliased(pages: DataFrame, by: list[str], order: str, body: str) -> DataFrame:
    """Of pages of one source with the same content the first; the others are aliases, neither saved nor lost."""
    hashed = pages.withColumn("_sha", F.sha2(body, 256))
    # A grouped minimum, so a content that a third of the pages share is in no single task.
    first = hashed.where("_sha IS NOT NULL").groupBy(*by, "_sha").agg(F.min(order).alias("_first"))
    return hashed.join(first, [*by, "_sha"], "left").where(F.col("_sha").isNull() | (F.col(order) == F.col("_first"))).select(*pages.columns)


def _topics(text: str | None) -> list[dict]:
    """Groups and topics of a welcome page's contents list, in order; a topic once."""
    root = dom.parse(text or "")
    box = dom.select_one(root, "#modal-toc-container")
    top = dom.select_one(box, "ul.toc") if box is not None else None
    out: list[dict] = []
    seen: set[str] = set()

    def add(kind: str, name: str, depth: int) -> None:
        out.append({"ord": len(out), "kind": kind, "name": name, "level": min(2 + depth, 6)})

    stack = [(top, 0, 0)] if top is not None else []
    while stack:  # depth first, without recursion
        ul, depth, at = stack.pop()
        items = [c for c in ul.children if isinstance(c, dom.Node) and c.name == "li"]
        if at >= len(items):
            continue
        stack.append((ul, depth, at + 1))
        direct = {c.name: c for c in reversed(items[at].children) if isinstance(c, dom.Node)}
        link, button, inner = direct.get("a"), direct.get("button"), direct.get("ul")
        refs = [link.attrs.get(k, "") for k in ("href", "data-ajax-endpoint")] if link is not None else []
        slug = next((m.group(1) for r in refs if (m := re.search(APPLE_TOPIC, r))), None)
        if slug and slug not in seen:
            seen.add(slug)
            add("topic", slug, depth)
        elif inner is not None and (label := button or link) is not None and (name := " ".join(label.text().split())):
            add("group", name, depth)
        if inner is not None:
            stack.append((inner, depth + 1, 0))
    return out


def contents_tree(html: Column) -> Column:
    """Array of (ord, kind, name, level): the contents list of a guide's welcome page."""

    @F.pandas_udf("array<struct<ord:int,kind:string,name:string,level:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([_topics(t) for t in s], dtype=object)

    return run(html)


def proxied_images(html: Column) -> Column:
    """Content images of a rendered page, decoded once, in order; sizes and tokens make no second image."""
    plus = F.replace(F.coalesce(html, F.lit("")), F.lit("+"), F.lit("%2B"))
    full = F.transform(F.regexp_extract_all(plus, F.lit(IMAGE_PROXY), F.lit(1)), lambda u: F.coalesce(F.try_url_decode(u), u))
    wanted = F.filter(full, lambda u: ~u.contains("%2Ficon%2F") & u.rlike("(?:assets|uploads)%2F"))
    bare = F.transform(wanted, lambda u: F.substring_index(u, "?", 1))
    return F.filter(wanted, lambda u, k: F.array_position(bare, F.substring_index(u, "?", 1)) == k + 1)


def image_of_reference(ids: Column, images: Column) -> Column:
    """Map from the ids of file references to images.

    A left fold: each id takes the first free image whose URL holds it; the ids that are left are then paired with the
    images that are left by their rank.
    """
    pair = "struct<id:string,url:string>"
    start = F.struct(F.array().cast(f"array<{pair}>").alias("hits"), images.alias("free"))

    def take(state: Column, i: Column) -> Column:
        hit = F.get(F.filter(state["free"], lambda u: u.contains(i)), F.lit(0))
        taken = F.struct(
            F.array_append(state["hits"], F.struct(i.alias("id"), hit.alias("url"))).cast(f"array<{pair}>").alias("hits"), F.array_remove(state["free"], hit).alias("free")
        )
        return F.when(hit.isNull(), state).otherwise(taken)

    def rank_joined(state: Column) -> Column:
        rest = F.filter(ids, lambda i: ~F.exists(state["hits"], lambda h: h["id"] == i))
        pairs = F.filter(F.zip_with(rest, state["free"], lambda i, u: F.struct(i.alias("id"), u.alias("url"))), lambda p: p["id"].isNotNull() & p["url"].isNotNull())
        return F.map_from_entries(F.concat(state["hits"], pairs.cast(f"array<{pair}>")))

    return F.aggregate(ids, start, take, rank_joined)


def with_images(md: Column, images: Column, origin: Column) -> Column:
    """File references replaced by their images; those without one become absolute."""
    refs = F.regexp_extract_all(md, F.lit(f"({FILE_REFERENCE})"), F.lit(1))
    ids = F.array_distinct(F.transform(refs, lambda r: F.substring_index(r, "/", -1)))
    table = image_of_reference(ids, images)
    between = F.split(md, FILE_REFERENCE)
    target = lambda r: F.coalesce(F.element_at(table, F.substring_index(r, "/", -1)), F.concat(origin, r), F.lit(""))
    return F.array_join(F.zip_with(between, refs, lambda text, r: F.concat(text, target(r))), "")


def gitbook_page(md: Column, html: Column, origin: Column) -> Column:
    """A page's Markdown without banner and footer, its images resolved and its targets absolute; the rendered page may be NULL."""
    bare = markup.strip_agent_footer(markup.strip_index_banner(F.trim(md)))
    return markup.absolutize_root(with_images(bare, proxied_images(html), F.coalesce(origin, F.lit(""))), origin)
