"""Acquisition: from seeds and a table of responses to the pages of every source, and from these to manuals.

responses (url, final_url, status, body, etag, last_modified) stands for fetching, so that a fetch is a join.  Each content
system is one function (seeds, responses, cap) -> Found.  seeds is (source, url).  Found.pages is (source, ord, url,
title, level, body): every page that was tried, in the order of the source, with a NULL body if it is lost.  Found.flags is
(source, title, truncated, single_document, error): one row a source at most; a source without a usable index has
an error and no pages, so one bad source never fails a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom, markup, urls
from ..operators import corpus, frontier, merge
from ..operators.ordering import attempt_and_saved, capped, carried_forward, first_seen, numbered, take_while
from ..operators.routing import PATTERNS, classify, probe
from ..session import checkpointed, written
from . import archive, discover, specs, systems
from .profiles import extract_column

# Where the indexes of the systems lie, and the patterns of their addresses and links.
CLICKHELP_INDEX = "/_webHelpScripts/Master/toc_nav.js"
PALIGO_INDEX = "/js/fuzzydata.js"
ST4_INDEX = "/js/treedata.json"
MKDOCS_INDEX = "/search/search_index.json"
REPOSITORY_API = "https://api.github.com/repos/"
REPOSITORY_RAW = "https://raw.githubusercontent.com/"
SUPPORT_SITEMAP = r"^https://support\.microsoft\.com/_sitemaps/(.+)_([a-z]{2}-[a-z]{2})_(\d+)\.xml$"
SUPPORT_ARTICLE = r"(/[a-z]{2}-[a-z]{2}/office/[A-Za-z0-9._-]+)"
GUIDE_HOST = "https://helpx.adobe.com/"
GUIDE_TOPIC = r"(/guide/[A-Za-z0-9-]+/[A-Za-z0-9-]+/[0-9.]+/(?:macos|mac)/[0-9.]+)"
TOPIC_TOKEN = r"-([a-z]{2,6}[0-9a-f]{6,})$"
#: Bytes of a text body; a larger one counts as a failed fetch.
TEXT_BYTES = 25 << 20
CAPS = {p.name: p.cap for p in PATTERNS} | {"docusaurus": 1000, "hugo": 6000, "clickhelp": 5000, "paligo": 5000, "st4": 5000, "asciidoctor": 2000, "sphinx": 1000, "readthedocs": 1000}


@dataclass
class Found:
    pages: DataFrame
    flags: DataFrame


def fetched(rows: DataFrame, responses: DataFrame, url: str, most: int = TEXT_BYTES) -> DataFrame:
    """rows with _body, _final and _error: the response to the address in the column url; the body is NULL if there is an error."""
    r = responses.where("url IS NOT NULL").dropDuplicates(["url"]).select(
        F.col("url").alias("_u"), F.col("status").alias("_s"), F.coalesce("final_url", "url").alias("_final"), F.col("body").alias("_b")
    )
    error = (
        F.when(F.col("_u").isNull(), "no response").when(F.col("_s") != 200, F.concat(F.lit("HTTP "), F.col("_s").cast("string")))
        .when(F.octet_length("_b") > most, "too large").when(F.col("_b").isNull(), "no body")
    )
    out = rows.join(r, F.col(url) == F.col("_u"), "left").withColumn("_error", error)
    return out.withColumn("_body", F.when(F.col("_error").isNull(), F.col("_b"))).select(*rows.columns, "_body", F.coalesce("_final", url).alias("_final"), "_error")


def _flags(df: DataFrame, title=None, truncated=False, single=False, error=None) -> DataFrame:
    c = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return df.select("source", c(title, "string").alias("title"), F.coalesce(c(truncated, "boolean"), F.lit(False)).alias("truncated"), c(single, "boolean").alias("single_document"), c(error, "string").alias("error"))


def _pages(df: DataFrame, url: str | Column, body: Column, title: Column | None = None, level: Column | None = None) -> DataFrame:
    u = F.col(url) if isinstance(url, str) else url
    t = F.lit(None).cast("string") if title is None else title
    return df.select("source", F.col("ord").cast("bigint").alias("ord"), u.alias("url"), t.alias("title"), F.lit(1).alias("level") if level is None else level.cast("int").alias("level"), body.alias("body"))


def _read_all(listed: DataFrame, responses: DataFrame, profile: str, cap: int | None) -> tuple[DataFrame, DataFrame]:
    """The pages of a list (source, ord, url) up to the cap, extracted, and (source, truncated)."""
    kept = capped(listed, ["source"], ["ord"], cap) if cap else listed.withColumn("truncated", F.lit(False))
    got = fetched(kept, responses, "url")
    cut = kept.groupBy("source").agg(F.bool_or("truncated").alias("_cut"))
    return _pages(got, "url", extract_column(F.col("_body"), F.col("_final"), profile)), cut


def _indexed(index: DataFrame, listed: DataFrame, responses: DataFrame, profile: str, cap: int | None, title=None, truncated=None) -> Found:
    """A source whose index lists its pages; without a response to the index, or with an empty list, it has an error."""
    pages, cut = _read_all(listed, responses, profile, cap)
    both = index.join(cut, "source", "left")
    error = F.when(F.col("_error").isNotNull(), F.concat(F.lit("index: "), F.col("_error"))).when(F.col("_cut").isNull(), "the index lists no page")
    out = F.coalesce(F.col("_cut"), F.lit(False))
    return Found(pages, _flags(both, title, out | truncated if truncated is not None else out, False, error))


def _index(seeds: DataFrame, responses: DataFrame, address: Column) -> DataFrame:
    return fetched(seeds.withColumn("_index", address), responses, "_index")


def _origin(url: Column) -> Column:
    return F.concat(urls.scheme(url), F.lit("://"), urls.netloc(url))


def _bare(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def links_of(html: Column, page_url: Column, selector: str = "a") -> Column:
    """Addresses of the links of a page, absolute and without fragments, in order; selector: a, or the list they stand in."""

    def one(text: str | None, base: str | None) -> list[str]:
        root = dom.parse(text or "")
        if selector != "a":
            boxes = dom.select(root, selector)
            inside = {id(a): a for box in boxes for a in box.walk() if a.name == "a"}
            anchors = list(inside.values())
        else:
            anchors = dom.select(root, "a")
        out = []
        for a in anchors:
            if href := a.attrs.get("href", ""):
                try:
                    out.append(urldefrag(urljoin(base or "", href)).url)
                except ValueError:
                    continue
        return out

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([one(t, u) for t, u in zip(a, b)], dtype=object)

    return run(html, page_url)


# Sources with an index.


def docusaurus(seeds: DataFrame, responses: DataFrame, cap: int) -> Found:
    index = _index(seeds, responses, F.concat(_origin(F.col("url")), F.lit("/sitemap.xml")))
    listed = discover.docusaurus_pages(index.select("source", "_body", _bare(F.col("url")).alias("_at")), "_body", F.col("_at"), ["source"])
    return _indexed(index, listed, responses, "docusaurus", cap)


def hugo(seeds: DataFrame, responses: DataFrame, cap: int) -> Found:
    """The deepest sitemap above the seed; an index of sitemaps is replaced by their pages, and one that is missing cuts the source."""
    base = seeds.select("source", "url", F.regexp_replace(urls.base_dir(F.col("url"), any_dot=True), "/+$", "").alias("_at"))
    tried = fetched(discover.ancestor_sitemaps(base, "_at", ["source"]), responses, "candidate").withColumn("_kind", discover.sitemap_kind(F.col("_body")))
    best = tried.where("_kind IS NOT NULL").groupBy("source").agg(F.max(F.struct("depth", "_kind", "_body")).alias("m"))
    best = base.join(best, "source", "left").select("source", "_at", F.col("m._kind").alias("_kind"), F.col("m._body").alias("_body"))
    whole = best.where("_kind = 'urlset'").select("source", "_at", F.lit(0).alias("_n"), "_body")
    children = discover.sitemap_locs(best.where("_kind = 'index'"), "_body", ["source", "_at"]).withColumnRenamed("ord", "_n").withColumnRenamed("url", "_child")
    children = fetched(children, responses, "_child").withColumn("_body", F.when(discover.sitemap_kind(F.col("_body")).isNotNull(), F.col("_body")))
    missing = children.groupBy("source").agg(F.bool_or(F.col("_body").isNull()).alias("_missing"))
    read = whole.unionByName(children.select("source", "_at", "_n", "_body"))
    listed = discover.hugo_pages(read, "_body", F.col("_at"), ["source", "_n"])
    listed = numbered(listed, ["source"], ["_n", "ord"], "_o").select("source", F.col("_o").alias("ord"), "url")
    index = best.join(missing, "source", "left").withColumn("_error", F.when(F.col("_kind").isNull(), "no sitemap"))
    return _indexed(index, listed, responses, "hugo", cap, None, F.coalesce("_missing", F.lit(False)))


def clickhelp(seeds: DataFrame, responses: DataFrame, cap: int) -> Found:
    root = seeds.withColumn("_root", systems.clickhelp_root(F.col("url")))
    index = _index(root, responses, F.concat("_root", F.lit(CLICKHELP_INDEX)))
    listed = discover.clickhelp_topics(index, "_body", ["source", "_root"])
    return _indexed(index, listed.select("source", "ord", F.concat("_root", F.lit("/HTML/"), "topic", F.lit(".html")).alias("url")), responses, "clickhelp", cap)


def paligo(seeds: DataFrame, responses: DataFrame, cap: int) -> Found:
    home = fetched(seeds, responses, "url").select("source", "url", systems.paligo_base(F.col("url"), F.coalesce("_body", F.lit(""))).alias("_root"))
    index = _index(home, responses, F.concat("_root", F.lit(PALIGO_INDEX)))
    listed = discover.paligo_pages(index, "_body", ["source", "_root"])
    return _indexed(index, listed.select("source", "ord", F.concat("_root", F.lit("/"), "page").alias("url")), responses, "paligo", cap)


def st4(seeds: DataFrame, responses: DataFrame, cap: int) -> Found:
    """Leaves of the topic tree; the titles of branches go to the next leaf that is saved; the cap counts saved leaves."""
    root = seeds.withColumn("_root", urls.base_dir(F.col("url")))
    index = _index(root, responses, F.concat("_root", F.lit(ST4_INDEX)))
    topics = index.select("source", "_root", F.inline(discover.topic_tree(F.col("_body"))))
    got = fetched(topics.withColumn("_page", F.when(F.col("kind") == "leaf", F.concat("_root", F.lit("/"), "href"))), responses, "_page")
    level = F.least(F.col("depth") + 1, F.lit(6))
    got = got.withColumn("_html", extract_column(F.col("_body"), F.col("_final"), "st4", F.col("depth")))
    head = F.concat(F.lit("<h"), level.cast("string"), F.lit(">"), markup.escape(F.col("text")), F.lit("</h"), level.cast("string"), F.lit(">"))
    got = checkpointed(got.select("source", "ord", "kind", "_page", "_html", head.alias("_head")))
    leaves = attempt_and_saved(got.where("kind = 'leaf'"), ["source"], ["ord"], F.col("_html").isNotNull())
    full = leaves.where(F.col("saved") == cap - 1).groupBy("source").agg(F.min("ord").alias("_stop"))
    used = got.join(full, "source", "left").where(F.col("_stop").isNull() | (F.col("ord") <= F.col("_stop")))
    heads = carried_forward(used, ["source"], "ord", F.col("kind") == "leaf", F.col("_html").isNotNull(), "_head")
    body = F.when(F.col("_html").isNotNull(), F.concat(F.array_join(F.coalesce("headings", F.array().cast("array<string>")), ""), F.lit("\n"), "_html"))
    pages = used.where("kind = 'leaf'").join(heads, ["source", "ord"], "left")
    many = leaves.groupBy("source").agg((F.count("*") > cap).alias("_cut"))
    both = index.join(many, "source", "left")
    error = F.when(F.col("_error").isNotNull(), F.concat(F.lit("index: "), F.col("_error"))).when(F.col("_cut").isNull(), "the index lists no page")
    return Found(_pages(pages, "_page", body), _flags(both, systems.st4_title(F.col("_body")), F.col("_cut"), False, error))


def adobe_helpx(seeds: DataFrame, responses: DataFrame, cap: int) -> Found:
    product = F.get(urls.segments(F.col("url")), F.lit(0))
    index = _index(seeds.withColumn("_product", product), responses, F.concat(F.lit(GUIDE_HOST), product, F.lit("/user-guide.html")))
    links = links_of(F.col("_body"), F.col("_final"), "ul.tocList")
    found = index.select("source", "_product", F.posexplode(links).alias("ord", "url"))
    path = urls.path(F.col("url"))
    denied = F.lit(False)
    for d in discover.ADOBE_DENY:
        denied = denied | path.contains(d)
    found = found.where(path.endswith(".html") & path.startswith(F.concat(F.lit("/"), "_product", F.lit("/"))) & ~denied)
    return _indexed(index, first_seen(found.select("source", "ord", "url"), ["source", "url"], ["ord"]), responses, "adobe_helpx", cap)


def microsoft_support(seeds: DataFrame, responses: DataFrame, cap: int) -> Found:
    """Articles of the product's numbered sitemaps up to the first that is missing, else of the links of the hub page.

    A sitemap that is missing for another reason than 404 cuts the source; title-less shells are dropped, not lost.
    """
    locale = F.regexp_extract(urls.path(F.col("url")), r"/([a-z]{2}-[a-z]{2})(?:/|$)", 1)
    own = F.filter(urls.segments(F.col("url")), lambda s: ~s.rlike(r"^[a-z]{2}-[a-z]{2}$"))
    named = seeds.withColumn("_product", F.coalesce(F.get(own, F.size(own) - 1), F.lit("microsoft"))).withColumn("_locale", F.when(locale != "", locale).otherwise("en-us"))
    maps = responses.where(F.col("url").rlike(SUPPORT_SITEMAP)).dropDuplicates(["url"]).select(
        F.regexp_extract("url", SUPPORT_SITEMAP, 1).alias("_product"), F.regexp_extract("url", SUPPORT_SITEMAP, 2).alias("_locale"),
        F.regexp_extract("url", SUPPORT_SITEMAP, 3).cast("int").alias("_n"), F.col("status").alias("_s"), F.col("body").alias("_xml"),
    )
    maps = named.join(maps, ["_product", "_locale"]).select("source", "_n", "_s", "_xml")
    # Only those without a gap before them count.
    maps = take_while(numbered(maps, ["source"], ["_n"], "_at"), ["source"], "_n", F.col("_n") == F.col("_at") + 1)
    good = take_while(maps, ["source"], "_n", (F.col("_s") == 200) & F.col("_xml").isNotNull())
    stop = maps.where("_s <> 200").groupBy("source").agg(F.min(F.struct("_n", "_s")).alias("m")).select("source", (F.col("m._s") != 404).alias("_aborted"))
    locs = discover.sitemap_locs(good, "_xml", ["source", "_n"])
    listed = numbered(locs, ["source"], ["_n", "ord"], "_o").select("source", F.col("_o").alias("ord"), "url")
    hub = fetched(named.join(listed.select("source").distinct(), "source", "left_anti"), responses, "url")
    links = F.transform(F.regexp_extract_all("_body", F.lit(SUPPORT_ARTICLE), F.lit(1)), lambda p: F.concat(_origin(F.col("url")), p))
    scraped = first_seen(hub.select("source", F.posexplode(links).alias("ord", "_u")).withColumnRenamed("_u", "url"), ["source", "url"], ["ord"])
    kept = capped(listed.unionByName(scraped.withColumn("ord", F.col("ord").cast("bigint"))), ["source"], ["ord"], cap)
    got = systems.support_article(fetched(kept, responses, "url"), "_body", "url")
    cut = kept.groupBy("source").agg(F.bool_or("truncated").alias("_cut")).join(stop, "source", "full_outer")
    both = seeds.join(cut, "source", "left")
    truncated = F.coalesce("_cut", F.lit(False)) | F.coalesce("_aborted", F.lit(False))
    return Found(_pages(got, "url", F.col("body"), F.col("title")), _flags(both, None, truncated, False, F.when(F.col("_cut").isNull(), "no article is listed")))


# Sources of Markdown.


def _markdown(index: DataFrame, listed: DataFrame, responses: DataFrame, cap: int | None, extra=None) -> Found:
    kept = capped(listed, ["source"], ["ord"], cap) if cap else listed.withColumn("truncated", F.lit(False))
    got = fetched(kept, responses, "url")
    cut = kept.groupBy("source").agg(F.bool_or("truncated").alias("_cut"))
    both = index.join(cut, "source", "left")
    error = F.when(F.col("_error").isNotNull(), F.concat(F.lit("index: "), F.col("_error"))).when(F.col("_cut").isNull(), "the index lists no page")
    flags = _flags(both, None, F.coalesce("_cut", F.lit(False)) | (extra if extra is not None else F.lit(False)), False, error)
    return Found(_pages(got, "url", F.col("_body")), flags)


def llms_txt(seeds: DataFrame, responses: DataFrame, cap: int) -> Found:
    """Pages of the index; a seed that is no index itself is the section that is wanted."""
    bare = _bare(F.col("url"))
    whole = bare.endswith("llms.txt") | bare.endswith("llms-full.txt")
    named = seeds.withColumn("_section", F.when(~whole, bare))
    index = _index(named, responses, F.when(whole, bare).otherwise(F.concat(_origin(F.col("url")), F.lit("/llms.txt"))))
    out = _markdown(index, discover.llms_pages(index, "_body", ["source"], "_section"), responses, cap)
    return Found(out.pages.withColumn("body", markup.strip_index_banner(F.col("body"))), out.flags)


def gitbook(seeds: DataFrame, responses: DataFrame, cap: int | None = None) -> Found:
    """Pages of the index; a rendered page that is missing only leaves its images unresolved."""
    index = _index(seeds, responses, F.concat(_bare(F.col("url")), F.lit("/llms.txt")))
    listed = discover.llms_pages(index.withColumn("_origin", _origin(F.col("url"))), "_body", ["source", "_origin"], pattern=discover.GITBOOK_URL)
    got = fetched(listed, responses, "url").select(*listed.columns, F.col("_body").alias("_md"))
    got = fetched(got.withColumn("_page", F.regexp_replace("url", r"\.md$", "")), responses, "_page")
    count = listed.groupBy("source").agg(F.count("*").alias("_n"))
    error = F.when(F.col("_error").isNotNull(), F.concat(F.lit("index: "), F.col("_error"))).when(F.col("_n").isNull(), "the index lists no page")
    return Found(_pages(got, "url", systems.gitbook_page(F.col("_md"), F.col("_body"), F.col("_origin"))), _flags(index.join(count, "source", "left"), error=error))


def github_markdown(seeds: DataFrame, responses: DataFrame, cap: int) -> Found:
    """Markdown files of a listing, those of its table of contents first; a listing that was cut short cuts the source."""
    r = urls.repository(F.col("url"))
    named = seeds.select("source", "url", r["owner"].alias("_owner"), r["repo"].alias("_repo"), r["branch"].alias("_branch"), _bare(r["subdir"]).alias("_sub"))
    path = F.concat("_owner", F.lit("/"), "_repo")
    main = fetched(named.where("_branch IS NULL").withColumn("_api", F.concat(F.lit(REPOSITORY_API), path)), responses, "_api")
    default = F.coalesce(F.get_json_object("_body", "$.default_branch"), F.lit("main"))
    named = named.where("_branch IS NOT NULL").unionByName(main.withColumn("_branch", default).select(*named.columns))
    index = _index(named, responses, F.concat(F.lit(REPOSITORY_API), path, F.lit("/git/trees/"), "_branch", F.lit("?recursive=1")))
    index = index.withColumn("_raw", F.concat(F.lit(REPOSITORY_RAW), path, F.lit("/"), "_branch", F.lit("/")))
    tree = F.from_json("_body", "struct<tree:array<struct<path:string,type:string>>,truncated:boolean>")
    files = index.select("source", "_raw", "_sub", F.explode(tree["tree"]).alias("f")).select("source", "_raw", "_sub", "f.*")
    files = files.where((F.col("_sub") == "") | F.col("path").startswith(F.concat("_sub", F.lit("/"))))
    toc = files.where("path = 'documentation.md' AND type = 'blob'").select("source", F.concat("_raw", "path").alias("_toc"))
    toc = fetched(toc, responses, "_toc").select("source", F.col("_body").alias("body"))
    listed = discover.repository_pages(files, toc, ["source"]).join(index.select("source", "_raw"), "source")
    return _markdown(index, listed.select("source", "ord", F.concat("_raw", "path").alias("url")), responses, cap, F.coalesce(tree["truncated"], F.lit(False)))


def mkdocs(seeds: DataFrame, responses: DataFrame, cap: int | None = None) -> Found:
    """The pages of a search index; those without any text are skipped."""
    index = _index(seeds, responses, F.concat(_bare(F.col("url")), F.lit(MKDOCS_INDEX)))
    base = F.regexp_replace("_final", "/search/search_index.json$", "")
    pages = discover.mkdocs_bodies(index.withColumn("_at", base), "_body", ["source", "_at"])
    pages = pages.where(F.length(F.trim("body")) > 0)
    count = pages.groupBy("source").agg(F.count("*").alias("_n"))
    error = F.when(F.col("_error").isNotNull(), F.concat(F.lit("index: "), F.col("_error"))).when(F.col("_n").isNull(), "no search index")
    return Found(_pages(pages, F.concat("_at", F.lit("/"), "path"), F.col("body")), _flags(index.join(count, "source", "left"), error=error))


# Sources of one document or one interface.


def wordpress(seeds: DataFrame, responses: DataFrame, cap: int | None = None) -> Found:
    home = fetched(seeds, responses, "url")
    rest = F.regexp_extract("_body", r'(?i)<link[^>]+rel="alternate"[^>]+type="application/json"[^>]+href="([^"]+)"', 1)
    post = fetched(home.select("source", "url", markup.unescape_basic(rest).alias("_rest")), responses, "_rest")
    p = F.from_json("_body", "struct<slug:string,title:struct<rendered:string>,content:struct<rendered:string>>")
    post = post.withColumn("_clean", extract_column(F.coalesce(p["content"]["rendered"], F.lit("")), F.col("url"), "wordpress"))
    post = post.withColumn("_clean", F.when(F.length(markup.visible_text(F.col("_clean"))) > 0, F.col("_clean")))
    error = F.when(F.coalesce("_rest", F.lit("")) == "", "no REST link").when(F.col("_error").isNotNull(), F.concat(F.lit("post: "), F.col("_error"))).when(F.col("_clean").isNull(), "the post is empty")
    return Found(_pages(post.where("_clean IS NOT NULL").withColumn("ord", F.lit(0)), "url", F.col("_clean")), _flags(post, markup.unescape_basic(p["title"]["rendered"]), False, True, error))


def zendesk_help(seeds: DataFrame, responses: DataFrame, cap: int) -> Found:
    """Articles of an API, followed from response to response; the cap counts responses."""
    api = responses.where(F.col("url").contains("/api/v2/help_center/") & (F.col("status") == 200)).dropDuplicates(["url"])
    steps = api.select("url", F.get_json_object("body", "$.next_page").alias("_next"))
    start = seeds.select("source", "url", discover.zendesk_endpoint(F.col("url")).alias("node"))
    # The chain is one of addresses, the same for all sources that come by; so it is walked within its host.
    host = seeds.select("source", _origin(F.col("url")).alias("_host"))
    edges = steps.where("_next IS NOT NULL").select(_origin(F.col("url")).alias("_host"), F.col("url").alias("src"), F.col("_next").alias("dst"), F.lit(0).alias("pos")).join(host, "_host")
    walked = frontier.chain(edges.select("source", "src", "dst", "pos"), start.select("source", "node"), cap)
    got = fetched(walked, responses, "node")
    articles = discover.zendesk_articles(got.select("source", F.col("ord").alias("_n"), "_body"), "_body", ["source", "_n"])
    articles = numbered(articles, ["source"], ["_n", "ord"], "_o").drop("ord").withColumnRenamed("_o", "ord")
    body = F.coalesce(extract_column(F.coalesce("body", F.lit("")), F.coalesce("html_url", F.lit("")), "zendesk_help"), F.lit(""))
    state = got.groupBy("source").agg(F.bool_or("truncated").alias("_cut"), F.min("_error").alias("_bad"))
    flags = seeds.join(state, "source", "left")
    single = urls.path(F.col("url")).rlike(r"/articles/\d+")
    bad = F.when(F.col("_bad").isNotNull(), F.concat(F.lit("index: "), F.col("_bad")))
    pages = _pages(articles, F.coalesce("html_url", F.lit("")), body, F.coalesce("title", F.lit("")))
    return Found(pages.join(flags.where("_bad IS NOT NULL").select("source"), "source", "left_anti"), _flags(flags, None, F.col("_cut"), single, bad))


def pdf_url(seeds: DataFrame, responses: DataFrame, cap: int | None = None) -> Found:
    """One body that must be a PDF; it is passed on as it is."""
    got = fetched(seeds, responses, "url", 250 << 20)
    is_pdf = F.left("_body", F.lit(1024)).contains("%PDF-")
    error = F.coalesce("_error", F.when(~is_pdf, F.lit("not a PDF")))
    return Found(_pages(got.where(is_pdf).withColumn("ord", F.lit(0)), "url", F.col("_body")), _flags(got, error=error))


def readthedocs(seeds: DataFrame, responses: DataFrame, cap: int) -> Found:
    """The PDF build of a project; if there is none (404), its pages are crawled."""
    at = systems.language_and_version(F.col("url"))
    origin = _origin(F.col("url"))
    build = F.concat(origin, F.lit("/_/downloads/"), at["language"], F.lit("/"), at["version"], F.lit("/pdf/"))
    tried = fetched(seeds.withColumn("_pdf", build).withColumn("_home", F.concat(origin, F.lit("/"), at["language"], F.lit("/"), at["version"], F.lit("/"))), responses, "_pdf")
    tried = checkpointed(tried)
    none = F.coalesce(F.col("_error").isin("HTTP 404", "no response"), F.lit(False))
    a = pdf_url(tried.where(~none).select("source", F.col("_pdf").alias("url")), responses)
    b = sphinx(tried.where(none).select("source", F.col("_home").alias("url")), responses, cap)
    return Found(a.pages.unionByName(b.pages), a.flags.unionByName(b.flags))


def api_spec(seeds: DataFrame, responses: DataFrame, cap: int | None = None) -> Found:
    got = fetched(seeds, responses, "url")
    made = specs.rendered(got.select("source", "_body"), "source", "_body")
    both = got.join(made, "source")
    error = F.coalesce("_error", F.when(F.col("format").isNull(), F.lit("neither OpenAPI nor Postman")))
    return Found(_pages(both.where("content IS NOT NULL").withColumn("ord", F.lit(0)), "url", F.col("content")), _flags(both, F.col("title"), False, False, error))


def archive_download(seeds: DataFrame, responses: DataFrame, cap: int | None = None) -> Found:
    """Members of an archive in reading order; responses holds it in the column data (binary)."""
    r = responses.where("status = 200").dropDuplicates(["url"]).select("url", "data")
    got = seeds.join(r, "url", "left")
    members = checkpointed(archive.members(got.where("data IS NOT NULL")))
    order = archive.reading_order(members)
    body = F.when(F.col("kind") == "html", extract_column(F.col("text"), F.lit(""), "archive")).otherwise(F.col("text"))
    bad = members.where("error IS NOT NULL").groupBy("source").agg(F.min("error").alias("_bad"))
    flags = got.join(bad, "source", "left")
    error = F.when(F.col("data").isNull(), "no response").otherwise(F.col("_bad"))
    return Found(_pages(order, "member", body), _flags(flags, error=error))


# Crawls.


def _crawled(seeds: DataFrame, edges: DataFrame, pages: DataFrame, cap: int, choose: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """What a crawl that stops at cap saved pages tries, in its order, and (source, truncated).

    seeds is (source, node), edges (source, src, dst, pos), pages (source, node, ..., ok); choose drops what is neither
    saved nor lost.  The order of a crawl does not depend on its cap, so it is the beginning of that of the whole one; a
    page after it means that it was cut.
    """
    walked = frontier.crawl(edges, seeds)
    tried = walked.select("source", "node", "ord").join(pages, ["source", "node"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    tried = choose(tried) if choose else tried
    tried = checkpointed(attempt_and_saved(tried, ["source"], ["ord"], F.col("ok")))
    full = tried.where(F.col("saved") == cap - 1).groupBy("source").agg(F.min("ord").alias("_stop"))
    both = tried.join(full, "source", "left")
    cut = both.groupBy("source").agg(F.coalesce(F.max("ord") > F.max("_stop"), F.lit(False)).alias("_cut"))
    return both.where(F.col("_stop").isNull() | (F.col("ord") <= F.col("_stop"))).drop("_stop", "attempt"), cut


def _of_hosts(seeds: DataFrame, responses: DataFrame) -> DataFrame:
    """(source, _base, url, _final, _body, _status): the responses of the hosts of the sources; seeds is (source, _base)."""
    own = seeds.select("source", "_base", urls.netloc(F.col("_base")).alias("_host"))
    r = responses.where("url IS NOT NULL").dropDuplicates(["url"])
    r = r.select("url", F.coalesce("final_url", "url").alias("_final"), F.when((F.col("status") == 200) & (F.octet_length("body") <= TEXT_BYTES), F.col("body")).alias("_body"), F.col("status").alias("_status"))
    return r.withColumn("_host", urls.netloc(F.col("url"))).join(own, "_host").drop("_host")


def _version() -> Column:
    """Tells the responses to one address apart."""
    return F.xxhash64("status", "final_url", "body")


def _answers(hosts: DataFrame, responses: DataFrame, **read: Callable[[Column, Column], Column]) -> DataFrame:
    """(_host, url, _final, _v, _ok, ...): one row for each address of these hosts, without its body; hosts is (_host).

    read makes columns of the body (NULL unless _ok) and the final address.  Of several responses the one with the least _v
    counts, so that _bodies() can find it again.  A row is made once, however many sources are on its host.
    """
    own = hosts.where("_host IS NOT NULL").distinct()
    r = responses.where("url IS NOT NULL").withColumn("_host", urls.netloc(F.col("url")))
    if own.count() <= frontier.BROADCAST_ROUND:  # else those of other hosts are read in vain
        r = r.join(F.broadcast(own), "_host", "left_semi")
    r = r.withColumn("_v", _version()).withColumn("_final", F.coalesce("final_url", "url"))
    r = r.withColumn("_ok", F.coalesce((F.col("status") == 200) & (F.octet_length("body") <= TEXT_BYTES), F.lit(False)))
    body = F.when(F.col("_ok"), F.col("body"))
    r = r.select("_host", "url", "_final", "_v", "_ok", *[make(body, F.col("_final")).alias(name) for name, make in read.items()])
    return checkpointed(first_seen(r, ["_host", "url"], ["_v"]))


def _bodies(rows: DataFrame, responses: DataFrame) -> DataFrame:
    """rows with _body: that of the response (url, _v), NULL without one."""
    r = responses.where("url IS NOT NULL").select(F.col("url").alias("_u"), _version().alias("_w"), F.col("body").alias("_body"))
    wanted = rows.where("url IS NOT NULL AND _v IS NOT NULL").select(F.col("url").alias("_u"), F.col("_v").alias("_w")).distinct()
    if wanted.count() <= frontier.BROADCAST_ROUND:
        r = r.join(F.broadcast(wanted), ["_u", "_w"], "left_semi")
    r = r.dropDuplicates(["_u", "_w"])
    return rows.join(r, (F.col("url") == F.col("_u")) & (F.col("_v") == F.col("_w")), "left").drop("_u", "_w")


def sphinx(seeds: DataFrame, responses: DataFrame, cap: int) -> Found:
    last = urls.last_segment(F.col("url"))
    base = F.concat(_bare(F.when(last.endswith(".html"), F.regexp_replace("url", r"/[^/]*$", "")).otherwise(F.col("url"))), F.lit("/"))
    own = seeds.select("source", base.alias("_base"))
    all_pages = _of_hosts(own, responses).where(F.col("url").startswith(F.col("_base")))
    read = all_pages.select("source", "_base", F.col("url").alias("node"), "url", extract_column(F.col("_body"), F.col("_final"), "sphinx").alias("body"), links_of(F.col("_body"), F.col("_final")).alias("_links"))
    read = checkpointed(read.withColumn("ok", F.col("body").isNotNull()))
    edges = read.select("source", "_base", F.col("node").alias("src"), F.posexplode("_links").alias("pos", "dst"))
    edges = edges.where(discover.sphinx_wanted(F.col("dst"), F.col("_base"))).drop("_base")
    tried, cut = _crawled(own.select("source", F.col("_base").alias("node")), edges, read.select("source", "node", "body", "ok"), cap)
    home = fetched(own, responses, "_base")
    flags = home.join(cut, "source", "left")
    return Found(_pages(tried, "node", F.col("body")), _flags(flags, markup.page_title(F.col("_body")), F.col("_cut")))


def asciidoctor(seeds: DataFrame, responses: DataFrame, cap: int) -> Found:
    """HTML files of the folder that the seed leads to; one that is not there (404), lies elsewhere or repeats another's content
    is neither saved nor lost."""
    is_file = urls.names_a_file(_bare(F.col("url")))
    start = fetched(seeds.select("source", F.when(is_file, F.col("url")).otherwise(F.concat(_bare(F.col("url")), F.lit("/"))).alias("url")), responses, "url")
    start = checkpointed(start.withColumn("_base", urls.base_dir(F.col("_final"))))
    own = start.where("_body IS NOT NULL").select("source", "_base", F.col("_final").alias("node"), F.col("url").alias("_first"))
    all_pages = _of_hosts(own, responses).join(own.select("source", "_first", F.col("node").alias("_entry")), "source")
    inside = urls.base_dir(F.col("_final")) == F.col("_base")
    node = F.when(F.col("url") == F.col("_first"), F.col("_entry")).otherwise(F.col("url"))
    read = all_pages.where(F.col("url").startswith(F.col("_base"))).select(
        "source", "_base", node.alias("node"), inside.alias("_in"), "_status", F.when(inside, extract_column(F.col("_body"), F.col("_final"), "asciidoctor")).alias("body"),
        F.when(inside, links_of(F.col("_body"), F.col("_final"))).alias("_links"),
    )
    read = checkpointed(read.dropDuplicates(["source", "node"]))
    edges = read.select("source", "_base", F.col("node").alias("src"), F.posexplode("_links").alias("pos", "dst"))
    wanted = F.lower(urls.path(F.col("dst"))).endswith(".html") & (urls.base_dir(F.col("dst")) == F.col("_base"))
    pages = read.select("source", "node", "_in", "_status", "body", F.col("body").isNotNull().alias("ok"))
    there = "ok OR (_status IS NOT NULL AND _status <> 404 AND (_status <> 200 OR _in))"
    kept, cut = _crawled(own.select("source", "node"), edges.where(wanted).drop("_base"), pages, cap, lambda x: systems.unaliased(x.where(there), ["source"], "ord", "body"))
    flags = start.join(cut, "source", "left")
    return Found(_pages(kept, "node", F.col("body")), _flags(flags, markup.page_title(F.col("_body")), F.col("_cut"), False, F.col("_error")))


def page_id(url: Column) -> Column:
    """Third segment of a guide's address, which names its topic."""
    return F.coalesce(F.get(urls.segments(url), F.lit(2)), F.lit("welcome"))


def topic_key(url: Column) -> Column:
    """What tells topics apart: the token at the end of the topic's name, or the name if it has none."""
    token = F.regexp_extract(page_id(url), TOPIC_TOKEN, 1)
    return F.when(token != "", token).otherwise(page_id(url))


def apple_help(seeds: DataFrame, responses: DataFrame, cap: int) -> Found:
    """Topics of a guide, found in the text of its pages, in the order and with the levels of the welcome page's contents.

    Pages are told apart by the token of their topic after redirects; what the contents lack follows by name at level 2.
    Groups of the contents are rows of their own without an address; the pages that count are the topics.
    """
    platform = F.when(F.array_contains(urls.segments(F.col("url")), "macos"), "macos").otherwise("mac")
    own = seeds.select("source", F.col("url").alias("_base"), urls.netloc(F.col("url")).alias("_host"), urls.slug_from_topic(F.col("url"), "guide").alias("_guide"), platform.alias("_platform"))
    links = lambda body, final: F.transform(F.regexp_extract_all(body, F.lit(GUIDE_TOPIC), F.lit(1)), lambda p: F.concat(_origin(final), p))
    answers = _answers(own.select("_host"), responses, _links=links)
    # All guides are on one host, so pages meet their sources by guide and platform, too.
    on = F.filter(F.array(F.lit("macos"), F.lit("mac")), lambda p: F.array_contains(urls.segments(F.col("_final")), p))
    mine = answers.where("_ok").withColumn("_guide", urls.slug_from_topic(F.col("_final"), "guide")).withColumn("_platform", F.explode(on)).join(own, ["_host", "_guide", "_platform"])
    first = answers.where("_ok").drop("_host").join(own, F.col("url") == F.col("_base"))
    columns = ["source", "_base", "_guide", "_platform", "url", "_final", "_v", "_links"]
    rank = F.when(F.col("url") == F.col("_base"), 0).otherwise(1)
    read = mine.select(*columns).unionByName(first.select(*columns)).select("source", "_guide", "_platform", topic_key(F.col("_final")).alias("node"), page_id(F.col("_final")).alias("page"), rank.alias("_rank"), "url", "_v", "_links")
    read = checkpointed(first_seen(read, ["source", "node"], ["_rank", "url"]))
    edges = read.select("source", "_guide", "_platform", F.col("node").alias("src"), F.posexplode("_links").alias("pos", "_u"))
    within = (urls.slug_from_topic(F.col("_u"), "guide") == F.col("_guide")) & F.array_contains(urls.segments(F.col("_u")), F.col("_platform"))
    edges = edges.where(within & (topic_key(F.col("_u")) != "welcome")).select("source", "src", topic_key(F.col("_u")).alias("dst"), "pos")
    home = own.join(answers.select(F.col("url").alias("_base"), "_final", F.when(F.col("_ok"), F.col("_v")).alias("_v")), "_base", "left")
    home = _bodies(home.select("source", "_guide", F.col("_base").alias("url"), F.coalesce("_final", "_base").alias("_final"), "_v"), responses)
    h1 = F.trim(markup.visible_text(F.regexp_extract("_body", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)))
    title = F.when(h1 != "", markup.unescape_basic(h1)).otherwise(F.initcap(F.replace("_guide", F.lit("-"), F.lit(" "))))
    home = checkpointed(home.select("source", "_final", title.alias("_title"), systems.contents_tree(F.col("_body")).alias("_items")))
    start = home.select("source", topic_key(F.col("_final")).alias("node"))
    tried, cut = _crawled(start, edges, read.select("source", "node", "page", "url", "_v", F.lit(True).alias("ok")), cap)
    saved = tried.where("ok AND page <> 'welcome'").select("source", "page", "url", "_v")
    items = home.select("source", F.explode("_items").alias("i")).select("source", "i.*")
    toc = items.where("kind = 'topic'").select("source", F.col("name").alias("page"), "ord", "level")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    topics = saved.join(toc, ["source", "page"], "left")
    topics = topics.select("source", F.coalesce("ord", F.lit(1 << 30)).alias("_at"), "page", "url", "_v", F.coalesce("level", F.lit(2)).alias("level"), none("_head", "string"))
    gone = tried.where("NOT ok").select("source", F.lit((1 << 30) + 1).alias("_at"), F.col("node").alias("page"), none("url", "string"), none("_v", "bigint"), F.lit(2).alias("level"), none("_head", "string"))
    head = F.concat(F.lit("<h"), F.col("level").cast("string"), F.lit(">"), markup.escape(F.col("name")), F.lit("</h"), F.col("level").cast("string"), F.lit(">"))
    heads = items.where("kind = 'group'").select("source", F.col("ord").alias("_at"), F.lit("").alias("page"), none("url", "string"), none("_v", "bigint"), "level", head.alias("_head"))
    heads = heads.join(saved.select("source").distinct(), "source", "left_semi")
    # Bodies come last, for the pages that are in the manual, and are read once.
    out = _bodies(checkpointed(numbered(topics.unionByName(gone).unionByName(heads), ["source"], ["_at", "page"])), responses)
    body = F.coalesce("_head", extract_column(F.col("_body"), F.coalesce("url", F.lit("")), "apple_help", F.col("level")))
    pages = written(_pages(out, "url", body, None, F.col("level")), "guides")
    return Found(pages, _flags(home.join(cut, "source", "left"), F.col("_title"), F.col("_cut")))


def openstax(seeds: DataFrame, responses: DataFrame, cap: int) -> Found:
    """The chain of pages from the first one that the links back lead to; a next page that is missing cuts the source."""
    origin = _origin(F.col("url"))
    book = F.coalesce(F.nullif(urls.slug_from_topic(F.col("url"), "books"), F.lit("")), urls.last_segment(F.col("url")))
    start = seeds.select("source", F.when(urls.path(F.col("url")).contains("/pages/"), F.col("url")).otherwise(F.concat(origin, F.lit("/books/"), book, F.lit("/pages/preface"))).alias("_base"))
    start = start.withColumn("_host", urls.netloc(F.col("_base")))
    label = lambda name: lambda body, _: F.get(links_of(F.regexp_extract(body, rf'(?is)(<a\b[^>]*aria-label="{name}"[^>]*>)', 1), F.col("url")), F.lit(0))
    # All books are on one host, so its links are kept once, and only the pages of a walk are read as a whole.
    answers = _answers(start.select("_host"), responses, _prev=label("Previous Page"), _next=label("Next Page")).where("_ok")
    link = lambda c: answers.where(F.col(c).isNotNull()).select("_host", F.col("url").alias("src"), F.col(c).alias("dst"), F.lit(0).alias("pos"))
    hosts = start.select("source", "_host")
    back = frontier.chain(link("_prev"), start.select("source", "_host", F.col("_base").alias("node")), cap + 1, "_host")
    head = back.groupBy("source").agg(F.max(F.struct("ord", "node")).alias("m")).select("source", F.col("m.node").alias("node"))
    walked = frontier.chain(link("_next"), checkpointed(head.join(hosts, "source")), cap, "_host")
    known = answers.select("_host", F.col("url").alias("node"), "_v", F.lit(True).alias("_known"))
    got = walked.join(hosts, "source").join(known, ["_host", "node"], "left").select("source", "ord", F.col("node").alias("url"), "truncated", "_v", "_known")
    got = _bodies(checkpointed(got), responses)
    got = got.withColumn("body", extract_column(F.col("_body"), F.col("url"), "openstax")).withColumn("title", systems.book_title(F.col("_body")))
    got = written(got.drop("_body", "_v"), "books")
    # A dead link strands what follows: the source is cut, and the page that did not answer is no page.
    flags = got.groupBy("source").agg((F.bool_or("truncated") | F.bool_or(F.col("_known").isNull())).alias("_cut"), F.min(F.when(F.col("ord") == 0, F.struct("ord", "title")))["title"].alias("_title"))
    pages = got.where("_known")
    none = pages.groupBy("source").agg(F.count("*").alias("_n"))
    both = start.join(flags, "source", "left").join(none, "source", "left")
    return Found(_pages(pages, "url", F.col("body")), _flags(both, F.col("_title"), F.col("_cut"), False, F.when(F.col("_n").isNull(), "no first page")))


System = Callable[[DataFrame, DataFrame, int], Found]
#: How each content system is acquired, and the kind of its deliverable (NULL: as found).
SYSTEMS: dict[str, tuple[System, str | None]] = {
    "apple_help": (apple_help, "html"), "llms_txt": (llms_txt, "markdown"), "readthedocs": (readthedocs, None), "github_markdown": (github_markdown, "markdown"),
    "zendesk_help": (zendesk_help, "html"), "microsoft_support": (microsoft_support, "html"), "adobe_helpx": (adobe_helpx, "html"), "openstax": (openstax, "html"),
    "api_spec": (api_spec, "markdown"), "pdf_url": (pdf_url, "pdf"), "archive_download": (archive_download, None), "gitbook": (gitbook, "markdown"),
    "clickhelp": (clickhelp, "html"), "paligo": (paligo, "html"), "st4": (st4, "html"), "mkdocs": (mkdocs, "markdown"), "docusaurus": (docusaurus, "html"),
    "hugo": (hugo, "html"), "asciidoctor": (asciidoctor, "html"), "wordpress": (wordpress, "html"), "sphinx": (sphinx, "html"),
}
#: Systems whose pages get their title as a heading, whose manual has no heading of its own, and what ends its title.
TITLED = ("microsoft_support", "zendesk_help")
WITHOUT_H1 = ("clickhelp", "paligo", "st4", "docusaurus", "hugo", "asciidoctor", "wordpress", "sphinx", "readthedocs")
SUFFIX = {"microsoft_support": " Help", "zendesk_help": " Help"}


def acquired(system: str, seeds: DataFrame, responses: DataFrame, cap: int | None = None) -> Found:
    """Found of one system, with its own cap unless another is given."""
    run, _ = SYSTEMS[system]
    return run(seeds.select("source", "url"), responses, cap or CAPS.get(system))


def counters(found: Found) -> DataFrame:
    """(source, title, pages, lost, truncated, single_document, error): one row for each source of the flags."""
    n = found.pages.where("url IS NOT NULL OR body IS NULL").groupBy("source").agg(F.count("body").alias("pages"), F.count_if(F.col("body").isNull()).alias("lost"))
    out = found.flags.join(n, "source", "left")
    return out.select("source", "title", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("lost", F.lit(0)).alias("lost"), "truncated", "single_document", "error")


def section(url: Column, title: Column | None, body: Column) -> Column:
    """A raw page of HTML: its address in a comment, its title if it is told apart, and its body in a section."""
    head = F.coalesce(F.concat(F.lit("<h2>"), markup.escape(title), F.lit("</h2>\n")), F.lit("")) if title is not None else F.lit("")
    return F.concat(F.lit("<!-- source: "), F.coalesce(url, F.lit("")), F.lit(" -->\n<section>\n"), head, body, F.lit("\n</section>"))


def merged(system: str, found: Found) -> DataFrame:
    """(source, kind, content, pages): the manual of each source; a source without any saved page has no row."""
    kind = SYSTEMS[system][1]
    good = found.pages.where("body IS NOT NULL")
    if kind == "html":
        body = section(F.col("url"), F.col("title") if system in TITLED else None, F.col("body"))
        name = found.flags.select("source", F.coalesce("title", "source").alias("_t"))
        rows = good.withColumn("body", body).drop("title").join(name, "source").withColumnRenamed("_t", "title")
        out = merge.merge_html(rows, ["source"], "ord", "body", "title", system not in WITHOUT_H1, SUFFIX.get(system, ""))
    elif kind == "markdown" and system != "api_spec":
        rows = good.withColumn("body", F.concat(F.lit("<!-- source: "), "url", F.lit(" -->\n\n"), "body", F.lit("\n")))
        out = merge.merge_markdown(rows, ["source"], "ord", "body")
    else:  # what is passed on as it is
        out = merge.merge_markdown(good, ["source"], "ord", "body")
    found_kind = F.lit(kind) if kind else F.when(F.ltrim("content").startswith("%PDF-"), "pdf").otherwise("html")
    return out.select("source", found_kind.alias("kind"), "content", "pages")


def routed(seeds: DataFrame, responses: DataFrame) -> DataFrame:
    """(source, url, pattern, system, error): the pattern that takes each seed, and the content system that its page shows."""
    own = seeds.select("source", "url", classify(F.col("url")).alias("pattern"))
    probed = own.where("pattern = 'docs_probe'")
    home = fetched(probed, responses, "url").select(*own.columns, F.col("_body").alias("_home"))
    index = fetched(home.withColumn("_i", F.concat(_bare(F.col("url")), F.lit(MKDOCS_INDEX))), responses, "_i").select(*home.columns, F.col("_body").alias("_search"))
    llms = fetched(index.withColumn("_l", F.concat(_origin(F.col("url")), F.lit("/llms.txt"))), responses, "_l")
    system = probe(F.coalesce("_home", F.lit("")), F.col("_search"), F.col("_body"))
    system = F.when(system == "pdf", "pdf_url").when(system == "llms_txt", "gitbook").otherwise(system)
    error = F.when(F.col("_home").isNull(), "no response").when(system.isNull(), "no content system shows: generator, tells, search index and llms.txt were probed")
    a = llms.select(*own.columns, F.when(F.col("_home").isNotNull(), system).alias("system"), error.alias("error"))
    b = own.where("pattern <> 'docs_probe' OR pattern IS NULL")
    return a.unionByName(b.select(*own.columns, F.col("pattern").alias("system"), F.when(F.col("pattern").isNull(), "no pattern takes the address").alias("error")))


def ingested(seeds: DataFrame, responses: DataFrame, systems_wanted: list[str] | None = None) -> DataFrame:
    """(source, url, pattern, system, kind, content, title, pages, lost, truncated, single_document, error): every seed once.

    Seeds are routed, acquired by the operator of their system and merged.  What fails has an error and no content: no pattern,
    no response, no usable index, or not one saved page.
    """
    route = checkpointed(routed(seeds, responses))
    out = None
    for name in systems_wanted or SYSTEMS:
        own = route.where(F.col("system") == name)
        if own.isEmpty():
            continue
        got = acquired(name, own, responses)
        both = counters(got).join(merged(name, got).drop("pages"), "source", "left")
        out = both if out is None else out.unionByName(both)
    if out is None:
        schema = "source string, title string, pages bigint, lost bigint, truncated boolean, single_document boolean, error string, kind string, content string"
        out = seeds.sparkSession.createDataFrame([], schema)
    rows = route.withColumnRenamed("error", "_e").join(out, "source", "left")
    error = F.coalesce("_e", "error", F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, F.lit("empty output")))
    return rows.select("source", "url", "pattern", "system", "kind", F.when(error.isNull(), F.col("content")).alias("content"), "title", "pages", "lost", "truncated", "single_document", error.alias("error"))


def staged(made: DataFrame, prior: DataFrame, now: Column, tool_version: str, slug: Column | None = None, if_changed: bool = True) -> tuple[DataFrame, DataFrame]:
    """(outcomes, manifests) of ingested(): how each source ended, and the manifests of those that changed.

    slug is folded to one safe name; one that folds to nothing is an error, as is an empty output.  With if_changed a
    content with the hash of the prior manifest stays as it is.  duplicate_of is the first other slug that holds the same
    content, before or after this run.
    """
    named = made.withColumn("slug", urls.slugify(slug if slug is not None else F.col("source")))
    bad = F.coalesce("error", F.when(F.col("slug") == "", F.lit("the slug folds to nothing")))
    named = named.withColumn("error", bad).withColumn("_sha", F.when(F.col("error").isNull(), F.sha2("content", 256)))
    held = corpus.latest_manifests(prior).select("slug", F.col("sha256").alias("_old"))
    narrow = checkpointed(named.select("source", "slug", "error", "_sha"))
    holders = held.select("slug", F.col("_old").alias("sha256")).join(narrow.where("_sha IS NOT NULL").select("slug").distinct(), "slug", "left_anti")
    holders = holders.unionByName(narrow.where("_sha IS NOT NULL").select("slug", F.col("_sha").alias("sha256")))
    twin = corpus.duplicates(holders, "sha256").select("slug", F.col("first_other").alias("duplicate_of"))
    out = narrow.join(held, "slug", "left").join(twin, "slug", "left")
    same = F.coalesce(F.col("_sha") == F.col("_old"), F.lit(False)) & F.lit(if_changed)
    status = F.when(F.col("error").isNotNull(), "failed").when(same, "unchanged").otherwise("changed")
    outcomes = out.select("source", "slug", status.alias("status"), F.when(F.col("error").isNull(), F.col("duplicate_of")).alias("duplicate_of"), "error")
    fresh = named.join(outcomes.where("status = 'changed'").select("source"), "source", "left_semi")
    rows = fresh.select(F.col("url").alias("source_url"), "slug", "kind", "title", "content", F.when(F.col("kind") != "pdf", F.col("pages")).cast("int").alias("pages"), F.col("lost").cast("int").alias("lost"), "truncated", F.coalesce("single_document", F.lit(False)).alias("single_document"))
    return outcomes, corpus.build_manifests(rows, now, tool_version)
