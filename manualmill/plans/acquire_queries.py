"""Queries that acquire whole sources, from seeds and responses that are made of the deliverables.

Every HTML manual of the deliverables is a source in each content system: its sections are the pages (all of them, with
their whole text), around which stand the chrome, the index and the links of the system.  The page with a number that leaves
3 divided by 5 fails with a status, one that leaves 5 divided by 7 has no content.  The SQL states the manual that
must come out, and the counters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..session import checkpointed, written
from ..sources import acquire
from .page_queries import _C, _SECT, _VIS, _contents, _rows, pages_of

#: The cap of these queries, so that many sources reach it.
CAP = 12
_SAFE = r"""[<>&"'\]/\\|]"""

#: By system: where a source lies, the address of a page, what stands around its content and how it starts and ends.
_S = lambda base, page, open_, close, chrome="": (base, page, open_, close, chrome)
SITES = {
    "docusaurus": _S("https://{s}.example/docs", "https://{s}.example/docs/p{k}", "<article>", "</article>", "<nav>path</nav>"),
    "hugo": _S("https://{s}.example/docs/index.html", "https://{s}.example/docs/p{k}/", "<main>", "</main>", "<header>top</header>"),
    "clickhelp": _S("https://{s}.example/docs/HTML/start.html", "https://{s}.example/docs/HTML/p{k}.html", '<div id="pnlTopicContentContainer">', "</div>", '<div class="footer">f</div>'),
    "paligo": _S("https://{s}.example/m/index.html", "https://{s}.example/m/en/p{k}.html", '<article class="topic content-container">', "</article>"),
    "st4": _S("https://{s}.example/m/start.html", "https://{s}.example/m/p{k}.html", '<div class="container" role="main">', "</div>", '<ol class="breadcrumb"><li>x</li></ol>'),
    "adobe_helpx": _S("https://helpx.adobe.com/{s}/user-guide.html", "https://helpx.adobe.com/{s}/using/p{k}.html", "<main>", "</main>", '<div class="feedbackV2">f</div>'),
    "sphinx": _S("https://{s}.example/en/", "https://{s}.example/en/p{k}.html", '<div role="main">', "</div>"),
    "asciidoctor": _S("https://{s}.example/a/p0.html", "https://{s}.example/a/p{k}.html", '<div id="content">', "</div>"),
    "openstax": _S("https://openstax.org/books/{s}/pages/p{k}", "https://openstax.org/books/{s}/pages/p{k}", "", ""),
    "microsoft_support": _S("https://support.microsoft.com/en-us/{s}", "https://support.microsoft.com/en-us/office/{s}-p{k}", "", ""),
    "llms_txt": _S("https://{s}.example/docs", "https://{s}.example/docs/p{k}.md", "", ""),
    "gitbook": _S("https://{s}.gitbook.io", "https://{s}.gitbook.io/p{k}.md", "", ""),
    "github_markdown": _S("https://github.com/o/{s}/tree/main/docs", "https://raw.githubusercontent.com/o/{s}/main/docs/p{k}.md", "", ""),
    "mkdocs": _S("https://{s}.example/m", "https://{s}.example/m/p{k}/", "", ""),
    "zendesk_help": _S("https://{s}.zendesk.com/hc/en-us", "https://{s}.zendesk.com/hc/en-us/articles/p{k}", "", ""),
    "apple_help": _S("https://support.apple.com/guide/{s}/welcome/1/mac/1", "https://support.apple.com/guide/{s}/p{k}-num{k}0000000/1/mac/1", "", ""),
}
MARKDOWN = ("llms_txt", "gitbook", "github_markdown", "mkdocs")


def _url(form: str) -> Column:
    out: list[Column] = []
    for part in form.replace("{s}", "\x00s\x00").replace("{k}", "\x00k\x00").split("\x00"):
        out.append(F.col("slug") if part == "s" else F.col("k").cast("string") if part == "k" else F.lit(part))
    return F.concat(*out)


def _sql_url(form: str) -> str:
    return "'" + form.replace("{s}", "' || slug || '").replace("{k}", "' || ord || '") + "'"


def sections(spark: SparkSession, d: str) -> DataFrame:
    """(slug, k, n, t): the text of every section of the HTML manuals, numbered, without signs of markup."""
    rows = pages_of(_contents(spark, d)).select("slug", F.col("ord").cast("int").alias("k"), F.concat(F.regexp_replace(markup.visible_text(F.col("body")), _SAFE, " "), F.lit(".")).alias("t"))
    size = rows.groupBy("slug").agg(F.count("*").cast("int").alias("n"))
    return rows.join(size, "slug")


def _listed(pages: DataFrame, item: Column, separator: str = "") -> DataFrame:
    """(slug, n, items): something of every page, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("k").alias("a"), item.alias("b"))))
    return pages.groupBy("slug", "n").agg(F.array_join(rows["b"], separator).alias("items"))


def _response(df: DataFrame, url: Column, body: Column, status: Column | int = 200) -> DataFrame:
    s = status if isinstance(status, Column) else F.lit(status)
    return df.select(url.alias("url"), url.alias("final_url"), s.alias("status"), F.when(s == 200, body).alias("body"))


_LOC = lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>"))
_EMPTY = "k % 7 = 5"
_FAILED = "k % 5 = 3"


def _html(system: str, links: Column | None = None) -> Column:
    """A page of the system with its chrome; a page without content has everything but the content."""
    _, _, open_, close, chrome = SITES[system]
    inner = F.concat(F.lit(open_ + chrome + "<h1>P"), F.col("k").cast("string"), F.lit("</h1><p>"), F.col("t"), F.lit("</p>" + close))
    around = links if links is not None else F.lit("")
    return F.concat(F.lit("<html><head><title>Page</title></head><body><nav>menu</nav>"), around, F.when(F.expr(_EMPTY), "<p>none</p>").otherwise(inner), F.lit("<script>run()</script></body></html>"))


def responses_of(system: str, pages: DataFrame) -> DataFrame:
    """What the sources of a system answer."""
    base, form, *_ = SITES[system]
    url, failed = _url(form), F.when(F.expr(_FAILED), 500).otherwise(200)
    origin = F.concat(F.lit("https://"), F.col("slug"), F.lit(".example"))
    if system == "docusaurus":
        items = _listed(pages, _LOC(url))
        noise = F.concat(*[_LOC(F.concat(origin, F.lit(x))) for x in ("/docs/1.2/start", "/docs/next/a", "/blog/x")])
        index = _response(items, F.concat(origin, F.lit("/sitemap.xml")), F.concat(F.lit("<urlset>"), noise, "items", F.lit("</urlset>")))
    elif system == "hugo":
        half = [_listed(pages.where(x), _LOC(url)) for x in ("2 * k < n", "2 * k >= n")]
        name = lambda x: F.concat(origin, F.lit(f"/{x}/sitemap.xml"))
        top = F.concat(F.lit("<sitemapindex>"), *[F.concat(F.lit("<sitemap><loc>"), name(x), F.lit("</loc></sitemap>")) for x in "ab"], F.lit("</sitemapindex>"))
        noise = F.concat(_LOC(F.concat(origin, F.lit("/docs/print/all"))), _LOC(F.concat(origin, F.lit("/docs/tags/x/"))))
        body = F.concat(F.lit("<urlset>"), noise, "items", F.lit("</urlset>"))
        index = _response(half[0], name("a"), body).union(_response(half[1], name("b"), body, F.when(F.length("slug") % 3 == 0, 503).otherwise(200)))
        index = index.union(_response(pages.where("k = 0"), F.concat(origin, F.lit("/sitemap.xml")), top))
    elif system == "clickhelp":
        index = _response(_listed(pages, F.concat(F.lit('{"e":"p'), F.col("k").cast("string"), F.lit('"}'))), F.concat(origin, F.lit("/docs" + acquire.CLICKHELP_INDEX)), F.col("items"))
    elif system == "paligo":
        index = _response(_listed(pages, F.concat(F.lit('"url": "p'), F.col("k").cast("string"), F.lit('.html#a" "url":"#x"'))), F.concat(origin, F.lit("/m/en" + acquire.PALIGO_INDEX)), F.col("items"))
        index = index.union(_response(pages.where("k = 0"), _url(base), F.lit('<a href="en/start.html">start</a>')))
    elif system == "st4":
        leaf = F.concat(F.lit('{"text":"T","href":"p'), F.col("k").cast("string"), F.lit('.html"}'))
        item = F.when(F.col("k") % 4 == 2, F.concat(F.lit('{"text":"Part '), F.col("k").cast("string"), F.lit('","nodes":['), leaf, F.lit("]}"))).otherwise(leaf)
        index = _response(_listed(pages, item, ","), F.concat(origin, F.lit("/m" + acquire.ST4_INDEX)), F.concat(F.lit("﻿tocData = ["), "items", F.lit("];")))
    elif system == "adobe_helpx":
        link = F.concat(F.lit('<li><a href="/'), F.col("slug"), F.lit("/using/p"), F.col("k").cast("string"), F.lit('.html#top">x</a></li>'))
        body = F.concat(F.lit('<a href="/other/x.html">o</a><ul class="tocList"><li><a href="/other/y.html">y</a></li>'), "items", F.lit("</ul>"))
        index = _response(_listed(pages, link), _url(base), body)
    elif system in ("sphinx", "asciidoctor"):
        to = lambda j: F.when(F.col("k") + j < F.col("n"), F.concat(F.lit('<a href="p'), (F.col("k") + j).cast("string"), F.lit('.html#x">n</a>'))).otherwise("")
        links = F.concat(F.lit('<a href="genindex.html">i</a><a href="https://other.example/en/z.html">o</a><a href="../up.html">u</a>'), *[to(j) for j in range(1, 5)])
        status = failed if system == "sphinx" else F.when(F.expr(_FAILED), 404).otherwise(200)
        where = F.when(F.col("k") == 0, _url(base)).otherwise(url)
        return _response(pages, where, _html(system, links), status)
    elif system == "openstax":
        to = lambda j, name: F.when((F.col("k") + j >= 0) & (F.col("k") + j < F.col("n")), F.concat(F.lit('<a href="p'), (F.col("k") + j).cast("string"), F.lit(f'" aria-label="{name} Page">n</a>'))).otherwise("")
        inner = F.concat(F.lit('<main class="page-content"><div data-type="page"><h1>P'), F.col("k").cast("string"), F.lit("</h1><p>"), "t", F.lit("</p></div></main>"))
        page = F.concat(F.lit("<title>Page - Book of "), "slug", F.lit(" | OpenStax</title>"), to(-1, "Previous"), to(1, "Next"), F.when(F.expr(_EMPTY), "<main>shell</main>").otherwise(inner))
        return _response(pages, url, page, F.when(F.col("k") == 9, 500).otherwise(200))
    elif system == "microsoft_support":
        group = pages.withColumn("m", F.floor(F.col("k") / 4).cast("int")).groupBy("slug", "n", "m").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", _LOC(url).alias("l"))))["l"], "").alias("items"))
        name = lambda m: F.concat(F.lit("https://support.microsoft.com/_sitemaps/"), F.col("slug"), F.lit("_en-us_"), m.cast("string"), F.lit(".xml"))
        index = _response(group, name(F.col("m") + 1), F.concat(F.lit("<urlset>"), "items", F.lit("</urlset>")))
        index = index.union(_response(pages.where("k = 0"), name(F.ceil(F.col("n") / 4) + 1), F.lit(""), F.when(F.length("slug") % 3 == 0, 403).otherwise(404)))
        page = F.concat(F.lit("<h1>P"), F.col("k").cast("string"), F.lit('</h1><div id="ocArticle"><button>b</button><p class="supTOC">x</p><p>'), "t", F.lit("</p></div>"))
        return index.union(_response(pages, url, F.when(F.expr(_EMPTY), "<p>none</p>").otherwise(page), failed))
    elif system in ("llms_txt", "gitbook"):
        host = origin if system == "llms_txt" else F.concat(F.lit("https://"), "slug", F.lit(".gitbook.io"))
        index = _response(_listed(pages, F.concat(F.lit("- [p]("), url, F.lit(")\n"))), F.concat(host, F.lit("/llms.txt")), F.concat(F.lit("# Index\n"), "items", F.lit("- https://elsewhere.example/x.html#a.md\n")))
        banner = F.lit("> For the complete documentation index, see llms.txt\n\n")
        if system == "llms_txt":
            return index.union(_response(pages, url, F.concat(banner, "t"), failed))
        shown = F.concat(F.lit('<img src="~gitbook/image?url=https%3A%2F%2Fh%2Fassets%252FB'), F.col("k").cast("string"), F.lit('.png&w=1">'))
        text = F.concat(banner, "t", F.lit(" ![a](/files/B"), F.col("k").cast("string"), F.lit(") [up](/top)\n\n---\n\n# Agent Instructions\nask"))
        return index.union(_response(pages, url, text, failed)).union(_response(pages, F.regexp_replace(url, r"\.md$", ""), shown, F.when(F.col("k") % 2 == 0, 200).otherwise(404)))
    elif system == "github_markdown":
        item = F.concat(F.lit('{"type":"blob","path":"docs/p'), F.col("k").cast("string"), F.lit('.md"}'))
        tree = F.concat(F.lit('{"tree":[{"type":"blob","path":"docs/README.md"},{"type":"blob","path":"x.md"},{"type":"tree","path":"docs/z.md"},'), "items", F.lit('],"truncated":'), F.when(F.length("slug") % 3 == 0, "true").otherwise("false"), F.lit("}"))
        api = F.concat(F.lit(acquire.REPOSITORY_API + "o/"), "slug", F.lit("/git/trees/main?recursive=1"))
        return _response(_listed(pages, item, ","), api, tree).union(_response(pages, url, F.col("t"), failed))
    elif system == "mkdocs":
        record = lambda loc, title, text: F.struct(loc.alias("location"), title.alias("title"), text.alias("text"))
        number = F.col("k").cast("string")
        whole = record(F.concat(F.lit("p"), number, F.lit("/")), F.concat(F.lit("P"), number), F.concat(F.lit("Lead "), F.col("t")))
        part = record(F.concat(F.lit("p"), number, F.lit("/#s")), F.lit("Sub"), F.col("t"))
        rows = F.flatten(F.array_sort(F.collect_list(F.struct("k", F.array(whole, part).alias("r"))))["r"])
        return _response(pages.groupBy("slug").agg(F.to_json(F.struct(rows.alias("docs"))).alias("j")), F.concat(origin, F.lit("/m" + acquire.MKDOCS_INDEX)), F.col("j"))
    elif system == "zendesk_help":
        api = lambda m: F.concat(F.lit("https://"), F.col("slug"), F.lit(".zendesk.com/api/v2/help_center/en-us/articles.json?per_page=100"), F.when(m == 0, "").otherwise(F.concat(F.lit("&page="), (m + 1).cast("string"))))
        article = F.struct(F.concat(F.lit("P"), F.col("k").cast("string")).alias("title"), F.concat(F.lit("<script>x</script><p>"), "t", F.lit("</p>")).alias("body"), url.alias("html_url"))
        group = pages.withColumn("m", F.floor(F.col("k") / 5).cast("int")).groupBy("slug", "n", "m").agg(F.array_sort(F.collect_list(F.struct("k", article.alias("a"))))["a"].alias("articles"))
        following = F.when((F.col("m") + 1) * 5 < F.col("n"), api(F.col("m") + 1))
        return _response(group, api(F.col("m")), F.to_json(F.struct("articles", following.alias("next_page"))))
    elif system == "apple_help":
        welcome = pages.groupBy("slug", "n").agg(F.array_sort(F.collect_list(F.struct("k", url.alias("u"))), lambda a, b: b["k"] - a["k"])["u"].alias("l"))
        path = lambda u: F.regexp_replace(u, "^https://support.apple.com", "")
        even = F.filter("l", lambda u: F.regexp_extract(u, r"/p(\d+)-", 1).cast("int") % 2 == 0)
        toc = F.array_join(F.transform(even, lambda u: F.concat(F.lit('<li><a href="'), path(u), F.lit('">x</a></li>'))), "")
        every = F.array_join(F.transform("l", lambda u: F.concat(F.lit('"'), path(u), F.lit('"'))), ",")
        home = F.concat(F.lit("<h1>Guide of "), "slug", F.lit('</h1><div id="modal-toc-container"><ul class="toc"><li><button>Part</button><ul>'), toc, F.lit("</ul></li></ul></div><script>["), every, F.lit("]</script>"))
        page = F.concat(F.lit('<div id="article-section"><div><h1>P'), F.col("k").cast("string"), F.lit("</h1><p>"), "t", F.lit('</p><div class="LinkDownload">d</div></div></div>'))
        return _response(welcome, _url(base), home).union(_response(pages, url, page, failed))
    else:
        raise ValueError(system)
    return index.union(_response(pages, url, _html(system), failed))


def built(found: acquire.Found, system: str) -> DataFrame:
    """(slug, pages, lost, truncated, sha256): the counters of every source and the hash of its manual."""
    content = acquire.merged(system, found).select("source", F.sha2("content", 256).alias("sha256"))
    return acquire.counters(found).join(content, "source", "left").select(F.col("source").alias("slug"), F.col("pages").cast("bigint").alias("pages"), F.col("lost").cast("bigint").alias("lost"), "truncated", "sha256")


def _query(system: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        pages = written(sections(spark, d), "sections")
        # The walk back to the first page of a chain starts at a page inside.
        start = F.least(F.lit(4), F.col("n") - 1) if system == "openstax" else F.lit(0)
        seeds = pages.where(F.col("k") == start).select(F.col("slug").alias("source"), _url(SITES[system][0]).alias("url"))
        return built(acquire.acquired(system, seeds, written(responses_of(system, pages), "responses"), 3 if system == "zendesk_help" else CAP), system)

    run.__name__ = f"q60_{system}"
    run.__doc__ = f"Every HTML manual as a source of {system}, acquired and merged."
    return run


def q61_wordpress(spark: SparkSession, d: str) -> DataFrame:
    """The first section of every HTML manual as a post, read through the REST link of its page."""
    pages = checkpointed(sections(spark, d).where("k = 0"))
    url, rest = _url("https://{s}.example/post/"), _url("https://{s}.example/wp-json/wp/v2/posts/7?a=1&b=2")
    link = F.concat(F.lit('<link rel="alternate" type="application/json" href="'), F.replace(rest, F.lit("&"), F.lit("&amp;")), F.lit('">'))
    post = F.to_json(F.struct(F.struct(F.lit("Tuning &amp; Care").alias("rendered")).alias("title"), F.struct(F.concat(F.lit('<div class="rank-math-toc">t</div><p> </p><p>'), "t", F.lit("</p>")).alias("rendered")).alias("content")))
    answers = _response(pages, url, link).union(_response(pages, rest, post, F.when(F.length("slug") % 3 == 0, 500).otherwise(200)))
    found = acquire.acquired("wordpress", pages.select(F.col("slug").alias("source"), url.alias("url")), checkpointed(answers))
    out = acquire.counters(found).join(acquire.merged("wordpress", found).select("source", F.sha2("content", 256).alias("sha256")), "source", "left")
    return out.select(F.col("source").alias("slug"), "title", F.col("pages").cast("bigint").alias("pages"), "error", "sha256")


def q62_pdf(spark: SparkSession, d: str) -> DataFrame:
    """The text layers of PDF manuals behind an address, some of them an HTML page instead."""
    rows = checkpointed(_rows(spark, d, "pdf").distinct())
    url = _url("https://{s}.example/manual.pdf")
    body = F.when(F.length("slug") % 3 == 0, F.concat(F.lit("<html>"), "content")).otherwise(F.concat(F.lit("\r\n%PDF-1.7\n"), "content"))
    answers = rows.select(url.alias("url"), url.alias("final_url"), F.lit(200).alias("status"), body.alias("body"))
    found = acquire.acquired("pdf_url", rows.select(F.col("slug").alias("source"), url.alias("url")), answers)
    out = acquire.counters(found).join(acquire.merged("pdf_url", found).select("source", "kind", F.sha2("content", 256).alias("sha256")), "source", "left")
    return out.select(F.col("source").alias("slug"), "kind", "error", "sha256")


#: Systems of the sweep over all routes, which is one run for seeds of every kind.
SWEEP = ("docusaurus", "sphinx", "mkdocs", "github_markdown", "llms_txt")


def _swept(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Manuals dealt over the systems by the length of their names, with the home pages by which they are recognised; the last
    share answers nothing."""
    pages = checkpointed(sections(spark, d))
    share = F.length("slug") % (len(SWEEP) + 1)
    seeds = answers = None
    for k, system in enumerate(SWEEP):
        own = pages.where(share == k)
        base = _url({"llms_txt": "https://{s}.example/llms.txt"}.get(system, SITES[system][0]))
        s = own.where("k = 0").select(F.col("slug").alias("source"), base.alias("url"))
        r = responses_of(system, own)
        if system in ("docusaurus", "mkdocs"):
            r = r.union(_response(own.where("k = 0"), base, F.lit(f'<meta name="generator" content="{system} 1">')))
        if system == "sphinx":  # the probe looks at the home page, which is the first page
            r = r.withColumn("body", F.concat(F.lit('<script src="_static/doctools.js"></script>'), "body"))
        seeds, answers = (s, r) if seeds is None else (seeds.union(s), answers.union(r))
    gone = pages.where((share == len(SWEEP)) & (F.col("k") == 0))
    return seeds.union(gone.select(F.col("slug").alias("source"), _url("https://{s}.example/none").alias("url"))), checkpointed(answers)


def _made(spark: SparkSession, d: str) -> DataFrame:
    return acquire.ingested(*_swept(spark, d), systems_wanted=list(SWEEP))


def q63_ingest(spark: SparkSession, d: str) -> DataFrame:
    """One run over seeds of several systems: routed, probed, acquired and merged."""
    made = _made(spark, d)
    return made.select(F.col("source").alias("slug"), "pattern", "system", "kind", F.col("pages").cast("bigint").alias("pages"), F.col("lost").cast("bigint").alias("lost"), F.sha2("content", 256).alias("sha256"), F.col("error").isNotNull().alias("failed"))


def q64_ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The same run against a corpus in which every second of its manuals is there already, unchanged."""
    made = checkpointed(_made(spark, d))
    held = made.where(F.col("content").isNotNull() & (F.length("source") % 2 == 0))
    prior = held.select(F.col("source").alias("slug"), F.sha2("content", 256).alias("sha256"), F.lit("2025-01-01T00:00:00Z").alias("ingested_at"))
    outcomes, manifests = acquire.staged(made, prior, F.lit("2025-01-02 03:04:05").cast("timestamp"), "1.0")
    return outcomes.join(manifests.select("slug", "deliverable", "bytes"), "slug", "left").select("slug", "status", "deliverable", "bytes")


QUERIES = {f"q60_{s}": _query(s) for s in SITES} | {f.__name__: f for f in (q61_wordpress, q62_pdf, q63_ingest, q64_ingest_outcomes)}

_T = "regexp_replace(" + _VIS.format("body") + ", '" + _SAFE.replace("'", "''") + "', ' ', 'g') || '.'"
_P = f"p AS (SELECT slug, ord::INT AS ord, {_T} AS t FROM {_SECT}), z AS (SELECT slug, count(*)::INT AS n FROM p GROUP BY slug)"
_GONE = "(ord % 5 = 3 OR ord % 7 = 5)"


def _shell(parts: str, name: str, h1: bool, suffix: str = "") -> str:
    head = f"'<h1>' || {name} || '{suffix}</h1>' || chr(10) || " if h1 else ""
    return f"""'<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>' || {name} || '{suffix}</title></head><body>' || chr(10) || {head}{parts} || chr(10) || '</body></html>' || chr(10)"""


def _manuals(system: str, cap: int = CAP) -> str:
    """SELECT of (slug, pages, lost, truncated, content): what must come out of a system."""
    base, form, open_, close, _ = SITES[system]
    url, gone, order, tried, cut, name = _sql_url(form), _GONE, "ord", f"ord < {cap}", f"n > {cap}", "slug"
    fragment = f"'{open_}<h1>P' || ord || '</h1><p>' || t || '</p>{close}'"
    title = "''"
    if system == "hugo":
        tried = f"ord < {cap} AND (length(slug) % 3 <> 0 OR 2 * ord < n)"
        cut = f"length(slug) % 3 = 0 OR n > {cap} OR n < 2"  # of one page there is no second sitemap
    if system == "st4":
        level = "CASE WHEN ord % 4 = 2 THEN 3 ELSE 2 END"
        # Titles of branches before a page that no saved page took since.
        heads = "coalesce((SELECT string_agg('<h2>Part ' || q.ord || '</h2>', '' ORDER BY q.ord) FROM k q WHERE q.slug = k.slug AND q.ord <= k.ord AND q.ord % 4 = 2 AND q.ord > coalesce((SELECT max(r.ord) FROM k r WHERE r.slug = k.slug AND r.ord < k.ord AND NOT r.gone), -1)), '')"
        fragment = f"{heads} || chr(10) || '{open_}<h' || {level} || '>P' || ord || '</h' || {level} || '><p>' || t || '</p>{close}'"
    if system in ("st4", "sphinx"):
        tried = f"sum((NOT {gone})::INT) OVER (PARTITION BY slug ORDER BY ord) - (NOT {gone})::INT < {cap}"
        cut = f"n > {cap}" if system == "st4" else f"(SELECT count(*) FROM k WHERE k.slug = z.slug) < n"
    if system == "sphinx":
        url, name = f"CASE WHEN ord = 0 THEN {_sql_url(base)} ELSE {url} END", "'Page'"
    if system == "asciidoctor":
        # What is not there is no page at all; equal contents have different headings here.
        url, name = _sql_url(form), "'Page'"
        tried = f"ord % 5 <> 3 AND sum((NOT {gone})::INT) OVER (PARTITION BY slug ORDER BY ord) - (NOT {gone})::INT < {cap}"
        cut = f"coalesce((SELECT max(q.ord) FROM p q WHERE q.slug = z.slug AND q.ord % 5 <> 3) > (SELECT max(k.ord) FROM k WHERE k.slug = z.slug), false)"
    if system == "openstax":
        gone, name = "ord % 7 = 5", "'Book of ' || slug"
        tried, cut = f"ord < 9", "n > 9"
    if system == "microsoft_support":
        cut = f"n > {cap} OR length(slug) % 3 = 0"
        fragment, title = "'<p>' || t || '</p>'", "'<h2>P' || ord || '</h2>' || chr(10)"
    if system == "zendesk_help":
        gone, tried, cut = "false", "ord < 15", "n > 15"
        fragment, title = "'<p>' || t || '</p>'", "'<h2>P' || ord || '</h2>' || chr(10)"
    if system == "apple_help":
        # The contents list even pages, the last first; the others follow by name.  They are found in this order, too, the others last to first.
        gone = "ord % 5 = 3"
        tried = f"coalesce(sum((NOT {gone})::INT) OVER (PARTITION BY slug ORDER BY ord % 2, ord DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {cap - 1}"
        cut = "(SELECT count(*) FROM k WHERE k.slug = z.slug) < n"
        level = "CASE WHEN ord % 2 = 0 THEN 3 ELSE 2 END"
        fragment, name = f"'<h' || {level} || '>P' || ord || '</h' || {level} || '><p>' || t || '</p>'", "'Guide of ' || slug"
        order = "CASE WHEN ord % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN ord % 2 = 0 THEN -ord END, 'p' || ord || '-num'"
    if system in MARKDOWN:
        body = {
            "gitbook": "t || ' ![a](' || CASE WHEN ord % 2 = 0 THEN 'https://h/assets%2FB' || ord || '.png' ELSE 'https://' || slug || '.gitbook.io/files/B' || ord END || ') [up](https://' || slug || '.gitbook.io/top)'",
            "mkdocs": "'# P' || ord || chr(10) || chr(10) || 'Lead' || chr(10) || chr(10) || '## Sub' || chr(10) || chr(10) || trim(t)",
        }.get(system, "t")
        if system in ("gitbook", "mkdocs"):
            tried, cut = "true", "false"
        gone = {"mkdocs": "false"}.get(system, "ord % 5 = 3")
        if system == "github_markdown":
            order, cut = "'p' || ord || '.md'", f"n > {cap} OR length(slug) % 3 = 0"
            tried = f"row_number() OVER (PARTITION BY slug ORDER BY 'docs/p' || ord || '.md') <= {cap}"
        part = f"'<!-- source: ' || {url} || ' -->' || chr(10) || chr(10) || {body} || chr(10)"
        content, separator = "b", "chr(10)||chr(10)||'---'||chr(10)||chr(10)"
    else:
        part = f"'<!-- source: ' || {url} || ' -->' || chr(10) || '<section>' || chr(10) || {title} || {fragment} || chr(10) || '</section>'"
        content, separator = None, "chr(10)"
    k = f"k AS (SELECT * FROM (SELECT slug, ord, t, n, {gone} AS gone, {tried} AS tried FROM p JOIN z USING (slug)) WHERE tried)"
    s = f"s AS (SELECT slug, count(*) FILTER (NOT gone) AS pages, count(*) FILTER (gone) AS lost, string_agg(CASE WHEN NOT gone THEN part END, {separator} ORDER BY {order}) AS b FROM (SELECT *, {part} AS part FROM k) GROUP BY slug)"
    if content is None:
        suffix = " Help" if system in acquire.SUFFIX else ""
        group = "'<!-- source:  -->' || chr(10) || '<section>' || chr(10) || '<h2>Part</h2>' || chr(10) || '</section>' || chr(10) || " if system == "apple_help" else ""
        content = _shell(group + "b", name, system not in acquire.WITHOUT_H1, suffix)
    return f"WITH {_P}, {k}, {s} SELECT slug, coalesce(pages, 0) AS pages, coalesce(lost, 0) AS lost, {cut} AS truncated, CASE WHEN pages > 0 THEN {content} END AS content FROM z LEFT JOIN s USING (slug)"



_WHEN = "length(slug) % 3 = 0"
_POST = _shell("'<!-- source: https://' || slug || '.example/post/ -->' || chr(10) || '<section>' || chr(10) || '<p>' || t || '</p>' || chr(10) || '</section>'", "'Tuning &amp; Care'", False)
_SHARE = f"length(slug) % {len(SWEEP) + 1}"
_MADE = " UNION ALL ".join(
    f"SELECT slug, '{s if s in ('github_markdown', 'llms_txt') else 'docs_probe'}' AS pattern, '{s}' AS system, CASE WHEN pages > 0 THEN '{acquire.SYSTEMS[s][1]}' END AS kind, pages, lost, content FROM ({_manuals(s, 1_000_000)}) WHERE {_SHARE} = {k}"
    for k, s in enumerate(SWEEP)
) + f" UNION ALL SELECT DISTINCT slug, 'docs_probe', NULL, NULL, NULL, NULL, NULL FROM {_SECT} WHERE {_SHARE} = {len(SWEEP)}"

SQL = {f"q60_{s}": f"SELECT slug, pages, lost, truncated, sha256(content) AS sha256 FROM ({_manuals(s)})" for s in SITES} | {
    "q61_wordpress": f"WITH {_P} SELECT slug, CASE WHEN {_WHEN} THEN NULL ELSE 'Tuning & Care' END AS title, CASE WHEN {_WHEN} THEN 0 ELSE 1 END::BIGINT AS pages, CASE WHEN {_WHEN} THEN 'post: HTTP 500' END AS error, CASE WHEN NOT {_WHEN} THEN sha256({_POST}) END AS sha256 FROM p WHERE ord = 0",
    "q62_pdf": f"SELECT slug, CASE WHEN NOT {_WHEN} THEN 'pdf' END AS kind, CASE WHEN {_WHEN} THEN 'not a PDF' END AS error, CASE WHEN NOT {_WHEN} THEN sha256(chr(13) || chr(10) || '%PDF-1.7' || chr(10) || content) END AS sha256 FROM {_C} WHERE kind = 'pdf'",
    "q63_ingest": f"SELECT slug, pattern, system, kind, pages, lost, sha256(content) AS sha256, content IS NULL AS failed FROM ({_MADE})",
    "q64_ingest_outcomes": f"SELECT slug, CASE WHEN content IS NULL THEN 'failed' WHEN length(slug) % 2 = 0 THEN 'unchanged' ELSE 'changed' END AS status, CASE WHEN length(slug) % 2 = 1 AND content IS NOT NULL THEN slug || CASE kind WHEN 'html' THEN '.html' ELSE '.md' END END AS deliverable, CASE WHEN length(slug) % 2 = 1 THEN strlen(content)::BIGINT END AS bytes FROM ({_MADE})",
}
