"""Routing: the ordered first-match registry of source patterns, and the ladder that routes by content.

CASE takes the first branch that holds, which is the semantics of an ordered registry, and
is evaluated inside generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, urls

# Hosts known to publish an index for language models.
LLMS_HOSTS = ("platform.claude.com", "docs.claude.com", "docs.anthropic.com", "code.claude.com")
# Tells of content systems.
CLICKHELP_TELLS = ("CHWebHelp.css", "WebHelp_body", "_webHelpScripts/")
PALIGO_TELLS = ("portal-single-publication", "html5.fuse.search.js", "fuzzydata")
ST4_TELLS = ("schema.de/2010/ST4", 'src="js/treedata.json"', "YMH_HTML_Manual")
SPHINX_TELLS = ("_static/documentation_options.js", "_static/doctools.js", "_static/pygments.css")


@dataclass(frozen=True)
class Pattern:
    """name, whether one fetch gives the whole source, and the kind of its deliverable (NULL: as found)."""

    name: str
    single_fetch: bool = False
    kind: str | None = None
    cap: int | None = None


#: In the order in which they are tried.
PATTERNS = (
    Pattern("apple_help", kind="html", cap=6000),
    Pattern("llms_txt", kind="markdown", cap=1000),
    Pattern("readthedocs"),
    Pattern("github_markdown", kind="markdown", cap=2000),
    Pattern("zendesk_help", kind="html", cap=100),
    Pattern("microsoft_support", kind="html", cap=2000),
    Pattern("adobe_helpx", kind="html", cap=3000),
    Pattern("openstax", kind="html", cap=1500),
    Pattern("api_spec", kind="markdown"),
    Pattern("pdf_url", single_fetch=True, kind="pdf"),
    Pattern("archive_download", single_fetch=True),
    Pattern("gitbook", kind="markdown"),
    Pattern("docs_probe"),
)


def predicates(url: Column) -> dict[str, Column]:
    net, path, low = urls.netloc(url), urls.path(url), F.lower(urls.path(url))
    n = F.size(urls.segments(url))
    bare = F.regexp_replace(url, "/+$", "")
    last = F.lower(F.substring_index(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", ""), "/", -1))
    trimmed = F.regexp_replace(low, "/+$", "")
    pdf = trimmed.endswith(".pdf") | trimmed.endswith("/pdf")
    return {
        "apple_help": ((net == "support.apple.com") | net.endswith(".apple.com")) & path.contains("/guide/"),
        "llms_txt": bare.endswith("llms.txt") | bare.endswith("llms-full.txt") | net.isin(*LLMS_HOSTS),
        "readthedocs": ~(pdf | low.contains("/_/downloads/")) & net.endswith(".readthedocs.io"),
        "github_markdown": net.isin("github.com", "www.github.com") & (n >= 2),
        "zendesk_help": ~path.contains("/article_attachments/") & (net.endswith(".zendesk.com") | path.contains("/hc/")),
        "microsoft_support": net == "support.microsoft.com",
        "adobe_helpx": ~trimmed.endswith(".pdf") & (net == "helpx.adobe.com") & (n >= 2),
        "openstax": (net == "openstax.org") & path.startswith("/books/"),
        "api_spec": last.rlike(r"\.(json|yaml|yml)$|openapi|swagger|postman"),
        "pdf_url": pdf,
        "archive_download": low.rlike(r"\.(zip|tar\.gz|tgz|tar\.bz2|tbz2|epub)$"),
        "gitbook": net.endswith(".gitbook.io"),
        "docs_probe": urls.scheme(url).isin("http", "https"),
    }


def classify(url: Column) -> Column:
    """Name of the first pattern that takes the URL; NULL if none does or the URL is NULL."""
    tests = predicates(url)
    out = None
    for p in PATTERNS:
        out = F.when(tests[p.name], p.name) if out is None else out.when(tests[p.name], p.name)
    return out


def registry(spark: SparkSession) -> DataFrame:
    """(prio, pattern, single_fetch, kind, cap): the registry as a dimension of 13 rows."""
    rows = [(k, p.name, p.single_fetch, p.kind, p.cap) for k, p in enumerate(PATTERNS)]
    return spark.createDataFrame(rows, "prio int, pattern string, single_fetch boolean, kind string, cap int")


def _tells(body: Column, tells: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for t in tells:
        out = out + body.contains(t).cast("int")
    return out


def probe(body: Column, search_index: Column | None = None, llms: Column | None = None) -> Column:
    """Content system of a fetched page by the strict ladder; search_index and llms are the bodies of the
    side requests the last rungs look at.  NULL if no rung holds."""
    generator = markup.generator_meta(body)
    rest = F.regexp_extract(body, r"""(?i)<link[^>]+rel="alternate"[^>]+type="application/json"[^>]+href="([^"]+)\"""", 1)
    st4 = F.lower(F.regexp_extract(body, r'(?i)name="generator"[^>]*content="([^"]*)"', 1)).contains("st4")
    sphinx = generator.contains("sphinx") | (_tells(body, SPHINX_TELLS) >= 1) | (generator.contains("docutils") & body.contains("_static/"))
    out = (
        F.when(F.left(body, F.lit(1024)).contains("%PDF-"), "pdf")
        .when(_tells(body, CLICKHELP_TELLS) >= 2, "clickhelp")
        .when(body.rlike(r'(?i)name="generator"\s+content="paligo"') | (_tells(body, PALIGO_TELLS) >= 2), "paligo")
        .when(st4 | (_tells(body, ST4_TELLS) >= 2), "st4")
        .when(generator.contains("mkdocs"), "mkdocs")
        .when(generator.contains("docusaurus"), "docusaurus")
        .when(generator.contains("hugo"), "hugo")
        .when(generator.contains("asciidoctor"), "asciidoctor")
        .when(generator.contains("wordpress") | rest.contains("/wp-json/"), "wordpress")
        .when(sphinx, "sphinx")
    )
    if search_index is not None:
        docs = F.get_json_object(search_index, "$.docs")
        out = out.when(docs.startswith("["), "mkdocs")
    if llms is not None:
        pages = F.filter(F.regexp_extract_all(llms, F.lit(r"(https?://[^\s)]+\.md)"), F.lit(1)), lambda u: urls.path(u).endswith(".md"))
        out = out.when(F.size(pages) > 0, "llms_txt")
    return out


def sniff_spec(text: Column) -> Column:
    """openapi, postman or NULL for the text of a specification; a key that is there counts even with a null value."""
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    info = F.coalesce(F.json_object_keys(F.get_json_object(text, "$.info")), F.array().cast("array<string>"))
    postman = (F.array_contains(info, "_postman_id") | F.array_contains(info, "schema")) & F.array_contains(keys, "item")
    return F.when(F.array_contains(keys, "openapi") | F.array_contains(keys, "swagger"), "openapi").when(postman, "postman")
