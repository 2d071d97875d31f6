"""Queries on URLs and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import routing
from ..operators.ordering import capped, first_seen, numbered
from ..session import table
from ..sources import systems

#: URLs of every kind of source, and one of none.
ROUTES = (
    "https://support.apple.com/guide/numbers/welcome/mac", "https://help.apple.com/guide/pages/intro", "https://support.apple.com/en-us/docs",
    "https://docs.some.example/llms.txt", "https://docs.some.example/llms-full.txt/", "https://docs.claude.com/en/home", "https://some.readthedocs.io/en/latest/",
    "https://some.readthedocs.io/_/downloads/en/latest/pdf/", "https://github.com/owner/repo/tree/main/docs", "https://github.com/owner", "https://some.zendesk.com/hc/en-us",
    "https://help.some.example/hc/de-de/articles/12-Start", "https://help.some.example/hc/article_attachments/7/file", "https://support.microsoft.com/en-us/excel",
    "https://helpx.adobe.com/some/user-guide.html", "https://helpx.adobe.com/some/guide.pdf", "https://openstax.org/books/biology/pages/1-intro", "https://api.some.example/openapi.json",
    "https://some.example/v1/swagger", "https://some.example/manual.PDF", "https://some.example/manual/pdf/", "https://some.example/docs.tar.bz2", "https://some.example/book.epub",
    "https://some.gitbook.io/guide", "http://plain.example/docs/", "ftp://plain.example/docs/", "/local/path/postman_collection.json", "not a url", "",
)
_VALUES = "(VALUES " + ", ".join(f"('{u}')" for u in ROUTES) + ") AS v(url)"

_NET = r"lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1))"
_PATH = r"regexp_replace(regexp_replace({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*', ''), '[?#].*$', '')"
_HOST = r"regexp_replace(regexp_replace(" + _NET + r", '^.*@', ''), ':\d*$', '')"


def _case(u: str) -> str:
    net, path = _NET.format(u=u), _PATH.format(u=u)
    low = f"lower({path})"
    trim = rf"regexp_replace({low}, '/+$', '')"
    segs = f"len(list_filter(string_split({path}, '/'), lambda s: s <> ''))"
    bare = f"regexp_replace({u}, '/+$', '')"
    last = rf"regexp_extract(regexp_replace(regexp_replace(lower({u}), '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1)"
    pdf = f"({trim} LIKE '%.pdf' OR {trim} LIKE '%/pdf')"
    hosts = ", ".join(f"'{h}'" for h in routing.LLMS_HOSTS)
    return rf"""CASE
  WHEN ({net} = 'support.apple.com' OR {net} LIKE '%.apple.com') AND {path} LIKE '%/guide/%' THEN 'apple_help'
  WHEN {bare} LIKE '%llms.txt' OR {bare} LIKE '%llms-full.txt' OR {net} IN ({hosts}) THEN 'llms_txt'
  WHEN NOT ({pdf} OR {low} LIKE '%/_/downloads/%') AND {net} LIKE '%.readthedocs.io' THEN 'readthedocs'
  WHEN {net} IN ('github.com', 'www.github.com') AND {segs} >= 2 THEN 'github_markdown'
  WHEN {path} NOT LIKE '%/article\_attachments/%' ESCAPE '\' AND ({net} LIKE '%.zendesk.com' OR {path} LIKE '%/hc/%') THEN 'zendesk_help'
  WHEN {net} = 'support.microsoft.com' THEN 'microsoft_support'
  WHEN {trim} NOT LIKE '%.pdf' AND {net} = 'helpx.adobe.com' AND {segs} >= 2 THEN 'adobe_helpx'
  WHEN {net} = 'openstax.org' AND {path} LIKE '/books/%' THEN 'openstax'
  WHEN regexp_matches({last}, '\.(json|yaml|yml)$|openapi|swagger|postman') THEN 'api_spec'
  WHEN {pdf} THEN 'pdf_url'
  WHEN regexp_matches({low}, '\.(zip|tar\.gz|tgz|tar\.bz2|tbz2|epub)$') THEN 'archive_download'
  WHEN {net} LIKE '%.gitbook.io' THEN 'gitbook'
  WHEN regexp_matches({u}, '^(?i)https?:') THEN 'docs_probe' END"""


def _routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u,) for u in ROUTES], "url string")


def _slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifests").where("source_url IS NOT NULL").select("slug", "source_url").distinct()


def q02_url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("source_url")
    return _slugs(spark, d).select(
        "slug", "source_url", urls.scheme(u).alias("scheme"), urls.netloc(u).alias("netloc"), urls.host(u).alias("host"), urls.path(u).alias("path"),
        F.size(urls.segments(u)).cast("bigint").alias("segments"), urls.last_segment(u).alias("last_segment"),
    )


def q03_slug_from_host(spark: SparkSession, d: str) -> DataFrame:
    h = urls.host(F.col("source_url"))
    return _slugs(spark, d).select(h.alias("host"), urls.slug_from_host(h).alias("host_slug")).distinct()


def q04_classify_routes(spark: SparkSession, d: str) -> DataFrame:
    return _routes(spark).select("url", routing.classify(F.col("url")).alias("pattern"))


def q05_classify_manifests(spark: SparkSession, d: str) -> DataFrame:
    return _slugs(spark, d).select("slug", "source_url", routing.classify(F.col("source_url")).alias("pattern"))


def q06_base_dir(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("source_url")
    return _slugs(spark, d).select("slug", "source_url", urls.names_a_file(u).alias("is_file"), urls.base_dir(u).alias("base"), urls.base_dir(u, any_dot=True).alias("folder"))


def q07_slugify(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_name").alias("name"))
    docs = table(spark, d, "documents").select(F.col("source").alias("name"))
    return parts.union(docs).where("name IS NOT NULL").distinct().select("name", urls.slugify(F.col("name")).alias("name_slug"))


def q08_slug_rules(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _routes(spark).select(
        "url", urls.slug_from_archive(u).alias("archive"), urls.slug_from_help_center(u).alias("help_center"), urls.slug_from_gitbook(u).alias("gitbook"),
        urls.slug_from_topic(u, "books").alias("book"), urls.locale(u).alias("locale"),
    )


def q09_ordinal_per_site(spark: SparkSession, d: str) -> DataFrame:
    rows = _slugs(spark, d).select(urls.host(F.col("source_url")).alias("site"), "source_url").distinct()
    return numbered(rows, ["site"], ["source_url"]).withColumn("ord", F.col("ord").cast("bigint"))


def q10_first_seen(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "manifest_log").where("source_url IS NOT NULL").select(urls.without_fragment(F.col("source_url")).alias("page"), "rec_id", "slug")
    return first_seen(log, ["page"], ["rec_id"])


def q11_capped_sites(spark: SparkSession, d: str) -> DataFrame:
    rows = _slugs(spark, d).select(urls.host(F.col("source_url")).alias("site"), "source_url").distinct()
    return capped(rows, ["site"], ["source_url"], 5)


def q24_natural_sort(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_name", F.concat("p_type", F.lit(" "), F.col("p_size").cast("string")).alias("name")).select("name").distinct()
    out = numbered(rows.withColumn("k", urls.natural_key(F.col("name"))), [], ["k", "name"])
    return out.select("name", (F.col("ord") + 1).alias("ord"))


def q46_system_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slugs, language and version by the rules of single systems."""
    u = F.col("source_url")
    return _slugs(spark, d).select("slug", "source_url", systems.pdf_slug(u).alias("pdf"), systems.clickhelp_slug(u).alias("publication"), systems.language_and_version(u).alias("r")).select("slug", "source_url", "pdf", "publication", "r.*")


def q47_folded_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of the titles of documents, accents folded."""
    titles = table(spark, d, "documents").where("title IS NOT NULL").select("title").distinct()
    return titles.select("title", systems.folded_slug(F.col("title")).alias("title_slug"))


def q47_repositories(spark: SparkSession, d: str) -> DataFrame:
    """Owner, name, branch and folder of addresses, read as those of a code host."""
    r = urls.repository(F.col("source_url"))
    return _slugs(spark, d).select("slug", "source_url", r["owner"].alias("owner"), r["repo"].alias("repo"), r["branch"].alias("branch"), r["subdir"].alias("subdir"))


def q55_image_names(spark: SparkSession, d: str) -> DataFrame:
    return _slugs(spark, d).select("slug", "source_url", urls.image_name(F.col("source_url")).alias("local"))


QUERIES = {f.__name__: f for f in (q02_url_parts, q03_slug_from_host, q04_classify_routes, q05_classify_manifests, q06_base_dir, q07_slugify, q08_slug_rules, q09_ordinal_per_site, q10_first_seen, q11_capped_sites, q24_natural_sort, q46_system_slugs, q47_folded_slugs, q47_repositories, q55_image_names)}

_S = "(SELECT DISTINCT slug, source_url FROM manifests WHERE source_url IS NOT NULL)"
_P, _N, _H = _PATH.format(u="source_url"), _NET.format(u="source_url"), _HOST.format(u="source_url")
_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_BARE = r"regexp_replace(regexp_replace(source_url, '[?#].*$', ''), '/+$', '')"
_BPATH = r"regexp_replace(" + _BARE + r", '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', '')"
_LABEL = "string_split({0}, '.')"
_UP, _UN = _PATH.format(u="url"), _NET.format(u="url")
_ARCH = _SLUG.format(rf"regexp_replace(regexp_extract(regexp_replace({_UP}, '/+$', ''), '([^/]*)$', 1), '(?i)(\.zip|\.tar\.gz|\.tgz|\.tar\.bz2|\.tbz2|\.epub)$', '')")
_HC = _SLUG.format(rf"string_split(regexp_replace({_UN}, '^(www\.)?(support\.)?', ''), '.')[1]")
_OWN = f"CASE WHEN {_HC} = '' THEN 'help' ELSE {_HC} END"
_ART, _ANAME = rf"regexp_extract({_UP}, '/articles/(\d+)', 1)", rf"regexp_extract({_UP}, '/articles/\d+-([^/]+)', 1)"

SQL = {
    "q02_url_parts": rf"SELECT slug, source_url, lower(regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme, {_N} AS netloc, {_H} AS host, {_P} AS path, len(list_filter(string_split({_P}, '/'), lambda s: s <> ''))::BIGINT AS segments, regexp_extract(regexp_replace({_P}, '/+$', ''), '([^/]*)$', 1) AS last_segment FROM {_S}",
    "q03_slug_from_host": f"SELECT DISTINCT host, replace(CASE WHEN len(l) > 1 AND l[1] IN ('www', 'docs', 'manual', 'manuals', 'help', 'support') THEN l[2] ELSE l[1] END, '_', '-') AS host_slug FROM (SELECT {_H} AS host, string_split({_H}, '.') AS l FROM {_S})",
    "q04_classify_routes": f"SELECT url, {_case('url')} AS pattern FROM {_VALUES}",
    "q05_classify_manifests": f"SELECT slug, source_url, {_case('source_url')} AS pattern FROM {_S}",
    "q06_base_dir": rf"SELECT slug, source_url, regexp_matches({_P}, '\.[A-Za-z][A-Za-z0-9]{{1,5}}$') AS is_file, CASE WHEN regexp_matches({_BPATH}, '\.[A-Za-z][A-Za-z0-9]{{1,5}}$') THEN regexp_replace({_BARE}, '/[^/]*$', '') ELSE {_BARE} END AS base, CASE WHEN regexp_matches({_BPATH}, '/[^/]*\.[^/]*$') THEN regexp_replace({_BARE}, '/[^/]*$', '') ELSE {_BARE} END AS folder FROM {_S}",
    "q07_slugify": f"SELECT DISTINCT name, {_SLUG.format('name')} AS name_slug FROM (SELECT p_name AS name FROM part UNION SELECT source FROM documents) WHERE name IS NOT NULL",
    "q08_slug_rules": rf"SELECT url, CASE WHEN {_ARCH} = '' THEN 'docs' ELSE {_ARCH} END AS archive, CASE WHEN {_ART} <> '' THEN {_SLUG.format(f'''concat_ws('-', {_OWN}, CASE WHEN {_ANAME} <> '' THEN {_ANAME} ELSE {_ART} END)''')} ELSE {_OWN} END AS help_center, CASE WHEN {_UN} NOT LIKE '%gitbook.io' AND len(string_split({_UN}, '.')) > 1 AND string_split({_UN}, '.')[1] = 'docs' THEN string_split({_UN}, '.')[2] ELSE string_split({_UN}, '.')[1] END AS gitbook, regexp_extract({_UP}, '/books/([^/]+)', 1) AS book, CASE WHEN regexp_extract({_UP}, '/hc/([a-z]{{2}}-[a-z]{{2}})', 1) = '' THEN 'en-us' ELSE regexp_extract({_UP}, '/hc/([a-z]{{2}}-[a-z]{{2}})', 1) END AS locale FROM {_VALUES}",
    "q09_ordinal_per_site": f"SELECT site, source_url, row_number() OVER (PARTITION BY site ORDER BY source_url) - 1 AS ord FROM (SELECT DISTINCT {_H} AS site, source_url FROM {_S})",
    "q10_first_seen": "SELECT page, min(rec_id) AS rec_id, arg_min(slug, rec_id) AS slug FROM (SELECT split_part(source_url, '#', 1) AS page, rec_id, slug FROM manifest_log WHERE source_url IS NOT NULL) GROUP BY page",
    "q11_capped_sites": f"SELECT site, source_url, count(*) OVER (PARTITION BY site) > 5 AS truncated FROM (SELECT DISTINCT {_H} AS site, source_url FROM {_S}) QUALIFY row_number() OVER (PARTITION BY site ORDER BY source_url) <= 5",
    "q24_natural_sort": r"SELECT name, row_number() OVER (ORDER BY list_transform(regexp_extract_all(name, '(\d+|\D+)'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN lpad(p, 20, '0') ELSE lower(p) END), name) AS ord FROM (SELECT DISTINCT p_type || ' ' || p_size AS name FROM part)",
    "q46_system_slugs": rf"""WITH s AS (SELECT slug, source_url, {_N} AS net, regexp_extract(regexp_replace({_P}, '/+$', ''), '([^/]*)$', 1) AS last, list_filter(string_split({_P}, '/'), lambda x: x <> '') AS l,
  list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(source_url, '/[^/]*$', ''), '/HTML$', ''), '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//[^/?#]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '' AND lower(x) NOT IN ('manual', 'manuals', 'html', 'docs')) AS p FROM {_S}),
t AS (SELECT *, CASE WHEN lower(last) LIKE '%.pdf' THEN {_SLUG.format("regexp_replace(last, '(?i)\\.pdf$', '')")} ELSE {_SLUG.format("string_split(regexp_replace(net, '^www\\.', ''), '.')[1]")} END AS pdf, coalesce({_SLUG.format('p[-1]')}, '') AS pub, len(l) >= 2 AND regexp_matches(l[1], '^[a-z]{{2}}(?:-[a-z]{{2,4}})?$') AS named FROM s)
SELECT slug, source_url, CASE WHEN pdf = '' THEN 'manual' ELSE pdf END AS pdf, CASE WHEN pub = '' THEN 'manual' ELSE pub END AS publication, CASE WHEN named THEN l[1] ELSE 'en' END AS language, CASE WHEN named THEN l[2] ELSE 'latest' END AS version FROM t""",
    "q47_folded_slugs": "SELECT title, nullif(" + _SLUG.format(r"regexp_replace(strip_accents(title), '[^\x00-\x7F]', '', 'g')") + ", '') AS title_slug FROM (SELECT DISTINCT title FROM documents WHERE title IS NOT NULL)",
    "q47_repositories": f"SELECT slug, source_url, l[1] AS owner, l[2] AS repo, CASE WHEN len(l) >= 4 AND l[3] = 'tree' THEN l[4] END AS branch, CASE WHEN len(l) >= 4 AND l[3] = 'tree' THEN array_to_string(l[5:], '/') ELSE '' END AS subdir FROM (SELECT slug, source_url, list_filter(string_split({_P}, '/'), lambda x: x <> '') AS l FROM {_S})",
    "q55_image_names": rf"""WITH b AS (SELECT slug, source_url, regexp_extract({_P}, '([^/]*)$', 1) AS base FROM {_S}),
n AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(base, '\.[A-Za-z0-9]+$', ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS stem, lower(regexp_extract(base, '[^.](\.[^./]+)$', 1)) AS suffix FROM b)
SELECT slug, source_url, CASE WHEN stem = '' THEN 'image' ELSE stem END || CASE WHEN suffix = '.jpeg' THEN '.jpg' WHEN suffix IN ('.png', '.jpg', '.gif', '.webp', '.svg') THEN suffix ELSE '' END AS local FROM n""",
}
