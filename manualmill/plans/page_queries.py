"""Queries on the pages and texts of manuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..operators import merge, ordering
from ..session import table
from ..sources import profiles

_BREAK = r"\n\n---\n\n"


def _rows(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    """(slug, kind, content) as delivered; for scalars of a content it is cheaper to drop repeated rows after them."""
    rows = table(spark, d, "deliverables").where("slug IS NOT NULL AND content IS NOT NULL")
    rows = rows.where(F.col("kind") == kind) if kind else rows
    return rows.select("slug", "kind", "content")


def _contents(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    """(slug, kind, content), each manual once."""
    return _rows(spark, d, kind).distinct()


def pages_of(contents: DataFrame) -> DataFrame:
    """(slug, ord, body): the pages of HTML deliverables, which are their sections."""
    sections = F.regexp_extract_all("content", F.lit(r"(?s)<section>(.*?)</section>"), F.lit(1))
    return contents.where("kind = 'html'").select("slug", F.posexplode(sections).alias("ord", "body"))


def q01_manual_build(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: pages of a manual, cleaned of scripts, numbered, merged in order and hashed."""
    pages = pages_of(_contents(spark, d)).withColumn("body", F.trim(markup.strip_scripts(F.col("body"))))
    merged = merge.merge_markdown(pages, ["slug"], "ord", "body")
    return merged.select("slug", F.col("pages").cast("bigint").alias("pages"), F.length("content").cast("bigint").alias("chars"), F.sha2("content", 256).alias("sha256"))


def q12_crawl_counters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("user_id IS NOT NULL")
    return merge.crawl_counters(e, ["user_id"], F.col("event_type") != "error", F.col("event_type") == "purchase")


def q13_attempt_and_saved(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    out = ordering.attempt_and_saved(e, ["user_id"], ["ts", "event_id"], F.col("event_type") != "error")
    return out.select("event_id", F.col("attempt").cast("bigint").alias("attempt"), F.col("saved").cast("bigint").alias("saved"))


def q14_idle_gaps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return ordering.idle_gaps(e, ["user_id"], "ts", "event_id", 6 * 3600).select("event_id", "user_id", F.col("gap_s").cast("bigint").alias("gap_s"))


def _toc(spark: SparkSession, d: str) -> DataFrame:
    """Events as a table of topics: signups are branches, errors leaves that were lost."""
    return table(spark, d, "events").select(
        "user_id", "event_id", (F.col("event_type") != "signup").alias("leaf"), (F.col("event_type") != "error").alias("staged"), F.concat(F.lit("Part "), F.col("event_id").cast("string")).alias("title")
    )


def q15_carried_headings(spark: SparkSession, d: str) -> DataFrame:
    out = ordering.carried_forward(_toc(spark, d), ["user_id"], "event_id", F.col("leaf"), F.col("staged"), "title")
    return out.select("user_id", "event_id", F.array_join("headings", "\n").alias("headings"))


def q16_strip_scripts(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("slug", F.sha2(markup.strip_scripts(F.col("content")), 256).alias("sha256")).distinct()


def q17_page_title(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d, "html").select("slug", markup.page_title(F.col("content")).alias("title")).distinct()


def q18_headings(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("slug", "kind", markup.heading_count(F.col("content"), F.col("kind")).alias("headings")).distinct()


def q19_visible_chars(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("slug", F.length(markup.visible_text(F.col("content"))).cast("bigint").alias("chars")).distinct()


def q20_absolutize(spark: SparkSession, d: str) -> DataFrame:
    out = markup.absolutize_root(F.col("content"), F.lit("https://origin.example"))
    return _rows(spark, d).select("slug", F.sha2(out, 256).alias("sha256")).distinct()


def q21_link_inventory(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).select("slug", markup.links(F.col("content")).alias("l")).where(F.size("l") > 0)
    return rows.select("slug", F.size("l").cast("bigint").alias("links"), F.size(F.array_distinct("l")).cast("bigint").alias("targets")).distinct()


def q22_best_image(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every order as the candidates of one image: by width, by density, by the size in the address, or plain."""
    n = F.col("l_linenumber")
    size = F.col("l_quantity").cast("int").cast("string")
    url = F.concat(F.lit("/i"), F.col("l_partkey").cast("string"), F.lit(".png"))
    part = (
        F.when(n % 4 == 0, F.concat(url, F.lit(" "), size, F.lit("w"))).when(n % 4 == 1, F.concat(url, F.lit("?WID="), size))
        .when(n % 4 == 2, F.concat(url, F.lit(" "), size, F.lit("x"))).otherwise(url)
    )
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", part.alias("p"))))["p"]
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(lines, ", ").alias("srcset"))
    return rows.select("l_orderkey", markup.best_candidate(markup.srcset_candidates(F.col("srcset"), 4)).alias("best"))


_TOP = "> ## Documentation Index\n> Fetch the index\n\n"
_END = "\n\n---\n\n## Agent Instructions: Querying This Documentation\n\nmore"


def q23_banner_and_footer(spark: SparkSession, d: str) -> DataFrame:
    """Markdown manuals between the banner of an index and a section for agents, without them again."""
    body = F.concat(F.lit(_TOP), "content", F.lit(_END))
    out = markup.strip_agent_footer(markup.strip_index_banner(body))
    return _rows(spark, d, "markdown").select("slug", F.sha2(out, 256).alias("sha256")).distinct()


def q41_merge_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Pages of Markdown manuals put together again are the manual."""
    pages = _contents(spark, d, "markdown").select("slug", F.posexplode(F.split("content", _BREAK)).alias("ord", "body"))
    out = merge.merge_markdown(pages, ["slug"], "ord", "body")
    return out.select("slug", F.col("pages").cast("bigint").alias("pages"), F.sha2("content", 256).alias("sha256"))


def q41_merge_html(spark: SparkSession, d: str) -> DataFrame:
    pages = pages_of(_contents(spark, d)).withColumn("title", F.regexp_extract("body", r"<h[1-6]>([^<]*)</h[1-6]>", 1))
    out = merge.merge_html(pages, ["slug"], "ord", "body", "title", suffix=" Help")
    return out.select("slug", F.col("pages").cast("bigint").alias("pages"), F.sha2("content", 256).alias("sha256"))


def q44_table_order(spark: SparkSession, d: str) -> DataFrame:
    """Manuals of a source in the order of a table of contents that lists some of them."""
    pages = table(spark, d, "documents").where("slug IS NOT NULL AND source IS NOT NULL").select("source", "slug").distinct()
    logged = table(spark, d, "ingest_results").where("slug IS NOT NULL").groupBy("slug").agg(F.min("ingest_id").cast("int").alias("ord"))
    toc = pages.join(logged, "slug").where("ord % 2 = 0").select("source", "slug", "ord", F.lit(3).alias("level"))
    return merge.in_table_order(pages, toc, ["source"], "slug").select("source", "slug", "level", "ord")


def q45_extract_section(spark: SparkSession, d: str) -> DataFrame:
    """The article of each HTML page, cut out of a page around it by the DOM, is the article."""
    page = F.concat(F.lit("<html><body><nav>menu</nav><article><nav>path</nav>"), "body", F.lit("<script>run()</script></article></body></html>"))
    rows = pages_of(_contents(spark, d)).select("slug", F.col("ord").cast("bigint").alias("ord"), profiles.extract_column(page, F.lit("https://origin.example/a/"), "docusaurus").alias("html"))
    # References are decoded by the DOM, so what is compared are the letters outside of them.
    letters = F.regexp_replace(F.regexp_replace(markup.visible_text(F.col("html")), r"&#?[A-Za-z0-9]+;", ""), "[^A-Za-z]", "")
    return rows.select("slug", "ord", F.sha2(letters, 256).alias("letters"))


QUERIES = {f.__name__: f for f in (q01_manual_build, q12_crawl_counters, q13_attempt_and_saved, q14_idle_gaps, q15_carried_headings, q16_strip_scripts, q17_page_title, q18_headings, q19_visible_chars, q20_absolutize, q21_link_inventory, q22_best_image, q23_banner_and_footer, q41_merge_markdown, q41_merge_html, q44_table_order, q45_extract_section)}

_C = "(SELECT DISTINCT slug, kind, content FROM deliverables WHERE slug IS NOT NULL AND content IS NOT NULL)"
_STRIP = r"regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript\s*>', '', 'g')"
_SECT = rf"(SELECT slug, unnest(l) AS body, unnest(range(len(l))) AS ord FROM (SELECT slug, regexp_extract_all(content, '(?s)<section>(.*?)</section>', 1) AS l FROM {_C} WHERE kind = 'html'))"
_UNESC = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"
_TITLE = "trim(" + _UNESC.format("regexp_extract(content, '(?is)<title[^>]*>(.*?)</title>', 1)") + ")"
_VIS = r"trim(regexp_replace(regexp_replace(" + _STRIP + r", '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"

SQL = {
    "q01_manual_build": f"SELECT slug, count(*) AS pages, length(c) AS chars, sha256(c) AS sha256 FROM (SELECT slug, string_agg(trim({_STRIP.format('body')}, ' '), chr(10)||chr(10)||'---'||chr(10)||chr(10) ORDER BY ord) OVER (PARTITION BY slug ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c FROM {_SECT}) GROUP BY slug, c",
    "q12_crawl_counters": "SELECT user_id, count(*) FILTER (event_type <> 'error') AS pages, count(*) FILTER (NOT coalesce(event_type <> 'error', false)) AS lost, coalesce(bool_or(event_type = 'purchase'), false) AS truncated FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
    "q13_attempt_and_saved": "SELECT event_id, row_number() OVER w - 1 AS attempt, CASE WHEN event_type <> 'error' THEN (sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT END AS saved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "q14_idle_gaps": "SELECT event_id, user_id, g AS gap_s FROM (SELECT event_id, user_id, ((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 1000000)::BIGINT AS g FROM events) WHERE g > 21600",
    "q15_carried_headings": "WITH t AS (SELECT user_id, event_id, event_type <> 'signup' AS leaf, event_type NOT IN ('error', 'signup') AS staged, 'Part ' || event_id AS title, sum((event_type NOT IN ('error', 'signup'))::INT) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS g FROM events) SELECT user_id, max(event_id) FILTER (staged) AS event_id, coalesce(string_agg(title, chr(10) ORDER BY event_id) FILTER (NOT leaf), '') AS headings FROM t WHERE g > 0 AND (staged OR NOT leaf) GROUP BY user_id, g",
    "q16_strip_scripts": f"SELECT slug, sha256({_STRIP.format('content')}) AS sha256 FROM {_C}",
    "q17_page_title": f"SELECT slug, CASE WHEN {_TITLE} <> '' THEN {_TITLE} END AS title FROM {_C} WHERE kind = 'html'",
    "q18_headings": rf"SELECT slug, kind, CASE kind WHEN 'markdown' THEN len(regexp_extract_all(content, '(?m)^#{{1,6}} ')) WHEN 'html' THEN len(regexp_extract_all(content, '(?i)<h[1-6][\s>]')) ELSE 0 END::BIGINT AS headings FROM {_C}",
    "q19_visible_chars": f"SELECT slug, length({_VIS.format('content')})::BIGINT AS chars FROM {_C}",
    "q20_absolutize": r"""SELECT slug, sha256(regexp_replace(regexp_replace(content, '\]\((/[^)]*)\)', '](https://origin.example\1)', 'g'), '((?:src|href)=["''])(/[^"'']*)', '\1https://origin.example\2', 'g')) AS sha256 FROM """ + _C,
    "q21_link_inventory": "SELECT slug, count(*) AS links, count(DISTINCT href) AS targets FROM (SELECT slug, unnest(regexp_extract_all(content, 'href=\"([^\"]*)\"', 1)) AS href FROM " + _C + ") GROUP BY slug",
    "q22_best_image": """WITH c AS (SELECT l_orderkey, l_quantity::INT AS q, l_linenumber % 4 AS k, '/i' || l_partkey || '.png' AS u FROM lineitem)
SELECT l_orderkey, max(struct_pack(w := CASE WHEN k < 2 THEN q ELSE 0 END, x := CASE WHEN k = 2 THEN q ELSE 0 END, u := CASE WHEN k = 1 THEN u || '?WID=' || q ELSE u END)).u AS best FROM c GROUP BY l_orderkey""",
    "q23_banner_and_footer": rf"""WITH t AS (SELECT slug, '> ## Documentation Index' || chr(10) || '> Fetch the index' || chr(10) || chr(10) || content || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Agent Instructions: Querying This Documentation' || chr(10) || chr(10) || 'more' AS body FROM {_C} WHERE kind = 'markdown'),
b AS (SELECT slug, regexp_replace(body, '(?m)^(?:> ## Documentation Index[^\n]*\n(?:>[^\n]*\n?)*|> For the complete documentation index[^\n]*\n)\n*', '', 'g') AS body FROM t),
f AS (SELECT slug, regexp_replace(regexp_replace(body, '(?s)\n#{{1,6}}\s+Agent Instructions(?::\s+Querying This Documentation)?\s*\n.*$', ''), '\s+$', '') AS body FROM b)
SELECT slug, sha256(CASE WHEN body LIKE '%---' THEN regexp_replace(regexp_replace(body, '---$', ''), '\s+$', '') ELSE body END) AS sha256 FROM f""",
    "q41_merge_markdown": f"SELECT slug, len(string_split(content, chr(10)||chr(10)||'---'||chr(10)||chr(10)))::BIGINT AS pages, sha256(content) AS sha256 FROM {_C} WHERE kind = 'markdown'",
    "q41_merge_html": f"""WITH s AS (SELECT slug, body, ord, regexp_extract(body, '<h[1-6]>([^<]*)</h[1-6]>', 1) AS t FROM {_SECT}),
g AS (SELECT slug, count(*) AS pages, string_agg(body, chr(10) ORDER BY ord) AS b, {_ESC.format("arg_min(t, ord) || ' Help'")} AS name FROM s GROUP BY slug)
SELECT slug, pages, sha256('<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>' || name || '</title></head><body>' || chr(10) || '<h1>' || name || '</h1>' || chr(10) || b || chr(10) || '</body></html>' || chr(10)) AS sha256 FROM g""",
    "q44_table_order": "WITH p AS (SELECT DISTINCT source, slug FROM documents WHERE slug IS NOT NULL AND source IS NOT NULL), l AS (SELECT slug, min(ingest_id) AS o FROM ingest_results WHERE slug IS NOT NULL GROUP BY slug HAVING min(ingest_id) % 2 = 0) SELECT source, slug, (CASE WHEN o IS NULL THEN 2 ELSE 3 END)::INT AS level, row_number() OVER (PARTITION BY source ORDER BY (o IS NULL)::INT, coalesce(o, 0), slug) - 1 AS ord FROM p LEFT JOIN l USING (slug)",
    "q45_extract_section": rf"SELECT slug, ord, sha256(regexp_replace(regexp_replace({_VIS.format('body')}, '&#?[A-Za-z0-9]+;', '', 'g'), '[^A-Za-z]', '', 'g')) AS letters FROM {_SECT}",
}
