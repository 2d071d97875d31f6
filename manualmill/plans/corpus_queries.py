"""Queries on manifests, deliverables, ingests and refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, urls
from ..operators import corpus, images
from ..operators.routing import PATTERNS, registry
from ..session import table
from ..streaming import progress
from .page_queries import _C, _rows


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    return corpus.upgraded(corpus.latest_manifests(table(spark, d, "manifests")))


def q25_manifest_build(spark: SparkSession, d: str) -> DataFrame:
    m = _manifests(spark, d)
    own = _rows(spark, d).select("slug", "kind", F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256")).distinct()
    staged = own.join(m.select("slug", "source_url", "title", "pages", "lost", "truncated", "single_document"), "slug")
    out = corpus.build_manifests(staged, F.lit("2025-01-02 03:04:05").cast("timestamp"), "1.0")
    return out.select("slug", "schema_version", "pattern", "deliverable", "pages", "bytes", "sha256", "ingested_at")


def q25_manifest_latest(spark: SparkSession, d: str) -> DataFrame:
    return _manifests(spark, d).select("slug", "schema_version", "sha256", "ingested_at", "lost", "truncated", "kept_raw")


def q26_duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).select("slug", F.sha2("content", 256).alias("sha256"))
    return corpus.duplicates(rows, "sha256").select("slug", "sha256", "others")


def q27_duplicate_of(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("slug"), F.sha2("text", 256).alias("sha256"))
    return corpus.duplicates(docs, "sha256").select("slug", F.col("first_other").alias("duplicate_of"))


def q28_duplicate_source(spark: SparkSession, d: str) -> DataFrame:
    rows = _manifests(spark, d).select("slug", urls.host(F.col("source_url")).alias("site"))
    return corpus.duplicates(rows, "site").select("slug", "site", "others", "first_other")


def _audited(spark: SparkSession, d: str) -> DataFrame:
    return corpus.audit_all(_manifests(spark, d), _rows(spark, d).select("slug", "content"))


def q29_audit(spark: SparkSession, d: str) -> DataFrame:
    return _audited(spark, d).select("slug", "ord", "check", "level")


def q30_audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return _audited(spark, d).groupBy("check").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))


def q31_lost_share(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("lost"))
    return e.select("user_id", "lost", F.bround(100 * F.col("lost") / F.greatest("n", F.lit(1)), 0).cast("int").alias("share"))


def q32_single_page(spark: SparkSession, d: str) -> DataFrame:
    r = registry(spark).select("pattern", "single_fetch")
    m = _manifests(spark, d).where("kind <> 'pdf' AND NOT single_document AND pages = 1")
    return m.join(F.broadcast(r), "pattern").where("NOT single_fetch").select("slug", "pattern")


def q33_broken_images(spark: SparkSession, d: str) -> DataFrame:
    """References of deliverables to images, where a site has the files that its manuals together name at least twice."""
    refs = _rows(spark, d).select("slug", F.explode(markup.local_images(F.col("content"))).alias("path")).distinct()
    stored = refs.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path")
    have = refs.join(stored, "path", "left_semi")
    return images.broken_references(refs, have)


def q29_audit_with_files(spark: SparkSession, d: str) -> DataFrame:
    """The audit where the files of images are known: those that several manuals name are there."""
    refs = _rows(spark, d).select("slug", F.explode(markup.local_images(F.col("content"))).alias("path")).distinct()
    have = refs.join(refs.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path"), "path", "left_semi")
    return corpus.findings(_manifests(spark, d), _rows(spark, d).select("slug", "content"), have).where("ord > 7").select("slug", "ord", "check", "level")


def _prior_and_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Manifests as they were, and the last ingest of each slug: not changed, changed, or without result."""
    prior = _manifests(spark, d).select("slug", "pattern", "sha256", "etag", "last_modified")
    last = table(spark, d, "ingest_results").where("slug IS NOT NULL").groupBy("slug").agg(F.max(F.struct("ingest_id", "changed", "bytes")).alias("r"))
    new = last.join(prior.select("slug", "sha256"), "slug", "left").select(
        "slug", F.when(F.col("r.changed"), F.sha2(F.col("slug"), 256)).otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("r.bytes").isNull(), "no body").alias("error")
    )
    return prior, new


def q34_refresh_status(spark: SparkSession, d: str) -> DataFrame:
    prior, new = _prior_and_new(spark, d)
    return corpus.refresh_status(prior, new)


def q34_refresh_probed(spark: SparkSession, d: str) -> DataFrame:
    """The refresh with the answers of the validators: the log's records without a hash are answers that nothing changed."""
    prior, new = _prior_and_new(spark, d)
    same = table(spark, d, "manifest_log").where("slug IS NOT NULL AND sha256 IS NULL").select("slug").distinct()
    return corpus.refresh_status(prior, new, same)


def q65_renormalize(spark: SparkSession, d: str) -> DataFrame:
    """Deliverables merged again from their pages, HTML ones with a new separator: what changes, what fails."""
    m = _manifests(spark, d)
    body = F.when(F.col("kind") == "html", F.replace("content", F.lit("</section>"), F.lit("</section>\n"))).otherwise(F.col("content"))
    made = _rows(spark, d).select("slug", F.octet_length(body).cast("bigint").alias("bytes"), F.sha2(body, 256).alias("sha256")).distinct()
    outcomes, after = corpus.renormalized(m, made)
    return outcomes.join(after.select("slug", "sha256", "images"), "slug", "left").select("slug", "status", "error", "sha256", "images")


def q66_localize(spark: SparkSession, d: str) -> DataFrame:
    """One pass over the log's addresses as references, by their lengths: some files are known, some unchanged, some answer."""
    log = table(spark, d, "manifest_log").where("slug IS NOT NULL AND source_url IS NOT NULL")
    refs = log.select("slug", F.col("source_url").alias("url"), F.col("source_url").alias("decoded")).distinct()
    n = F.length("decoded")
    known = refs.where(n % 3 == 0).select("slug", F.col("decoded").alias("source_url"), urls.image_name(F.col("decoded")).alias("local")).distinct().withColumn("on_disk", F.lit(True))
    probes = refs.where(n % 2 == 0).select(F.col("decoded").alias("url"), F.lit(True).alias("not_modified")).distinct()
    got = refs.where(n % 5 != 0).select(F.col("decoded").alias("url"), F.lit(200).alias("status")).distinct()
    return images.localized(refs, known, probes, got).select("slug", "localized", "reused", "remaining")


def q34_refresh_counts(spark: SparkSession, d: str) -> DataFrame:
    prior, new = _prior_and_new(spark, d)
    return corpus.refresh_status(prior, new).groupBy("status").agg(F.count("*").alias("slugs"))


def q35_stale_slugs(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "ingest_results").where("slug IS NOT NULL").select("slug").distinct()
    return have.join(_rows(spark, d).select("slug").distinct(), "slug", "left_anti")


def q36_sidecar_merge(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "manifest_log").where("slug IS NOT NULL AND source_url IS NOT NULL")
    rec = log.select("slug", "source_url", F.col("rec_id").cast("string").alias("local"), "sha256", F.col("rec_id"))
    old = corpus.ranked_latest(rec.where("rec_id % 2 = 0").withColumn("k", F.concat_ws("|", "slug", "source_url")), "k", ["rec_id"]).select("slug", "source_url", "local", "sha256")
    new = corpus.ranked_latest(rec.where("rec_id % 2 = 1").withColumn("k", F.concat_ws("|", "slug", "source_url")), "k", ["rec_id"]).select("slug", "source_url", "local", "sha256")
    return images.merged_sidecar(old, new)


def q37_status_listing(spark: SparkSession, d: str) -> DataFrame:
    return corpus.status_listing(_manifests(spark, d))


def q38_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _manifests(spark, d).groupBy("pattern", "kind").agg(F.count("*").alias("manuals"), F.sum("bytes").alias("bytes"), F.sum("images").alias("images"), F.sum("pages").alias("pages"))


def q54_remote_images(spark: SparkSession, d: str) -> DataFrame:
    """Remote images of documents that name every address of a slug's log as one, after the slug's deliverable."""
    log = table(spark, d, "manifest_log").where("slug IS NOT NULL AND source_url IS NOT NULL")
    named = log.groupBy("slug").agg(F.array_join(F.collect_list(F.concat(F.lit("![a]("), "source_url", F.lit(")"))), "\n").alias("names"))
    rows = _rows(spark, d).join(named, "slug").select("slug", F.concat("content", F.lit("\n"), "names").alias("content"))
    return rows.select("slug", F.size(markup.remote_images(F.col("content"))).cast("bigint").alias("remote")).distinct()


def q56_image_actions(spark: SparkSession, d: str) -> DataFrame:
    """The log's URLs as references, its earlier records as sidecar, and its NULL hashes as answers of 304."""
    log = table(spark, d, "manifest_log").where("slug IS NOT NULL AND source_url IS NOT NULL")
    refs = log.select("slug", F.col("source_url").alias("url"), F.col("source_url").alias("decoded")).distinct()
    side = log.where("bytes IS NOT NULL").groupBy("slug", "source_url").agg(F.min("rec_id").cast("string").alias("local")).withColumn("on_disk", F.length("local") > 2)
    probes = log.select(F.col("source_url").alias("url"), F.col("sha256").isNull().alias("not_modified"))
    return images.classified(refs, side, probes).select("slug", "url", "local", "action")


def q57_tumbling(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("ts IS NOT NULL")
    return progress.tumbling(e, "ts", "event_type", "1 day")


def q57_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("ts IS NOT NULL")
    return progress.sessions(e, "ts", "user_id", "6 hours")


QUERIES = {f.__name__: f for f in (q25_manifest_build, q25_manifest_latest, q26_duplicate_content, q27_duplicate_of, q28_duplicate_source, q29_audit, q29_audit_with_files, q30_audit_summary, q31_lost_share, q32_single_page, q33_broken_images, q34_refresh_status, q34_refresh_probed, q34_refresh_counts, q35_stale_slugs, q36_sidecar_merge, q37_status_listing, q38_rollup, q54_remote_images, q56_image_actions, q65_renormalize, q66_localize, q57_tumbling, q57_sessions)}

from .url_queries import _HOST, _NET, _case  # noqa: E402

_M = """(SELECT * EXCLUDE (truncated, single_document, kept_raw, lost, schema_version, n), coalesce(truncated, false) AS truncated, coalesce(single_document, false) AS single_document, coalesce(kept_raw, false) AS kept_raw, coalesce(lost, 0) AS lost, 6 AS schema_version
FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY ingested_at DESC NULLS LAST, sha256 DESC NULLS LAST) AS n FROM (SELECT DISTINCT * FROM manifests WHERE slug IS NOT NULL)) WHERE n = 1)"""
_SINGLE = ", ".join(f"'{p.name}'" for p in PATTERNS if p.single_fetch)
_KNOWN = ", ".join(f"'{p.name}'" for p in PATTERNS)
_DUP = "SELECT {slug} AS slug, {v}, n - 1 AS others, CASE WHEN slug = a[1] THEN a[2] ELSE a[1] END AS first_other FROM (SELECT slug, {v}, count(*) OVER w AS n, list(slug) OVER (PARTITION BY {v} ORDER BY slug ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a FROM (SELECT DISTINCT slug, {v} FROM {t} WHERE {v} IS NOT NULL) WINDOW w AS (PARTITION BY {v})) WHERE n > 1"
_REMOTE = r"""len(list_distinct(regexp_extract_all(content, '(?i)(?:<img\b[^>]*?\bsrc=["'']|!\[[^\]]*\]\()(https?://[^"'')\s]+)', 1)))"""
_LOCAL = r"""list_distinct(regexp_extract_all(content, '(?:src=["'']|\]\()(images/[^"'')\s]+)', 1))"""
_HEADS = r"CASE kind WHEN 'markdown' THEN len(regexp_extract_all(content, '(?m)^#{1,6} ')) ELSE len(regexp_extract_all(content, '(?i)<h[1-6][\s>]')) END"
_AUDIT = f"""WITH m AS {_M}, b AS (SELECT coalesce(m.slug, c.slug) AS slug, m.* EXCLUDE (slug), c.content, m.slug IS NULL AS gone FROM m FULL JOIN (SELECT slug, content FROM {_C}) c USING (slug)),
live AS (SELECT * FROM b WHERE NOT gone AND content IS NOT NULL AND content <> ''),
dup AS ({_DUP.format(slug='slug', v='sha256', t='m')}), dups AS ({_DUP.format(slug='slug', v='source_url', t='m')}),
f AS (
SELECT slug, 1 AS ord, 'manifest_missing' AS "check", 'error' AS level FROM b WHERE gone
UNION ALL SELECT slug, 2, 'deliverable_missing', 'error' FROM b WHERE NOT gone AND content IS NULL
UNION ALL SELECT slug, 3, 'deliverable_empty', 'error' FROM b WHERE NOT gone AND content = ''
UNION ALL SELECT slug, 4, 'sha_mismatch', 'error' FROM live WHERE sha256(content) <> coalesce(nullif(localized_sha256, ''), CASE WHEN images = 0 THEN sha256 END)
UNION ALL SELECT slug, 5, 'crawl_truncated', 'error' FROM live WHERE truncated
UNION ALL SELECT slug, 6, 'pages_lost', 'error' FROM live WHERE lost > 0
UNION ALL SELECT slug, 7, 'single_page_crawl', 'error' FROM live WHERE kind <> 'pdf' AND pattern IN ({_KNOWN}) AND pattern NOT IN ({_SINGLE}) AND NOT single_document AND pages = 1
UNION ALL SELECT slug, 8, 'localize_incomplete', 'warning' FROM live WHERE kind IN ('markdown', 'html') AND images > 0 AND {_REMOTE} > 0
UNION ALL SELECT slug, 9, 'broken_image_ref', 'error' FROM live WHERE kind IN ('markdown', 'html') AND len({_LOCAL}) > 0
UNION ALL SELECT slug, 10, 'no_headings', 'warning' FROM live WHERE kind IN ('markdown', 'html') AND pages > 1 AND {_HEADS} = 0
UNION ALL SELECT slug, 11, 'duplicate_content', 'warning' FROM dup UNION ALL SELECT slug, 12, 'duplicate_source_url', 'error' FROM dups)"""
_FILES = f"""i AS (SELECT DISTINCT slug, unnest({_LOCAL}) AS path FROM {_C}), h AS (SELECT slug, path FROM i WHERE path IN (SELECT path FROM i GROUP BY path HAVING count(*) > 1))"""
_LATE = f"""WITH m AS {_M}, {_FILES}, live AS (SELECT m.*, content FROM m JOIN {_C} c USING (slug) WHERE content <> '' AND m.kind IN ('markdown', 'html'))
SELECT slug, 8 AS ord, 'localize_incomplete' AS "check", 'warning' AS level FROM live WHERE (images > 0 OR slug IN (SELECT slug FROM h)) AND {_REMOTE} > 0
UNION ALL SELECT slug, 9, 'broken_image_ref', 'error' FROM live WHERE slug IN (SELECT slug FROM (FROM i EXCEPT FROM h))
UNION ALL SELECT slug, 10, 'no_headings', 'warning' FROM live WHERE pages > 1 AND {_HEADS.replace('CASE kind', 'CASE live.kind')} = 0"""
_REFRESH = f"""WITH m AS {_M}, l AS (SELECT slug, max(struct_pack(i := ingest_id, c := changed, b := bytes)) AS r FROM ingest_results WHERE slug IS NOT NULL GROUP BY slug),
s AS (SELECT coalesce(m.slug, l.slug) AS slug, CASE WHEN m.slug IS NULL THEN 'skipped' WHEN l.slug IS NULL OR r.b IS NULL OR coalesce(CASE WHEN r.c THEN sha256(m.slug) ELSE m.sha256 END, '') = '' THEN 'failed'
  WHEN coalesce(CASE WHEN r.c THEN sha256(m.slug) ELSE m.sha256 END <> m.sha256, true) THEN 'changed' ELSE 'unchanged' END AS status FROM m FULL JOIN l ON m.slug = l.slug)"""

SQL = {
    "q25_manifest_build": f"WITH m AS {_M} SELECT slug, 6 AS schema_version, {_case('source_url')} AS pattern, slug || '.' || CASE c.kind WHEN 'markdown' THEN 'md' ELSE c.kind END AS deliverable, pages, strlen(content)::BIGINT AS bytes, sha256(content) AS sha256, '2025-01-02T03:04:05Z' AS ingested_at FROM {_C} c JOIN m USING (slug)",
    "q25_manifest_latest": f"SELECT slug, schema_version, sha256, ingested_at, lost, truncated, kept_raw FROM {_M}",
    "q26_duplicate_content": f"SELECT slug, sha256, others FROM ({_DUP.format(slug='slug', v='sha256', t=f'(SELECT slug, sha256(content) AS sha256 FROM {_C})')})",
    "q27_duplicate_of": f"SELECT slug, first_other AS duplicate_of FROM ({_DUP.format(slug='slug', v='sha256', t='(SELECT doc_id::VARCHAR AS slug, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL)')})",
    "q28_duplicate_source": _DUP.format(slug="slug", v="site", t=f"(SELECT slug, {_HOST.format(u='source_url')} AS site FROM {_M})"),
    "q29_audit": _AUDIT + ' SELECT slug, ord, "check", level FROM f',
    "q30_audit_summary": _AUDIT + " SELECT \"check\", count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings FROM f GROUP BY 1",
    "q31_lost_share": "SELECT user_id, count(*) FILTER (event_type = 'error') AS lost, round_even(100 * count(*) FILTER (event_type = 'error') / greatest(count(*), 1), 0)::INT AS share FROM events GROUP BY user_id",
    "q32_single_page": f"SELECT slug, pattern FROM {_M} WHERE kind <> 'pdf' AND NOT single_document AND pages = 1 AND pattern IN ({_KNOWN}) AND pattern NOT IN ({_SINGLE})",
    "q29_audit_with_files": _LATE,
    "q33_broken_images": f"WITH {_FILES} SELECT slug, path FROM i EXCEPT SELECT slug, path FROM h",
    "q34_refresh_probed": _REFRESH.replace("CASE WHEN m.slug IS NULL THEN 'skipped' WHEN", f"CASE WHEN m.slug IS NULL THEN 'skipped' WHEN m.pattern IN ({_SINGLE}) AND coalesce(m.etag, m.last_modified, '') <> '' AND m.slug IN (SELECT slug FROM manifest_log WHERE sha256 IS NULL AND slug IS NOT NULL) THEN 'unchanged' WHEN") + " SELECT * FROM s",
    "q65_renormalize": f"""WITH m AS {_M}, c AS (SELECT slug, CASE WHEN kind = 'html' THEN replace(content, '</section>', '</section>' || chr(10)) ELSE content END AS b FROM {_C}),
r AS (SELECT coalesce(m.slug, c.slug) AS slug, CASE WHEN m.slug IS NULL THEN 'no manifest' WHEN NOT kept_raw THEN 'no raw pages are kept' WHEN pattern IS NULL OR pattern NOT IN ({_KNOWN}) THEN 'the pattern is unknown' WHEN coalesce(strlen(b), 0) = 0 THEN 'empty output' END AS error, sha256(b) AS s, m.sha256 AS o, images FROM m FULL JOIN c ON m.slug = c.slug)
SELECT slug, CASE WHEN error IS NOT NULL THEN 'failed' WHEN s = o THEN 'unchanged' ELSE 'changed' END AS status, error, CASE WHEN error IS NULL AND coalesce(s <> o, true) THEN s ELSE o END AS sha256, CASE WHEN error IS NULL AND coalesce(s <> o, true) THEN 0 ELSE images END AS images FROM r""",
    "q34_refresh_status": _REFRESH + " SELECT * FROM s",
    "q34_refresh_counts": _REFRESH + " SELECT status, count(*) AS slugs FROM s GROUP BY status",
    "q35_stale_slugs": f"SELECT DISTINCT slug FROM ingest_results WHERE slug IS NOT NULL AND slug NOT IN (SELECT slug FROM {_C})",
    "q36_sidecar_merge": "SELECT slug, source_url, rec_id::VARCHAR AS local, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY slug, source_url ORDER BY rec_id % 2 DESC, rec_id DESC) AS n FROM (SELECT DISTINCT slug, source_url, rec_id, sha256 FROM manifest_log WHERE slug IS NOT NULL AND source_url IS NOT NULL)) WHERE n = 1",
    "q37_status_listing": f"SELECT slug, deliverable, pattern, coalesce(pages::VARCHAR, '-') AS pages, CASE WHEN bytes < 1024 THEN printf('%.0f B', bytes::DOUBLE) WHEN bytes < 1048576 THEN printf('%.1f KB', bytes / 1024.0::DOUBLE) WHEN bytes < 1073741824 THEN printf('%.1f MB', bytes / 1048576.0::DOUBLE) ELSE printf('%.1f GB', bytes / 1073741824.0::DOUBLE) END AS size, CASE WHEN kept_raw THEN 'raw' ELSE '' END AS raw, left(ingested_at, 10) AS day, CASE WHEN {_NET.format(u='source_url')} = '' THEN '-' ELSE {_NET.format(u='source_url')} END AS host FROM {_M}",
    "q38_rollup": f"SELECT pattern, kind, count(*) AS manuals, sum(bytes)::BIGINT AS bytes, sum(images)::BIGINT AS images, sum(pages)::BIGINT AS pages FROM {_M} GROUP BY ALL",
    "q54_remote_images": f"WITH u AS (SELECT slug, string_agg('![a](' || source_url || ')', chr(10)) AS names FROM manifest_log WHERE slug IS NOT NULL AND source_url IS NOT NULL GROUP BY slug) SELECT slug, {_REMOTE} AS remote FROM (SELECT slug, content || chr(10) || names AS content FROM {_C} JOIN u USING (slug))",
    "q66_localize": """WITH l AS (SELECT DISTINCT slug, source_url AS u, length(source_url) AS n FROM manifest_log WHERE slug IS NOT NULL AND source_url IS NOT NULL)
SELECT slug, count(*) FILTER (NOT r AND n % 5 <> 0) AS localized, count(*) FILTER (r) AS reused, count(*) FILTER (NOT r AND n % 5 = 0) AS remaining FROM (SELECT *, n % 3 = 0 AND n % 2 = 0 AS r FROM l) GROUP BY slug""",
    "q56_image_actions": """WITH l AS (SELECT * FROM manifest_log WHERE slug IS NOT NULL AND source_url IS NOT NULL), r AS (SELECT DISTINCT slug, source_url AS url FROM l),
s AS (SELECT slug, source_url AS url, min(rec_id)::VARCHAR AS local FROM l WHERE bytes IS NOT NULL GROUP BY ALL), p AS (SELECT source_url AS url, bool_or(sha256 IS NULL) AS nm FROM l GROUP BY 1)
SELECT slug, url, local, CASE WHEN local IS NULL OR length(local) <= 2 THEN 'download' WHEN nm THEN 'reuse' ELSE 'supersede' END AS action FROM r LEFT JOIN s USING (slug, url) LEFT JOIN p USING (url)""",
    "q57_tumbling": "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "q57_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
}
