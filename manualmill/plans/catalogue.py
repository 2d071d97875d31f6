"""All registered queries outside the optional subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.incremental import ChangeFeed
from ..session import scratch, table
from . import acquire_queries, corpus_queries, page_queries, source_queries, url_queries

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each successful run the slugs it must process: what the job commits that catches up with all runs."""
    feed = ChangeFeed(spark, scratch(spark, "p2"))
    feed.catch_up(table(spark, sf_dir, "manifest_log"), table(spark, sf_dir, "refresh_runs"))
    return feed.changes().select("run_id", "slug")


_P2 = r"""
WITH ok AS (SELECT run_id, started_at, lag(started_at) OVER (ORDER BY started_at) AS before FROM (SELECT DISTINCT * FROM refresh_runs) WHERE status = 'ok'),
log AS (
  SELECT DISTINCT rec_id, slug, coalesce(ingested_at, '') AS ingested_at, arrived_at, nullif(lower(trim(sha256)), '') AS sha,
    nullif(regexp_replace(regexp_replace(trim(etag), '^[Ww]/', ''), '^"|"$', '', 'g'), '') AS etag,
    coalesce(try_strptime(last_modified, '%a, %d %b %Y %H:%M:%S GMT'), try_strptime(last_modified, '%A, %d-%b-%y %H:%M:%S GMT'),
      try_strptime(last_modified, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(last_modified, '%a %b %d %H:%M:%S %Y')) AS modified
  FROM manifest_log WHERE slug IS NOT NULL),
now AS (SELECT run_id, slug, max(struct_pack(i := ingested_at, r := rec_id, s := sha, e := etag, m := modified)) AS c FROM ok JOIN log ON arrived_at <= started_at GROUP BY ALL),
prev AS (SELECT run_id, slug, max(struct_pack(i := ingested_at, r := rec_id, s := sha, e := etag, m := modified)) AS p FROM ok JOIN log ON arrived_at <= before GROUP BY ALL)
SELECT run_id, slug FROM now LEFT JOIN prev USING (run_id, slug)
WHERE p IS NULL OR (c.r <> p.r AND CASE WHEN c.s IS NOT NULL AND p.s IS NOT NULL THEN c.s <> p.s WHEN c.e IS NOT NULL AND p.e IS NOT NULL THEN c.e <> p.e
  WHEN c.m IS NOT NULL AND p.m IS NOT NULL THEN c.m <> p.m ELSE true END)
"""

QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    **url_queries.QUERIES,
    **page_queries.QUERIES,
    **corpus_queries.QUERIES,
    **source_queries.QUERIES,
    **acquire_queries.QUERIES,
}
SQL: dict[str, str] = {"p2_found": _P2, **url_queries.SQL, **page_queries.SQL, **corpus_queries.SQL, **source_queries.SQL, **acquire_queries.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manuals built from their pages."""
    return page_queries.q01_manual_build(spark, sf_dir)
