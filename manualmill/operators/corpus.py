"""Operators on the corpus: manifests, audit, duplicates, refresh, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, urls
from .routing import PATTERNS

SCHEMA_VERSION = 6
# The fields of a manifest in their order.
MANIFEST_FIELDS = (
    "schema_version tool_version source_url pattern slug kind title etag last_modified truncated single_document kept_raw lost "
    "localized_sha256 deliverable pages bytes sha256 images ingested_at"
).split()


def latest_manifests(manifests: DataFrame) -> DataFrame:
    """The manifest that holds for each slug: the row of the latest ingested_at, of equal ones the greatest sha256.

    A grouped maximum, so repeated rows and hot slugs combine map-side.  Rows without slug are dropped.
    """
    rest = [c for c in manifests.columns if c not in ("slug", "ingested_at", "sha256")]
    rank = F.struct("ingested_at", "sha256", *rest)
    out = manifests.where("slug IS NOT NULL").groupBy("slug").agg(F.max(rank).alias("m"))
    return out.select(*[F.col("slug") if c == "slug" else F.col(f"m.{c}").alias(c) for c in manifests.columns])


def upgraded(manifests: DataFrame) -> DataFrame:
    """Manifests of any version in the shape of the present one: keys that came later get their defaults."""
    defaults = {"truncated": False, "single_document": False, "kept_raw": False, "lost": 0}
    out = manifests
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out.withColumn("schema_version", F.lit(SCHEMA_VERSION)).select(*MANIFEST_FIELDS)


def manifest_json(row_fields: list[str] = MANIFEST_FIELDS) -> Column:
    """A manifest as JSON with its keys in order and NULLs kept."""
    return F.to_json(F.struct(*row_fields), {"ignoreNullFields": "false"})


def read_manifest(text: Column) -> Column:
    """The struct of a manifest's JSON; NULL if the text is missing, broken or no object."""
    schema = (
        "schema_version int, tool_version string, source_url string, pattern string, slug string, kind string, title string, etag string, "
        "last_modified string, truncated boolean, single_document boolean, kept_raw boolean, lost int, localized_sha256 string, "
        "deliverable string, pages int, bytes bigint, sha256 string, images int, ingested_at string"
    )
    parsed = F.from_json(text, schema)
    return F.when(F.ltrim(text).startswith("{") & parsed["slug"].isNotNull(), parsed)


def build_manifests(staged: DataFrame, now: Column, tool_version: str) -> DataFrame:
    """Manifest rows of staged deliverables (source_url, slug, kind, title, pages, lost, truncated, single_document) with
    their content, or with its bytes and sha256 if these are known already."""
    ext = F.when(F.col("kind") == "markdown", "md").otherwise(F.col("kind"))
    known = "sha256" in staged.columns
    size = F.col("bytes") if known else F.octet_length("content").cast("bigint")
    return staged.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(tool_version).alias("tool_version"), "source_url", _pattern().alias("pattern"), "slug", "kind", "title",
        F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), "truncated", "single_document", F.lit(False).alias("kept_raw"), "lost",
        F.lit(None).cast("string").alias("localized_sha256"), F.concat("slug", F.lit("."), ext).alias("deliverable"), "pages", size.alias("bytes"),
        (F.col("sha256") if known else F.sha2("content", 256)).alias("sha256"), F.lit(0).alias("images"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ingested_at"),
    )


def _pattern() -> Column:
    from .routing import classify

    return classify(F.col("source_url"))


def duplicates(rows: DataFrame, value: str, slug: str = "slug") -> DataFrame:
    """(slug, value, others, first_other): slugs that share a value with others; others counts them, first_other is the
    first by name.

    Built from a grouped count, minimum and second minimum, so a value that a third of the slugs share never
    gathers its members.  NULL values and repeated rows don't count.
    """
    own = rows.where(F.col(value).isNotNull() & F.col(slug).isNotNull()).select(slug, value).distinct()
    least = own.groupBy(value).agg(F.count("*").alias("_n"), F.min(slug).alias("_1")).where("_n > 1")
    second = own.join(least.select(value, "_1"), value).where(F.col(slug) > F.col("_1")).groupBy(value).agg(F.min(slug).alias("_2"))
    both = least.join(second, value)
    first = F.when(F.col(slug) == F.col("_1"), F.col("_2")).otherwise(F.col("_1"))
    return own.join(both, value).select(slug, value, (F.col("_n") - 1).alias("others"), first.alias("first_other"))


def measured(contents: DataFrame) -> DataFrame:
    """(slug, hash, bytes, remote, local, md_heads, html_heads): all that an audit looks at, so that no text is shuffled.

    contents is (slug, content) as delivered; a repeated row counts once, a NULL content has a NULL hash.
    """
    c = F.col("content")
    return contents.where("slug IS NOT NULL").select(
        "slug", F.sha2(c, 256).alias("hash"), F.octet_length(c).cast("bigint").alias("bytes_now"), F.size(markup.remote_images(c)).alias("remote"), markup.local_images(c).alias("local"),
        F.regexp_count(c, F.lit(markup.MARKDOWN_HEADING)).alias("md_heads"), F.regexp_count(c, F.lit(markup.HTML_HEADING)).alias("html_heads"),
    ).distinct()


def findings(manifests: DataFrame, contents: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(slug, ord, check, level, detail): what an audit finds in each slug, in the order of the checks.

    manifests holds one row a slug of those that have one; contents is (slug, content), NULL if the deliverable is gone; a
    slug of contents without manifest is found missing.  files is (slug, path) of local images, if they are known; a
    slug with files counts as localized.  The first three findings stand alone.
    """
    single = [p.name for p in PATTERNS if p.single_fetch]
    known = [p.name for p in PATTERNS]
    m = manifests.withColumn("_has", F.lit(True))
    both = m.join(measured(contents), "slug", "full_outer")
    dangling = both.select("slug", F.explode("local").alias("path")).distinct()
    if files is not None:
        have = files.select("slug", "path").distinct()
        dangling = dangling.join(have, ["slug", "path"], "left_anti")
        both = both.join(have.select("slug").distinct().withColumn("_stored", F.lit(True)), "slug", "left")
    else:
        both = both.withColumn("_stored", F.lit(False))
    gaps = dangling.groupBy("slug").agg(F.count("*").alias("_gaps"), F.min("path").alias("_gap"))
    both = both.join(gaps, "slug", "left").withColumn("_gaps", F.coalesce("_gaps", F.lit(0)))
    lost = F.coalesce("lost", F.lit(0))
    staged = F.coalesce("pages", F.lit(0))
    total = lost + staged
    share = F.bround(100 * lost / F.greatest(total, F.lit(1)), 0).cast("int")
    remote = F.col("remote")
    heads = F.when(F.col("kind") == "markdown", F.col("md_heads")).otherwise(F.col("html_heads"))
    expected = F.coalesce(F.when(F.col("localized_sha256") != "", F.col("localized_sha256")), F.when(F.col("images") == 0, F.col("sha256")))
    texty = F.col("kind").isin("markdown", "html")

    def found(n: int, check: str, level: str, when: Column, detail: Column | str) -> Column:
        detail = F.lit(detail) if isinstance(detail, str) else detail
        return F.when(when, F.struct(F.lit(n).alias("ord"), F.lit(check).alias("check"), F.lit(level).alias("level"), detail.alias("detail")))

    gone = F.col("_has").isNull()
    missing = ~gone & F.col("hash").isNull()
    empty = ~gone & ~missing & (F.col("bytes_now") == 0)
    live = ~gone & ~missing & ~empty
    say = F.format_string
    checks = [
        found(1, "manifest_missing", "error", gone, "no manifest"),
        found(2, "deliverable_missing", "error", missing, say("%s is gone", "deliverable")),
        found(3, "deliverable_empty", "error", empty, say("%s has 0 bytes", "deliverable")),
        found(4, "sha_mismatch", "error", live & (F.col("hash") != expected), "content differs from the recorded hash"),
        found(5, "crawl_truncated", "error", live & F.col("truncated"), say("cut short at %s pages", F.coalesce(F.col("pages").cast("string"), F.lit("?")))),
        found(6, "pages_lost", "error", live & (lost > 0), say("%d of %d pages lost (%d%%)", lost, total, share)),
        found(
            7, "single_page_crawl", "error",
            live & (F.col("kind") != "pdf") & F.col("pattern").isin(*known) & ~F.col("pattern").isin(*single) & ~F.coalesce("single_document", F.lit(False)) & (F.col("pages") == 1),
            say("%s gave 1 page", "pattern"),
        ),
        found(8, "localize_incomplete", "warning", live & texty & ((F.col("images") > 0) | F.coalesce("_stored", F.lit(False))) & (remote > 0), say("%d remote images", remote)),
        found(9, "broken_image_ref", "error", live & texty & (F.col("_gaps") > 0), say("%d missing images, such as %s", "_gaps", "_gap")),
        found(10, "no_headings", "warning", live & texty & (F.col("pages") > 1) & (heads == 0), say("%d pages without a heading", "pages")),
    ]
    return both.select("slug", F.inline(F.array_compact(F.array(*checks)))).select("slug", "ord", "check", "level", "detail")


def corpus_findings(manifests: DataFrame) -> DataFrame:
    """(slug, ord, check, level, detail): slugs that share their content or their source with others."""
    content = duplicates(manifests, "sha256").select(
        "slug", F.lit(11).alias("ord"), F.lit("duplicate_content").alias("check"), F.lit("warning").alias("level"), F.format_string("same as %s and %d in all", "first_other", "others").alias("detail")
    )
    source = duplicates(manifests, "source_url").select(
        "slug", F.lit(12).alias("ord"), F.lit("duplicate_source_url").alias("check"), F.lit("error").alias("level"), F.format_string("same as %s and %d in all", "first_other", "others").alias("detail")
    )
    return content.unionByName(source)


def audit_all(manifests: DataFrame, contents: DataFrame, files: DataFrame | None = None) -> DataFrame:
    return findings(manifests, contents, files).unionByName(corpus_findings(manifests))


def refresh_status(prior: DataFrame, new: DataFrame, unmodified: DataFrame | None = None) -> DataFrame:
    """(slug, status): how a refresh ended for each slug.

    prior is (slug, pattern, sha256, etag, last_modified), new (slug, sha256, error), unmodified the slugs for which
    the server said 304.  No prior: skipped.  A single fetch with a validator and a 304: unchanged.  An error or
    nothing fetched: failed.  Else by hash.
    """
    single = F.array(*[F.lit(p.name) for p in PATTERNS if p.single_fetch])
    p = prior.select("slug", "pattern", F.col("sha256").alias("_old"), F.coalesce("etag", "last_modified").alias("_validator"), F.lit(True).alias("_has"))
    n = new.select("slug", F.col("sha256").alias("_new"), F.col("error").alias("_error"))
    both = p.join(n, "slug", "full_outer")
    probe = unmodified.select("slug", F.lit(True).alias("_304")) if unmodified is not None else None
    both = both.join(probe, "slug", "left") if probe is not None else both.withColumn("_304", F.lit(None).cast("boolean"))
    status = (
        F.when(F.col("_has").isNull(), "skipped")
        .when(F.col("_304") & F.array_contains(single, F.col("pattern")) & (F.col("_validator") != ""), "unchanged")
        .when(F.col("_error").isNotNull() | F.col("_new").isNull(), "failed")
        .when(F.coalesce(F.col("_new") != F.col("_old"), F.lit(True)), "changed")
        .otherwise("unchanged")
    )
    return both.select("slug", status.alias("status"))


def status_listing(manifests: DataFrame) -> DataFrame:
    """(slug, deliverable, pattern, pages, size, raw, day, host): one line of a status report for each slug."""
    net = urls.netloc(F.col("source_url"))
    return manifests.select(
        "slug", "deliverable", "pattern", F.coalesce(F.col("pages").cast("string"), F.lit("-")).alias("pages"), urls.human_size(F.col("bytes")).alias("size"),
        F.when(F.col("kept_raw"), "raw").otherwise("").alias("raw"), F.left("ingested_at", F.lit(10)).alias("day"), F.when(net == "", "-").otherwise(net).alias("host"),
    )


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def ranked_latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by order, by a window; for rows too wide for a grouped maximum."""
    w = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def renormalized(manifests: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, manifests) of merging kept raw pages again: nothing is fetched.

    made is (slug, bytes, sha256): what the merge of the raw pages gives now, for slugs that keep them.  A slug without a manifest, without
    kept pages, of an unknown pattern or with an empty result fails and keeps what it has.  Where the hash is that of
    the manifest nothing changes; else the manifest gets the new hash and size, and its images are to be fetched anew.
    """
    known = [p.name for p in PATTERNS]
    both = manifests.withColumn("_has", F.lit(True)).join(made.select("slug", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha")), "slug", "full_outer")
    error = (
        F.when(F.col("_has").isNull(), "no manifest").when(~F.coalesce("kept_raw", F.lit(False)), "no raw pages are kept")
        .when(~F.coalesce(F.col("pattern").isin(*known), F.lit(False)), "the pattern is unknown").when(F.coalesce("_bytes", F.lit(0)) == 0, "empty output")
    )
    status = F.when(error.isNotNull(), "failed").when(F.coalesce(F.col("_sha") == F.col("sha256"), F.lit(False)), "unchanged").otherwise("changed")
    both = both.withColumn("_error", error).withColumn("_status", status)
    changed = F.col("_status") == "changed"
    new = {"bytes": F.col("_bytes"), "sha256": F.col("_sha"), "images": F.lit(0), "localized_sha256": F.lit(None).cast("string")}
    out = both.where("_has").select(*[F.when(changed, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in manifests.columns])
    return both.select("slug", F.col("_status").alias("status"), F.col("_error").alias("error")), out
