"""Queries on sources: indexes, trees, specifications, archives, link graphs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import frontier, ordering, routing
from ..session import table
from ..sources import archive, discover, specs
from .acquire_queries import _P, _listed, responses_of, sections
from .page_queries import _rows

# The tells of each content system, as they stand in a page, in the order of their numbers below.
TELLS = (
    ("%PDF-1.7 rest", "pdf"), ("<body class=WebHelp_body><link href=CHWebHelp.css>", "clickhelp"), ('<meta name="generator" content="Paligo">', "paligo"), ('<script src="js/treedata.json"></script> schema.de/2010/ST4', "st4"),
    ('<meta name="generator" content="mkdocs-1.5">', "mkdocs"), ('<meta content="Docusaurus v3" name="generator">', "docusaurus"), ('<meta name="generator" content="Hugo 0.1">', "hugo"), ('<meta name="generator" content="Asciidoctor 2">', "asciidoctor"),
    ('<link rel="alternate" type="application/json" href="https://w.example/wp-json/wp/v2/posts/1">', "wordpress"), ('<script src="_static/doctools.js"></script>', "sphinx"), ("<p>plain</p>", None),
)


def q08_probe(spark: SparkSession, d: str) -> DataFrame:
    """Every manual after the tells of a content system, which its name deals it."""
    tells = F.array(*[F.lit(t) for t, _ in TELLS])
    body = F.concat(F.get(tells, F.length("slug") % len(TELLS)), "content")
    return _rows(spark, d).select("slug", routing.probe(body).alias("system")).distinct()


def q39_search_index(spark: SparkSession, d: str) -> DataFrame:
    """The pages of every manual out of a search index, in which each page stands whole and again by its section."""
    index = responses_of("mkdocs", sections(spark, d))
    out = discover.mkdocs_bodies(index.withColumn("slug", F.regexp_extract("url", "//(.*?)[.]example", 1)), "body", ["slug"])
    return out.select("slug", "ord", "path", "title", F.sha2("body", 256).alias("sha256"))


def _sitemaps(spark: SparkSession, d: str) -> DataFrame:
    """(site, base, body): the addresses of a site's manuals as its sitemap, and the folder of the first of them."""
    u = table(spark, d, "manifests").where("source_url IS NOT NULL").select(urls.host(F.col("source_url")).alias("site"), "source_url").distinct()
    loc = F.concat(F.lit("<url><loc> "), F.replace("source_url", F.lit("&"), F.lit("&amp;")), F.lit("\n</loc></url>"))
    base = F.regexp_replace(F.min("source_url"), r"^([A-Za-z]+://[^/?#]*/[^/?#]*).*$", "$1")
    return u.groupBy("site").agg(base.alias("base"), F.concat(F.lit("<urlset>"), F.array_join(F.array_sort(F.collect_list(loc)), ""), F.lit("</urlset>")).alias("body"))


def q40_sitemap(spark: SparkSession, d: str) -> DataFrame:
    rows = _sitemaps(spark, d)
    a = discover.docusaurus_pages(rows, "body", F.col("base"), ["site"]).withColumn("system", F.lit("docusaurus"))
    b = discover.hugo_pages(rows, "body", F.col("base"), ["site"]).withColumn("system", F.lit("hugo"))
    return a.unionByName(b).select("system", "site", "url")


def q40_ancestors(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifests").where("source_url IS NOT NULL").select("slug", "source_url").distinct()
    return discover.ancestor_sitemaps(m, "source_url", ["slug"]).distinct()


def _spec_json(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.to_json(F.struct(c.alias("x")))
    quoted = lambda c: F.regexp_extract(text(c), r'(?s)^\{"x":(.*)\}$', 1)
    parameters = F.concat(
        F.lit('[{"$ref":"#/components/parameters/limit"},{"name":"size","in":"path","required":true,"description":'), quoted(F.concat(F.lit("at most\n"), F.col("p_size").cast("string"))), F.lit("}]")
    )
    post = F.concat(
        F.lit('{"description":'), quoted(F.col("p_type")),
        F.lit(',"requestBody":{"content":{"application/json":{"schema":{"$ref":"#/components/schemas/Part"}}}},"responses":{"200":{"description":'), quoted(F.col("p_type")), F.lit('},"404":{"$ref":"#/components/responses/Gone"}}}'),
    )
    get = F.concat(F.lit('{"summary":'), quoted(F.col("p_name")), F.lit(',"description":'), quoted(F.col("p_name")), F.lit(',"parameters":'), parameters, F.lit("}"))
    path = F.concat(F.lit('"/parts/'), F.col("p_partkey").cast("string"), F.lit('":{"x-note":"none","post":'), post, F.lit(',"get":'), get, F.lit("}"))
    rows = table(spark, d, "part").where("p_brand IS NOT NULL").groupBy(F.col("p_brand").alias("name")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("p_partkey", path.alias("j"))))["j"], ",").alias("paths"))
    shared = '"components":{"parameters":{"limit":{"name":"limit","in":"query","schema":{"type":"integer"}}},"responses":{"Gone":{}},"schemas":{"Name":{"type":"string","description":"its name"},"Part":{"type":"object","required":["name"],"properties":{"name":{"$ref":"#/components/schemas/Name"},"size":{"type":"integer"},"more":{}}}}}'
    head = F.concat(F.lit('{"openapi":"3.0.0","info":{"title":'), quoted(F.col("name")), F.lit(',"version":"2"},"servers":[{"url":"https://api.example"}],"paths":{'), "paths", F.lit("}," + shared + "}"))
    return rows.select("name", head.alias("body"))


def q42_operations(spark: SparkSession, d: str) -> DataFrame:
    return specs.operations("body", _spec_json(spark, d)).select("name", "path", "method_pos", "method")


def q43_spec_render(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each brand as the interface of a service, rendered."""
    out = specs.rendered(_spec_json(spark, d), "name", "body")
    return out.select("name", "format", "title", F.col("pages").cast("bigint").alias("pages"), F.sha2("content", 256).alias("sha256"))


def q43_collection_render(spark: SparkSession, d: str) -> DataFrame:
    """The customers of each nation as a collection: a folder for each segment, a request for each customer."""
    c = table(spark, d, "customer").where("c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL")
    url = F.concat(F.lit("https://api.example/"), F.col("c_custkey").cast("string"))
    request = F.struct(F.lit("GET").alias("method"), F.struct(url.alias("raw")).alias("url"), F.array(F.struct(F.lit("A").alias("key"), F.lit("b").alias("value"))).alias("header"))
    item = F.struct(F.col("c_name").alias("name"), request.alias("request"))
    folder = c.groupBy("c_nationkey", "c_mktsegment").agg(F.array_sort(F.collect_list(F.struct("c_custkey", item.alias("i"))))["i"].alias("item"))
    own = folder.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("c_mktsegment").alias("name"), "item"))).alias("item"))
    info = F.struct(F.concat(F.lit("Set "), F.col("c_nationkey").cast("string")).alias("name"), F.lit("v2.1").alias("schema"))
    out = specs.rendered(own.select(F.col("c_nationkey").alias("nation"), F.to_json(F.struct(info.alias("info"), "item")).alias("body")), "nation", "body")
    return out.select("nation", "format", "title", F.col("pages").cast("bigint").alias("pages"), F.sha2("content", 256).alias("sha256"))


def q49_topic_tree(spark: SparkSession, d: str) -> DataFrame:
    """The topic trees of all manuals, flattened."""
    index = responses_of("st4", sections(spark, d)).where(F.col("url").endswith("treedata.json"))
    rows = index.select(F.regexp_extract("url", "//(.*?)[.]example", 1).alias("slug"), F.inline(discover.topic_tree(F.col("body"))))
    return rows.select("slug", F.col("ord").cast("bigint").alias("ord"), "depth", "kind", "text", "href")


def _book(names: list[str], texts: list[str]) -> bytes:
    """An EPUB whose spine names every second member, the last first; what it lacks are loose pages."""
    buffer = io.BytesIO()
    spine = names[::2][::-1]
    opf = "".join(f'<item id="i{k}" href="{n}"/>' for k, n in enumerate(spine)) + "<spine>" + "".join(f'<itemref idref="i{k}"/>' for k in range(len(spine))) + "</spine>"
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("b/content.opf", f"<package><manifest>{opf}</package>")
        for n, t in zip(names, texts):
            z.writestr(f"b/{n}", f"<body>{t}</body>")
        z.writestr("b/read.txt", "no page")
    return buffer.getvalue()


def _books(items: Column) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([_book([f"p{x['k']}.html" for x in xs], [x["t"] for x in xs]) for xs in s], dtype=object)

    return run(items)


def q50_archive(spark: SparkSession, d: str) -> DataFrame:
    """Every HTML manual as an EPUB of its sections, and a broken archive for each."""
    books = sections(spark, d).groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("items"))
    files = books.select(F.col("slug").alias("source"), _books(F.col("items")).alias("data"))
    bad = files.select(F.concat(F.lit("bad "), "source").alias("source"), F.substring("data", 1, 20).alias("data"))
    rows = archive.members(files.unionByName(bad))
    good = archive.reading_order(rows).select("source", "member", "kind", "ord", F.sha2("text", 256).alias("sha256"))
    failed = rows.where("error IS NOT NULL").select("source", F.lit(None).cast("string").alias("member"), F.lit("error").alias("kind"), F.lit(None).cast("bigint").alias("ord"), F.lit(None).cast("string").alias("sha256"))
    return good.unionByName(failed)


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Manuals of one site as a tree by name: the k-th links to those from 3k-1 to 3k+1 and back to the first."""
    from pyspark.sql import Window

    m = table(spark, d, "manifests").where("source_url IS NOT NULL AND slug IS NOT NULL").groupBy("slug").agg(F.max("source_url").alias("u"))
    n = m.select(urls.host(F.col("u")).alias("source"), "slug")
    n = n.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("slug")))
    down = n.select("source", F.floor((F.col("k") + 1) / 3).alias("k"), F.col("slug").alias("dst"), F.pmod(F.col("k") + 1, F.lit(3)).alias("pos")).where("k > 0")
    edges = down.join(n, ["source", "k"]).select("source", F.col("slug").alias("src"), "dst", "pos")
    top = n.where("k = 1").select("source", F.col("slug").alias("dst"))
    return edges.unionByName(n.join(top, "source").select("source", F.col("slug").alias("src"), "dst", F.lit(9).alias("pos")))


def q51_crawl(spark: SparkSession, d: str) -> DataFrame:
    edges = _links(spark, d)
    seeds = edges.groupBy("source").agg(F.min("src").alias("node"))
    out = frontier.crawl(edges, seeds, 100_000)
    return out.select("source", "node", F.col("depth").cast("int").alias("depth"))


def q52_chain(spark: SparkSession, d: str) -> DataFrame:
    """The orders of each customer as a chain of pages, walked from a page inside: back to its head, then on to its end."""
    o = table(spark, d, "orders").where("o_custkey IS NOT NULL AND o_orderkey IS NOT NULL").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("node"))
    n = ordering.numbered(o, ["source"], ["node"], "k")
    edges = n.alias("a").join(n.alias("b"), F.expr("a.source = b.source AND b.k = a.k + 1")).select("a.source", F.col("a.node").alias("src"), F.col("b.node").alias("dst"), F.lit(0).alias("pos"))
    inside = n.groupBy("source").agg(F.floor(F.max("k") / 2).alias("k"))
    return frontier.chain_from_head(edges, n.join(inside, ["source", "k"]).select("source", "node"), 100_000).select("source", "node", "ord", "truncated")


def q53_pagination(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return ordering.take_while(e, ["user_id"], "event_id", F.col("event_type") != "error").select("user_id", "event_id")


def q10_index_pages(spark: SparkSession, d: str) -> DataFrame:
    """Links of all manuals as an index: first-seen targets of Markdown and HTML links."""
    target = F.regexp_extract_all("content", F.lit(r'(?:\]\(|href=")(/[^)"\s]+)'), F.lit(1))
    rows = _rows(spark, d).select("slug", F.posexplode(target).alias("pos", "href"))
    return ordering.first_seen(rows, ["slug", "href"], ["pos"]).select("slug", "href", F.col("pos").cast("bigint").alias("pos"))


def q58_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts over the stages of a pipeline, from one pass over each table."""
    parts = [
        table(spark, d, "manifests").agg(F.lit("manifests").alias("stage"), F.count("*").alias("n"), F.countDistinct("slug").alias("slugs")),
        table(spark, d, "deliverables").agg(F.lit("deliverables").alias("stage"), F.count("*").alias("n"), F.countDistinct("slug").alias("slugs")),
        table(spark, d, "ingest_results").agg(F.lit("ingest_results").alias("stage"), F.count("*").alias("n"), F.countDistinct("slug").alias("slugs")),
        table(spark, d, "manifest_log").agg(F.lit("manifest_log").alias("stage"), F.count("*").alias("n"), F.countDistinct("slug").alias("slugs")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {f.__name__: f for f in (q08_probe, q10_index_pages, q39_search_index, q40_sitemap, q40_ancestors, q42_operations, q43_spec_render, q43_collection_render, q49_topic_tree, q50_archive, q51_crawl, q52_chain, q53_pagination, q58_metrics)}

from .page_queries import _C  # noqa: E402
from .url_queries import _HOST, _PATH  # noqa: E402

_q = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
_RING = f"""m AS (SELECT slug, max(source_url) AS u FROM manifests WHERE source_url IS NOT NULL AND slug IS NOT NULL GROUP BY slug),
n AS (SELECT {_HOST.format(u='u')} AS source, slug, row_number() OVER (PARTITION BY {_HOST.format(u='u')} ORDER BY slug) AS k FROM m),
e AS (SELECT a.source, a.slug AS src, b.slug AS dst FROM n a JOIN n b ON a.source = b.source AND ((b.k + 1) // 3 = a.k OR b.k = 1))"""
SQL = {
    "q08_probe": f"SELECT DISTINCT slug, ([{', '.join(_q(s) for _, s in TELLS)}])[length(slug) % {len(TELLS)} + 1] AS system FROM {_C}",
    "q39_search_index": f"WITH {_P} SELECT slug, (2 * ord)::BIGINT AS ord, 'p' || ord || '/' AS path, 'P' || ord AS title, sha256('# P' || ord || chr(10) || chr(10) || 'Lead' || chr(10) || chr(10) || '## Sub' || chr(10) || chr(10) || trim(t)) AS sha256 FROM p",
    "q10_index_pages": r"WITH t AS (SELECT slug, regexp_extract_all(content, '(?:\]\(|href=" + '"' + r")(/[^)" + '"' + r"\s]+)', 1) AS l FROM " + _C + ") SELECT slug, href, min(p)::BIGINT AS pos FROM (SELECT slug, unnest(l) AS href, unnest(range(len(l))) AS p FROM t) GROUP BY slug, href",
    "q40_sitemap": rf"""WITH u AS (SELECT DISTINCT {_HOST.format(u='source_url')} AS site, source_url AS url FROM manifests WHERE source_url IS NOT NULL),
b AS (SELECT site, regexp_replace(min(url), '^([A-Za-z]+://[^/?#]*/[^/?#]*).*$', '\1') AS base FROM u GROUP BY site),
r AS (SELECT site, url, string_split(regexp_replace(substr(url, length(base) + 1), '^/+', ''), '/')[1] AS first, {_PATH.format(u='url')} || '/' AS path FROM u JOIN b USING (site) WHERE url = base OR starts_with(url, base || '/'))
SELECT 'docusaurus' AS system, site, url FROM r WHERE NOT regexp_matches(first, '^(?:\d+\.(?:\d+|x)[^/]*|next)$') UNION ALL
SELECT 'hugo', site, url FROM r WHERE NOT (path LIKE '%/print/%' OR path LIKE '%/categories/%' OR path LIKE '%/tags/%')""",
    "q40_ancestors": rf"""WITH s AS (SELECT DISTINCT slug, source_url, regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) AS o, regexp_replace(regexp_replace(regexp_replace(source_url, '[?#].*$', ''), '/+$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', '') AS p FROM manifests WHERE source_url IS NOT NULL),
l AS (SELECT slug, o, list_filter(string_split(CASE WHEN regexp_matches(p, '/[^/]*\.[^/]*$') THEN regexp_replace(p, '/[^/]*$', '') ELSE p END, '/'), lambda x: x <> '') AS l FROM s)
SELECT DISTINCT slug, depth::INT AS depth, o || CASE WHEN depth = 0 THEN '' ELSE '/' || array_to_string(l[1:depth], '/') END || '/sitemap.xml' AS candidate FROM (SELECT *, unnest(range(len(l) + 1)) AS depth FROM l)""",
    "q42_operations": "SELECT p_brand AS name, '/parts/' || p_partkey AS path, unnest([0, 1])::INT AS method_pos, unnest(['get', 'post']) AS method FROM part WHERE p_brand IS NOT NULL",
    "q43_spec_render": """WITH o AS (SELECT p_brand AS name, p_partkey, '## GET /parts/' || p_partkey || chr(10) || chr(10) || p_name || chr(10) || chr(10) || '**Parameters:**' || chr(10) || chr(10) || '| Name | In | Type | Required | Description |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10)
  || '| `limit` | query | integer | no |  |' || chr(10) || '| `size` | path |  | yes | at most ' || p_size || ' |' || chr(10) || chr(10) || '## POST /parts/' || p_partkey || chr(10) || chr(10) || p_type || chr(10) || chr(10) || '**Request body:**' || chr(10) || chr(10)
  || '- `name` _string_ (required) — its name' || chr(10) || '- `size` _integer_' || chr(10) || '- `more` _object_' || chr(10) || chr(10) || '**Responses:**' || chr(10) || '- `200` — ' || p_type || chr(10) || '- `404` — Gone' AS m FROM part WHERE p_brand IS NOT NULL)
SELECT name, 'openapi' AS format, name || ' 2' AS title, 2 * count(*) AS pages, sha256('# ' || name || ' 2' || chr(10) || chr(10) || '**Base URL:** `https://api.example`' || chr(10) || chr(10) || string_agg(m, chr(10) || chr(10) ORDER BY p_partkey) || chr(10)) AS sha256 FROM o GROUP BY name""",
    "q43_collection_render": """WITH r AS (SELECT c_nationkey AS n, c_mktsegment AS s, count(*) AS k, '## ' || c_mktsegment || chr(10) || chr(10) || string_agg('### ' || c_name || chr(10) || chr(10) || '`GET https://api.example/' || c_custkey || '`' || chr(10) || chr(10) || '**Headers:**' || chr(10) || chr(10) || '- `A: b`', chr(10) || chr(10) ORDER BY c_custkey) AS m FROM customer WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY c_nationkey, c_mktsegment)
SELECT n AS nation, 'postman' AS format, 'Set ' || n AS title, sum(k)::BIGINT AS pages, sha256('# Set ' || n || chr(10) || chr(10) || string_agg(m, chr(10) || chr(10) ORDER BY s) || chr(10)) AS sha256 FROM r GROUP BY n""",
    "q49_topic_tree": f"""WITH {_P}, r AS (SELECT slug, ord AS k, ord % 4 = 2 AS inner_, (ord + 2) // 4 AS before FROM p)
SELECT slug, (k + before)::BIGINT AS ord, CASE WHEN inner_ THEN 2 ELSE 1 END::INT AS depth, 'leaf' AS kind, 'T' AS text, 'p' || k || '.html' AS href FROM r
UNION ALL SELECT slug, (k + before - 1)::BIGINT, 1, 'branch', 'Part ' || k, '' FROM r WHERE inner_""",
    "q50_archive": f"""WITH {_P}, r AS (SELECT slug, n, ord, '<body>' || t || '</body>' AS t FROM p JOIN z USING (slug))
SELECT slug AS source, 'b/p' || ord || '.html' AS member, 'html' AS kind, row_number() OVER (PARTITION BY slug ORDER BY ord % 2, CASE WHEN ord % 2 = 0 THEN -ord ELSE ord END) - 1 AS ord, sha256(t) AS sha256 FROM r
UNION ALL SELECT 'bad ' || slug, NULL, 'error', NULL, NULL FROM z""",
    "q51_crawl": f"""WITH RECURSIVE {_RING}, r(source, node, depth) AS (SELECT source, min(src), 0 FROM e GROUP BY source UNION SELECT e.source, e.dst, r.depth + 1 FROM r JOIN e ON e.source = r.source AND e.src = r.node WHERE r.depth < 40)
SELECT source, node, min(depth)::INT AS depth FROM r GROUP BY source, node""",
    "q52_chain": "SELECT o_custkey AS source, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, false AS truncated FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL",
    "q53_pagination": "SELECT user_id, event_id FROM events e WHERE event_id < coalesce((SELECT min(event_id) FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'error'), 9223372036854775807)",
    "q58_metrics": " UNION ALL ".join(f"SELECT '{t}' AS stage, count(*) AS n, count(DISTINCT slug) AS slugs FROM {t}" for t in ("manifests", "deliverables", "ingest_results", "manifest_log")),
}
