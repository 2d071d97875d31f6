"""SQL that states the same results as the queries, for those that SQL can express on whole tables."""

_WORDS = r"""regexp_extract_all(lower(regexp_replace({0}, '<[A-Za-z/!][^<>]*>', ' ', 'g')), '[\p{{L}}\p{{N}}]+')"""
_RUNS = """list_transform(range(1, len(w) - {1} + 2), lambda i: array_to_string(w[i:i + {1} - 1], ' '))"""

_P1 = f"""
WITH d AS (SELECT DISTINCT slug, content FROM deliverables WHERE slug IS NOT NULL AND content IS NOT NULL),
words AS (SELECT slug, {_WORDS.format('content')} AS w FROM d),
runs AS (SELECT slug, list_distinct({_RUNS.format('', 4)}) AS r FROM words WHERE len(w) >= 20),
sizes AS (SELECT slug, len(r) AS n FROM runs),
each AS (SELECT slug, unnest(r) AS x FROM runs),
shared AS (SELECT a.slug AS slug_a, b.slug AS slug_b, count(*) AS n FROM each a JOIN each b ON a.x = b.x AND a.slug < b.slug GROUP BY ALL)
SELECT slug_a, slug_b FROM shared s JOIN sizes p ON p.slug = s.slug_a JOIN sizes q ON q.slug = s.slug_b
WHERE s.n >= 0.6 * (p.n + q.n - s.n)
"""

_SITES = r"""
latest AS (SELECT slug, max(struct_pack(t := coalesce(ingested_at, ''), u := coalesce(source_url, ''))).u AS url FROM manifests WHERE slug IS NOT NULL GROUP BY slug),
sites AS (SELECT slug, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^.*@', ''), ':\d*$', '') AS site FROM latest)
"""
_LINES = rf"""
WITH {_SITES},
d AS (SELECT DISTINCT slug, content FROM deliverables WHERE content IS NOT NULL),
split AS (SELECT slug, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM d),
forms AS (SELECT slug, line_no, regexp_replace(lower(regexp_replace(line, '<[A-Za-z/!][^<>]*>', '', 'g')), '[^\p{{L}}\p{{N}}]+', '', 'g') AS form FROM split),
occ AS (SELECT DISTINCT f.slug, site, line_no, form FROM forms f JOIN sites USING (slug) WHERE length(form) >= 30 AND site <> ''),
kept AS (SELECT site, form FROM occ GROUP BY site, form HAVING count(DISTINCT slug) >= 8)
"""

_P6 = f"""
WITH d AS (SELECT DISTINCT slug, content FROM deliverables WHERE slug IS NOT NULL AND content IS NOT NULL),
words AS (SELECT slug, {_WORDS.format('content')} AS w FROM d),
runs AS (SELECT slug, {_RUNS.format('', 5)} AS r FROM words WHERE len(w) >= 5)
SELECT DISTINCT slug FROM runs WHERE len(r) - len(list_distinct(r)) >= 0.25 * len(r)
"""

_P8 = f"""
WITH t AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM (SELECT DISTINCT item_id, text FROM eval_items)),
passages AS (SELECT DISTINCT item_id, least(12, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(12, len(w)) + 2), lambda k: array_to_string(w[k:k + least(12, len(w)) - 1], ' '))) AS p FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM passages),
runs AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n::BIGINT + 2), lambda k: array_to_string(w[k:k + n::BIGINT - 1], ' '))) AS p FROM t, sizes WHERE len(w) >= n)
SELECT DISTINCT doc_id, item_id FROM runs JOIN passages USING (n, p)
"""

_P1_GROUPS = f"""
WITH RECURSIVE d AS (SELECT DISTINCT slug, content FROM deliverables WHERE slug IS NOT NULL AND content IS NOT NULL),
c AS (SELECT slug, md5(content) AS id FROM d), t AS (SELECT md5(content) AS id, any_value(content) AS content FROM d GROUP BY 1),
words AS (SELECT id, {_WORDS.format('content')} AS w FROM t),
runs AS (SELECT id, list_distinct({_RUNS.format('', 4)}) AS r FROM words WHERE len(w) >= 20),
sizes AS (SELECT id, len(r) AS n FROM runs), each AS (SELECT id, unnest(r) AS x FROM runs),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM each a JOIN each b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT a, b FROM shared s JOIN sizes p ON p.id = s.a JOIN sizes q ON q.id = s.b WHERE s.n >= 0.6 * (p.n + q.n - s.n)),
two AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, root) AS (SELECT id, id FROM t UNION SELECT two.b, reach.root FROM reach JOIN two ON two.a = reach.node),
named AS (SELECT node, min(root) AS root FROM reach GROUP BY node), links AS (SELECT a AS id, count(*) AS links FROM two GROUP BY a)
SELECT slug, c.id AS class_id, root AS group_id, coalesce(links, 0) AS links FROM c JOIN named ON named.node = c.id LEFT JOIN links ON links.id = c.id
"""

_P3_CLEAN = (
    _LINES
    + """, gone AS (SELECT DISTINCT slug, line_no FROM occ JOIN kept USING (site, form)), every AS (SELECT DISTINCT slug, content FROM deliverables),
lines AS (SELECT slug, content, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM every WHERE content IS NOT NULL)
SELECT slug, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (g.line_no IS NULL), '') AS content, count(g.line_no) AS removed FROM lines LEFT JOIN gone g USING (slug, line_no) GROUP BY slug, lines.content
UNION ALL SELECT slug, NULL, 0 FROM every WHERE content IS NULL"""
)

_P7_PARTS = """
SELECT spec_id, doc_id, (size + capacity - 1) // capacity AS parts, size AS tokens, true AS fits
FROM (SELECT doc_id, max(strlen(text) + 1)::BIGINT AS size FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id), (SELECT DISTINCT spec_id, capacity::BIGINT AS capacity FROM pack_specs WHERE capacity > 0)
"""

_P5_REJOINED = """
SELECT DISTINCT slug, sha256(content) AS sha256, true AS fits, true AS overlaps FROM deliverables JOIN (SELECT kind, min(max_bytes) AS m FROM split_limits GROUP BY kind) USING (kind) WHERE strlen(content) > m
"""

SQL = {
    "p1_found": _P1,
    "p1_groups": _P1_GROUPS,
    "p3_clean": _P3_CLEAN,
    "p5_rejoined": _P5_REJOINED,
    "p7_parts": _P7_PARTS,
    "p3_found": _LINES + "SELECT slug, line_no::INT AS line_no FROM occ JOIN kept USING (site, form)",
    "p5_found": "SELECT DISTINCT slug FROM deliverables JOIN (SELECT kind, min(max_bytes) AS m FROM split_limits GROUP BY kind) USING (kind) WHERE strlen(content) > m",
    "p6_found": _P6,
    "p7_found": "SELECT DISTINCT spec_id, doc_id FROM documents, pack_specs WHERE strlen(text) + 1 > capacity",
    "p8_found": _P8,
}
