import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from manualmill.operators import corpus, frontier, images, merge, ordering
from manualmill.operators.components import connected_components
from manualmill.session import build_session, ensure_checkpoint_dir  # noqa: F401


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000), (None, 3)]
    links += [(9000, k) for k in range(9001, 9400)]  # a hub
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = dict(rows(connected_components(spark.createDataFrame(links, "a bigint, b bigint"))))
    assert got == {k: find(k) for k in list(parent)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_first_seen_and_caps(spark):
    df = spark.createDataFrame([("s", "x", 3, "c"), ("s", "y", 1, "a"), ("s", "x", 2, "b"), ("t", "x", 9, None), (None, "x", 1, "n")], "site string, url string, ord int, v string")
    assert {tuple(r) for r in ordering.first_seen(df, ["site", "url"], ["ord"]).collect()} == {("s", "x", 2, "b"), ("s", "y", 1, "a"), ("t", "x", 9, None), (None, "x", 1, "n")}
    got = ordering.capped(df.where("site IS NOT NULL"), ["site"], ["ord"], 2)
    assert rows(got, "site", "ord", "truncated") == [("s", 1, True), ("s", 2, True), ("t", 9, False)]
    assert rows(ordering.numbered(df.where("site = 's'"), ["site"], ["ord"], "n"), "n", "v") == [(0, "a"), (1, "b"), (2, "c")]


def test_attempts_and_saved(spark):
    df = spark.createDataFrame([("s", 1, True), ("s", 2, False), ("s", 3, True), ("s", 4, None)], "s string, k int, ok boolean")
    assert rows(ordering.attempt_and_saved(df, ["s"], ["k"], F.col("ok")), "k", "attempt", "saved") == [(1, 0, 0), (2, 1, None), (3, 2, 1), (4, 3, None)]


def test_segments_change_nothing(spark):
    rng = random.Random(4)
    t = datetime(2025, 1, 1)
    data = [(None if rng.random() < 0.05 else "hot" if rng.random() < 0.5 else f"s{rng.randrange(5)}", k, t + timedelta(seconds=rng.randrange(10**5)), rng.random() < 0.6, rng.random() < 0.7) for k in range(400)]
    df = spark.createDataFrame(data, "k string, id int, ts timestamp, ok boolean, leaf boolean")
    for f in (
        lambda n: ordering.numbered(df, ["k"], ["ts", "id"], rows=n),
        lambda n: ordering.attempt_and_saved(df, ["k"], ["ts", "id"], F.col("ok"), rows=n),
        lambda n: ordering.idle_gaps(df, ["k"], "ts", "id", 100, rows=n),
        lambda n: ordering.carried_forward(df, ["k"], "id", F.col("leaf"), F.col("ok"), "id", rows=n),
    ):
        whole, cut = (sorted(str(r) for r in f(n).collect()) for n in (10**6, 37))
        assert whole == cut and whole


def test_headings_survive_lost_leaves(spark):
    df = spark.createDataFrame([("m", 0, False, True, "A"), ("m", 1, True, False, "lost"), ("m", 2, False, True, "B"), ("m", 3, True, True, "leaf"), ("m", 4, False, True, "end")], "m string, ord int, leaf boolean, ok boolean, t string")
    assert rows(ordering.carried_forward(df, ["m"], "ord", F.col("leaf"), F.col("ok"), "t")) == [("m", 3, ["A", "B"])]


def test_idle_gaps(spark):
    t = datetime(2025, 1, 1)
    df = spark.createDataFrame([("a", t, 1), ("a", t + timedelta(seconds=300), 2), ("a", t + timedelta(seconds=601), 3)], "k string, ts timestamp, id int")
    assert rows(ordering.idle_gaps(df, ["k"], "ts", "id", 300), "id", "gap_s") == [(3, 301)]
    assert ordering.idle_gaps(df, ["k"], "ts", "id", 0).count() == 0
    with pytest.raises(ValueError):
        ordering.idle_gaps(df, ["k"], "ts", "id", -1)


def test_crawl_order_cap_and_cycles(spark):
    edges = spark.createDataFrame([("s", "a", "b", 1), ("s", "a", "c", 0), ("s", "c", "d", 0), ("s", "b", "a", 0), ("s", "b", "e", 1), ("s", "d", "a", 0), ("t", "x", "x", 0), ("s", None, "z", 0)], "source string, src string, dst string, pos int")
    seeds = spark.createDataFrame([("s", "a"), ("t", "x"), ("s", None)], "source string, node string")
    got = frontier.crawl(edges, seeds, 10)
    assert rows(got.where("source = 's'"), "ord", "node", "depth") == [(0, "a", 0), (1, "c", 1), (2, "b", 1), (3, "d", 2), (4, "e", 2)]
    assert rows(got.where("source = 't'"), "node", "truncated") == [("x", False)]
    assert rows(frontier.crawl(edges, seeds, 2).where("source = 's'"), "node", "truncated") == [("a", True), ("c", True)]
    assert frontier.crawl(edges.limit(0), seeds, 5).count() == 2 and frontier.crawl(edges, seeds.limit(0), 5).count() == 0


def test_long_chain_is_walked_whole(spark):
    edges = spark.range(1499).selectExpr("'s' source", "id src", "id + 1 dst", "0 pos")
    seeds = spark.createDataFrame([("s", 1200)], "source string, node bigint")
    assert rows(frontier.chain_from_head(edges, seeds, 1500), "ord", "node", "depth", "truncated") == [(k, k, k, False) for k in range(1500)]
    # The head is 1,200 links away; 1,199 are not enough to find it, and the rest is within the cap.
    short = edges.where("src < 1210")
    assert rows(frontier.chain_from_head(short, seeds, 1199), "ord", "node", "truncated")[0] == (0, 1, True)


@pytest.mark.parametrize("cap", [1, 3, 7, 100])
def test_chain_is_a_crawl_of_one_link_a_page(spark, cap):
    links = [("s", k, (k * 7 + 3) % 23, 0) for k in range(19)] + [("s", k, k, 1) for k in range(5)] + [("t", k, k + 1, 0) for k in range(12)] + [("t", 12, None, 0), ("u", 1, 1, 0)]
    edges = spark.createDataFrame(links, "source string, src int, dst int, pos int")
    seeds = spark.createDataFrame([("s", 4), ("s", 9), ("s", 4), ("t", 5), ("t", 0), ("u", 1), ("v", 1), ("s", None)], "source string, node int")
    columns = ("source", "ord", "node", "depth", "truncated")
    assert rows(frontier.chain(edges, seeds, cap), *columns) == rows(frontier.crawl(edges.where("pos = 0"), seeds, cap), *columns)


def test_take_while(spark):
    df = spark.createDataFrame([("p", 1, 200), ("p", 2, 200), ("p", 3, 404), ("p", 4, 200), ("q", 1, None), ("r", 1, 200)], "s string, n int, status int")
    assert rows(ordering.take_while(df, ["s"], "n", F.col("status") == 200), "s", "n") == [("p", 1), ("p", 2), ("r", 1)]


def test_merges(spark):
    df = spark.createDataFrame([("m", 2, "two", "T2"), ("m", 0, "zero", None), ("m", 1, None, "lost"), ("n", 0, None, None)], "m string, ord int, body string, title string")
    assert rows(merge.merge_markdown(df, ["m"], "ord", "body")) == [("m", "zero\n\n---\n\ntwo", 2)]
    html = merge.merge_html(df, ["m"], "ord", "body", "title", suffix=" & Help").first().content
    assert "<title>T2 &amp; Help</title>" in html and "<h1>" in html and html.index("zero") < html.index("two")
    toc = spark.createDataFrame([("m", "two", 0, 4), ("m", "absent", 1, 2)], "m string, body string, ord int, level int")
    pages = spark.createDataFrame([("m", "two"), ("m", "zero"), ("m", "alpha")], "m string, body string")
    assert [r.body for r in merge.in_table_order(pages, toc, ["m"], "body").orderBy("ord").collect()] == ["two", "alpha", "zero"]


def manifest(slug, **x):
    base = dict(schema_version=6, tool_version="1", source_url=f"https://{slug}.example/", pattern="docs_probe", slug=slug, kind="markdown", title=None, etag=None, last_modified=None, truncated=False, single_document=False, kept_raw=False, lost=0, localized_sha256=None, deliverable=f"{slug}.md", pages=2, bytes=1, sha256=None, images=1, ingested_at="2025-01-01T00:00:00Z")
    return base | x


SCHEMA = "schema_version int, tool_version string, source_url string, pattern string, slug string, kind string, title string, etag string, last_modified string, truncated boolean, single_document boolean, kept_raw boolean, lost int, localized_sha256 string, deliverable string, pages int, bytes bigint, sha256 string, images int, ingested_at string"


def test_audit(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ms = [
        manifest("ok", sha256=sha("# t"), images=0), manifest("gone"), manifest("empty"), manifest("sha", sha256="x", images=0), manifest("local", localized_sha256=sha("# l"), sha256="y"), manifest("cut", truncated=True),
        manifest("lost", lost=1, pages=7), manifest("one", pages=1), manifest("pdf", pages=1, pattern="pdf_url"), manifest("remote"), manifest("broken"), manifest("flat"), manifest("dup1", sha256="same"), manifest("dup2", sha256="same"),
        manifest("url1", source_url="u"), manifest("url2", source_url="u"), manifest("old", truncated=None, lost=None, single_document=None),
    ]
    docs = {m["slug"]: "# t" for m in ms} | {"gone": None, "empty": "", "local": "# l", "remote": "# t ![a](https://x/y.png)", "broken": "# t ![a](images/no.png) ![b](images/yes.png)", "flat": "text", "nomanifest": "x"}
    files = spark.createDataFrame([("broken", "images/yes.png")], "slug string, path string")
    frame = corpus.upgraded(corpus.latest_manifests(spark.createDataFrame([tuple(m[c] for c in corpus.MANIFEST_FIELDS) for m in ms + ms[:2]], SCHEMA)))
    got = corpus.audit_all(frame, spark.createDataFrame(list(docs.items()), "slug string, content string"), files)
    assert {(r.slug, r.check, r.level) for r in got.collect()} == {
        ("nomanifest", "manifest_missing", "error"), ("gone", "deliverable_missing", "error"), ("empty", "deliverable_empty", "error"), ("sha", "sha_mismatch", "error"), ("cut", "crawl_truncated", "error"), ("lost", "pages_lost", "error"),
        ("one", "single_page_crawl", "error"), ("remote", "localize_incomplete", "warning"), ("broken", "broken_image_ref", "error"), ("flat", "no_headings", "warning"), ("dup1", "duplicate_content", "warning"), ("dup2", "duplicate_content", "warning"),
        ("url1", "duplicate_source_url", "error"), ("url2", "duplicate_source_url", "error"),
    }
    assert next(r.detail for r in got.collect() if r.check == "pages_lost") == "1 of 8 pages lost (12%)"  # 12.5 goes to the even
    assert corpus.audit_all(frame.limit(0), spark.createDataFrame([], "slug string, content string")).count() == 0


def test_manifest_json_round_trip(spark):
    m = spark.createDataFrame([tuple(manifest("a")[c] for c in corpus.MANIFEST_FIELDS)], SCHEMA)
    text = m.select(corpus.manifest_json().alias("j"))
    assert text.first().j.startswith('{"schema_version":6,"tool_version":"1","source_url"') and '"title":null' in text.first().j
    back = text.union(spark.createDataFrame([("{",), (None,), ("[1]",), ("{}",)], "j string")).select(corpus.read_manifest(F.col("j")).alias("m"))
    assert [r.m.slug if r.m else None for r in back.collect()] == ["a", None, None, None, None]


def test_refresh_status(spark):
    prior = spark.createDataFrame([("same", "docs_probe", "x", None, None), ("new", "docs_probe", "x", None, None), ("fail", "docs_probe", "x", None, None), ("probe", "pdf_url", "x", "e", None), ("crawl", "docs_probe", "x", "e", None)], "slug string, pattern string, sha256 string, etag string, last_modified string")
    new = spark.createDataFrame([("same", "x", None), ("new", "y", None), ("fail", "y", "404"), ("other", "y", None)], "slug string, sha256 string, error string")
    unmodified = spark.createDataFrame([("probe",), ("crawl",)], "slug string")
    assert rows(corpus.refresh_status(prior, new, unmodified)) == [("crawl", "failed"), ("fail", "failed"), ("new", "changed"), ("other", "skipped"), ("probe", "unchanged"), ("same", "unchanged")]


def test_duplicates_of_a_hot_value(spark):
    df = spark.createDataFrame([(f"s{k:03}", "v") for k in range(300)] + [("z", "w"), ("n", None), (None, "v")], "slug string, v string")
    got = {r.slug: (r.others, r.first_other) for r in corpus.duplicates(df.union(df), "v").collect()}
    assert len(got) == 300 and got["s000"] == (299, "s001") and got["s007"] == (299, "s000")


def test_images(spark):
    docs = spark.createDataFrame([("a", "![x](https://h/i.png?a=1&amp;b=2) <img alt='' src=\"https://h/i.png\"> ![x](https://h/i.png)"), ("b", "![l](images/k.png)"), ("c", None)], "slug string, content string")
    assert rows(images.references(docs), "slug", "pos", "decoded") == [("a", 0, "https://h/i.png?a=1&b=2"), ("a", 1, "https://h/i.png")]
    side = spark.createDataFrame([("a", "https://h/i.png?a=1&b=2", "i.png", True), ("a", "https://h/i.png", "j.png", True)], "slug string, source_url string, local string, on_disk boolean")
    probes = spark.createDataFrame([("https://h/i.png?a=1&b=2", True)], "url string, not_modified boolean")
    assert {(r.decoded, r.action) for r in images.classified(images.references(docs), side, probes).collect()} == {("https://h/i.png?a=1&b=2", "reuse"), ("https://h/i.png", "supersede")}
    changes = spark.createDataFrame([("a", "https://h/i.png", "j.png")], "slug string, url string, local string")
    text = images.retargeted(docs, changes).where("slug = 'a'").first().content
    assert text == "![x](https://h/i.png?a=1&amp;b=2) <img alt='' src=\"images/j.png\"> ![x](images/j.png)"
    files = spark.createDataFrame([("b", "images/k.png"), ("b", "images/old.png"), ("a", "images/z.png")], "slug string, path string")
    assert rows(images.orphans(docs, files)) == [("b", "images/old.png")] and rows(images.broken(docs, files.limit(0))) == [("b", "images/k.png")]
    names = spark.createDataFrame([("a", "X.png"), ("a", "Y.png"), ("a", "y.png"), ("a", "Q.PNG"), ("a", "q.Png")], "slug string, local string")
    assert rows(images.lower_case_names(names), "local", "target") == [("Q.PNG", "q.png"), ("X.png", "x.png")]


def test_provenance_claims_each_file_once(spark):
    fetched = spark.createDataFrame([("a", "https://h/one.png", "s", 0), ("a", "https://h/two.png", "s", 1), ("a", "https://h/three.png", "t", 2)], "slug string, source_url string, sha256 string, seq int")
    files = spark.createDataFrame([("a", "s", "two.png"), ("a", "s", "one-2.png")], "slug string, sha256 string, local string")
    assert rows(images.provenance(fetched, files), "source_url", "local") == [("https://h/one.png", "one-2.png"), ("https://h/three.png", None), ("https://h/two.png", "two.png")]


def test_checkpoint_folder_is_the_sessions(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
