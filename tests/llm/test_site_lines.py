from manualmill.llm import site_lines
from manualmill.llm.site_lines import normal_form

LEGAL = "All rights in this manual are reserved by the publisher, {}."
SHARE = "Share this page with your whole team by mail or printed card!"


def frames(spark, n=9):
    docs, manifests = [], []
    for k in range(n):
        lines = [f"Text of manual number {k} that nobody else in the world has", "<p>" + LEGAL.format("2020") + "</p>", SHARE.upper() if k % 2 else f"*{SHARE}*", "short line"]
        docs.append((f"d{k}", "\r\n".join(lines)))
        manifests.append((f"d{k}", "https://user@HOST.example:443/a?b", "2024-01-01T00:00:00Z"))
    docs += [("other", "\n".join([LEGAL.format("2020"), SHARE])), docs[0], ("null", None), (None, SHARE), ("empty", "")]
    manifests += [("other", "https://second.example/", "2024-01-01T00:00:00Z"), ("d0", "https://old.example/", "2020-01-01T00:00:00Z"), ("null", None, None), (None, "https://host.example/", None)]
    return spark.createDataFrame(docs, "slug string, content string"), spark.createDataFrame(manifests, "slug string, source_url string, ingested_at string")


def test_normal_form():
    assert normal_form("<b>Ä-1</b> < 2 x_y </not a tag") == "ä12xynotatag"


def test_repeated_lines_of_one_site(spark):
    docs, manifests = frames(spark)
    got = {tuple(r) for r in site_lines.repeated_lines(docs, "slug", "content", site_lines.sites(manifests)).select("key", "line_no").collect()}
    assert got == {(f"d{k}", n) for k in range(9) for n in (2, 3)}


def test_seven_documents_are_too_few(spark):
    docs, manifests = frames(spark, 7)
    assert site_lines.repeated_lines(docs, "slug", "content", site_lines.sites(manifests)).count() == 0


def test_blocks_join_lines_that_follow_one_another(spark):
    docs, manifests = frames(spark)
    found = site_lines.kept_nodes(docs, "slug", "content", site_lines.sites(manifests))
    rows = site_lines.blocks(found).collect()
    repeated = site_lines.repeated_lines(docs, "slug", "content", site_lines.sites(manifests))
    assert {r.block for r in repeated.collect()} == {r.block for r in rows} and repeated.count() == found.count()
    assert len(rows) == 2 and len({r.block for r in rows}) == 1 and {r.block_lines for r in rows} == {2} and {r.site for r in rows} == {"host.example"}


def test_removal_keeps_everything_else(spark):
    docs, manifests = frames(spark)
    out = {r.key: r for r in site_lines.without_repeated_lines(docs, "slug", "content", site_lines.sites(manifests)).where("key IS NOT NULL").collect()}
    assert out["d3"].text == "Text of manual number 3 that nobody else in the world has\r\nshort line" and out["d3"].removed == 2
    assert out["null"].text is None and out["empty"].text == "" and out["other"].removed == 0 and len(out) == 12


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "slug string, content string, site string, line long, key int, text int, documents int")
    site = site_lines.sites(spark.createDataFrame([], "slug string, source_url string, ingested_at string"))
    assert site_lines.repeated_lines(docs, "slug", "content", site).count() == 0
    assert site_lines.without_repeated_lines(docs, "slug", "content", site).count() == 0
    assert site_lines.blocks(site_lines.kept_nodes(docs, "slug", "content", site)).count() == 0
