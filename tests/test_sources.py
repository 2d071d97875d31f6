import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from manualmill.functions import dom, markup, urls
from manualmill.operators import routing
from manualmill.sources import archive, discover, profiles, sinks, specs
from manualmill.streaming import progress


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column).first()[0]


@pytest.mark.parametrize(
    "url, pattern",
    [
        ("https://support.apple.com/guide/numbers/welcome/mac", "apple_help"), ("https://d.example/llms.txt", "llms_txt"), ("https://x.readthedocs.io/en/latest/", "readthedocs"), ("https://x.readthedocs.io/en.pdf", "pdf_url"),
        ("https://github.com/o/r", "github_markdown"), ("https://github.com/o", "docs_probe"), ("https://x.example/hc/en-us", "zendesk_help"), ("https://x.zendesk.com/article_attachments/1", "docs_probe"), ("https://openstax.org/books/a", "openstax"),
        ("https://x.example/swagger", "api_spec"), ("/tmp/spec.yaml", "api_spec"), ("https://x.example/a.tgz?x=1", "archive_download"), ("https://x.gitbook.io", "gitbook"), ("ftp://x.example", None), ("", None), (None, None), ("http://[broken", "docs_probe"),
    ],
)
def test_routes(spark, url, pattern):
    assert one(spark, routing.classify(F.col("u")), u=url) == pattern


@pytest.mark.parametrize("h, slug", [("docs.pytest.org", "pytest"), ("www.mkdocs.org", "mkdocs"), ("docusaurus.io", "docusaurus"), ("a_b.github.io:80", "a-b"), ("docs", "docs"), ("", "docs")])
def test_host_slugs(spark, h, slug):
    assert one(spark, urls.slug_from_host(F.col("h")), h=h) == slug


def test_probe_side_requests(spark):
    c = routing.probe(F.col("b"), F.col("i"), F.col("l"))
    assert one(spark, c, b="<p>", i='{"docs": [1]}', l=None) == "mkdocs" and one(spark, c, b="<p>", i="<html>", l="- https://x/y.md") == "llms_txt" and one(spark, c, b="<p>", i=None, l=None) is None


def test_lenient_dom():
    assert dom.parse("<p>a<p>b</i></p><ul><li>1<li>2</ul>").outer() == "<p>a</p><p>b</p><ul><li>1</li><li>2</li></ul>"
    assert dom.parse('<script>if (a < b) "</p>"</script><img src=x>').outer() == '<script>if (a < b) "</p>"</script><img src="x"/>'
    root = dom.parse('<div class="a b" id=i><span data-x="yz">t</span></div>')
    for s in ("div.a.b", "#i", "[data-x]", "[data-x^=y]", "p, span", "[data-x=yz]", "[data-x*=z]"):
        assert len(dom.select(root, s)) == 1, s
    assert dom.select(root, "div.c, #j, [data-x=y]") == []


@pytest.mark.parametrize(
    "html, src",
    [
        ('<picture><source media="(not all)" srcset="/dead.png 9000w"><source srcset="/a.png 100w, /b.png 200w"><img src="/c.png"></picture>', "https://h/b.png"), ('<picture><source media="print" srcset="/p.png 9000w"><img src="/c.png"></picture>', "https://h/p.png"),
        ('<img src="/c.png" srcset="/d.png 1x">', "https://h/d.png"), ('<picture><source srcset="/a.png 1x, /a2.png 2x"></picture>', "https://h/a2.png"), ('<img src="/x?$p$" srcset="/x?WID=1199, /x?wid=599">', "https://h/x?WID=1199"), ('<img src="images/x.png" srcset="/a.png 900w">', "https://h/d/images/x.png"),
        ('<img src="data:image/gif;base64,AA" data-src="/lazy.png">', "https://h/lazy.png"), ('<img src="/a.png?wid=100" srcset="/b.png?wid=900 2x">', "https://h/b.png?wid=900"), ('<img src="data:x">', None), ("<picture></picture>", None),
    ],
)
def test_images_become_plain(html, src):
    out = profiles.extract(f"<article>{html}</article>", "https://h/d/p.html", "docusaurus")
    found = [n.attrs for n in dom.select(dom.parse(out), "img")]
    assert [{k: v for k, v in f.items() if k != "alt"} for f in found] == ([{"src": src}] if src else [])


def test_profiles():
    x = profiles.extract
    deep = x("<article>" + "<div>" * 3000 + "t" + "</div>" * 3000 + "</article>", "https://h", "docusaurus")
    assert deep.count("<div>") == 3000 and dom.parse(deep).text() == "t"
    assert x('<main id="main-content">shell</main>', "https://h", "openstax") is None and x('<main class="page-content"><div data-type="page"> in </div></main>', "https://h", "openstax") == "in"
    assert x('<main class="page-content">whole</main>', "https://h", "openstax") == "whole"
    assert x('<div role="main"><h1>T<a class="headerlink">#</a></h1><a href="../b">l</a></div>', "https://h/a/c", "sphinx") == '<div role="main"><h1>T</h1><a href="https://h/b">l</a></div>'
    assert x("<p>none</p>", "https://h", "sphinx") is None and x(None, "https://h", "hugo") is None and x("", "https://h", "hugo") is None
    assert x('<div id="content"><div id="contentOrg">in</div></div>', "https://h", "asciidoctor") == '<div id="contentOrg">in</div>'
    assert x('<div id="article-section"><div><h1>A</h1><h2>B</h2><div class="LinkUniversal"><a>1</a><a>2</a></div></div></div>', "https://h", "apple_help", 5) == '<h5>A</h5><h6>B</h6><div class="LinkUniversal"><ul><li><a>1</a></li><li><a>2</a></li></ul></div>'
    assert x('<div class="container" role="main"><ol class="breadcrumb"></ol><h1>A</h1><a href="b.html?page=2">c</a></div>', "https://h/", "st4", 3) == '<div class="container" role="main"><h4>A</h4><a href="https://h/b.html">c</a></div>'
    assert x("<p></p><p><iframe></iframe></p><div id='rank-math-toc'>t</div>", "https://h", "wordpress") == "<p><iframe></iframe></p>"
    assert x('<div id="ocArticle"><nav>n</nav><p class="supTOC">x</p><p>y</p></div>', "https://h", "microsoft_support") == "<p>y</p>"


def test_topic_trees_of_any_depth(spark):
    deep = "x = [" + '{"text":"a","nodes":[' * 150 + "]}" * 150 + "];"
    assert len(discover._topic_rows(deep)) == 150 and discover._topic_rows("[" * 99_999) == [] and discover._topic_rows(None) == [] and discover._topic_rows("none") == []


def test_discovery(spark):
    def pages(df, column="url"):
        return [r[column] for r in df.orderBy("ord").collect()]

    src = spark.createDataFrame([("s", "- https://x/a.md) [b](https://x/d/b.md) https://x/a.md https://x/c#k.md", '{"e":"t1"} {"e" : "t2"} {"e":"t1"}', '"url":"a.html#x" "url":"a.html" "url":"b.html" "url":"#z"')], "s string, llms string, click string, pal string")
    assert pages(discover.llms_pages(src, "llms", ["s"])) == ["https://x/a.md", "https://x/d/b.md"]
    assert pages(discover.llms_pages(src.withColumn("sec", F.lit("https://x/d")), "llms", ["s"], "sec")) == ["https://x/d/b.md"]
    assert pages(discover.clickhelp_topics(src, "click", ["s"]), "topic") == ["t1", "t2"] and pages(discover.paligo_pages(src, "pal", ["s"]), "page") == ["a.html", "b.html"]
    tree = spark.createDataFrame([("s", p, "blob") for p in ("b.md", "a.md", "README.md", "z/c.md", "x.txt")] + [("s", "d.md", "tree")], "s string, path string, type string")
    toc = spark.createDataFrame([("s", "[x](/docs/b#top) [y](none)")], "s string, body string")
    assert pages(discover.repository_pages(tree, toc, ["s"]), "path") == ["b.md", "a.md", "z/c.md"]
    assert one(spark, discover.zendesk_endpoint(F.col("u")), u="https://x.example/hc/de-de/articles/12-Start") == "https://x.example/api/v2/help_center/de-de/articles/12.json"
    assert one(spark, discover.zendesk_endpoint(F.col("u")), u="https://x.example/hc") == "https://x.example/api/v2/help_center/en-us/articles.json?per_page=100"
    body = spark.createDataFrame([("s", '{"articles": [{"title": "A", "body": "b", "html_url": "u"}]}'), ("t", '{"article": {"title": "B"}}'), ("u", "no json"), ("v", None)], "s string, body string")
    assert sorted((r.s, r.title) for r in discover.zendesk_articles(body, "body", ["s"]).collect()) == [("s", "A"), ("t", "B")]
    found = {u: one(spark, discover.sphinx_wanted(F.col("u"), F.lit("https://h/en/")), u=u) for u in ("https://h/en/a.html", "https://h/en/genindex.html", "https://h/en/_static/x.html", "https://h/de/a.html")}
    assert list(found.values()) == [True, False, False, False]


def test_specifications(spark):
    old = (
        '{"swagger": "2.0", "host": "h", "basePath": "/v1", "definitions": {"P": {"required": ["a"], "properties": {"a": {"type": "string", "description": "A"}, "b": {"$ref": "#/definitions/Q"}}}, "Q": {"type": "integer"}},'
        '"parameters": {"lim": {"name": "limit", "in": "query", "type": "integer"}}, "responses": {"Gone": {}},'
        '"paths": {"/a": {"parameters": [{"$ref": "#/parameters/lim"}], "post": {"summary": "S", "description": "S", "parameters": [{"in": "body", "schema": {"$ref": "#/definitions/P"}}], "responses": {"200": {"description": " ok "}, "404": {"$ref": "#/responses/Gone"}, "500": {"$ref": "#/responses/500"}}}, "get": null}}}'
    )
    collection = '{"info": {"name": "Set", "schema": "v2"}, "item": [{"name": "F", "item": [{"name": "R", "request": {"method": "PUT", "url": {"raw": "u"}, "header": [{"key": "A", "value": "b"}], "body": {"raw": " x "}}, "response": [{"name": "ok", "code": 200}]}]}, "junk"]}'
    rows = [
        ("old", old), ("set", collection), ("yaml", "openapi: 3.0.0\ninfo: {title: Y}\npaths: {}"), ("null key", '{"openapi": null}'), ("list", "[1]"), ("broken", "{"), ("empty", ""), ("null", None),
        ("deep", '{"openapi": "3", "paths": ' + '{"a":' * 3000 + "1" + "}" * 3001), ("deep list", "[" * 9000), ("deep set", '{"info": {"schema": 1}, "item": ' + '[{"item":' * 400 + "[]" + "}]" * 400 + "}"),
    ]
    got = {r.name: r for r in specs.rendered(spark.createDataFrame(rows, "name string, body string"), "name", "body").collect()}
    assert len(got) == len(rows)
    assert got["old"].content == (
        "# api-spec\n\n**Base URL:** `https://h/v1`\n\n## POST /a\n\nS\n\n**Parameters:**\n\n| Name | In | Type | Required | Description |\n| --- | --- | --- | --- | --- |\n| `limit` | query | integer | no |  |\n\n"
        "**Request body:**\n\n- `a` _string_ (required) — A\n- `b` _integer_\n\n**Responses:**\n- `200` — ok\n- `404` — Gone\n- `500`\n"
    )
    assert got["set"].content == "# Set\n\n## F\n\n### R\n\n`PUT u`\n\n**Headers:**\n\n- `A: b`\n\n**Body:**\n\n```\nx\n```\n\n_Example response: ok (200)_\n" and got["set"].pages == 1
    assert tuple(got["yaml"]) == ("yaml", "openapi", "Y", 0, "# Y\n") and got["null key"].format == "openapi"
    assert all(got[n].format is None and got[n].pages == 0 for n in ("list", "broken", "empty", "null", "deep", "deep list"))


def test_archives(spark):
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("c10.txt", "ten")
        f.writestr("c2.txt", b"t\xffwo")
        f.writestr("../evil.txt", "no")
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("a.md")
        info.size = 1
        f.addfile(info, io.BytesIO(b"m"))
    locked = bytearray(z.getvalue())  # the flag of encryption, in the header and in the directory
    locked[6] |= 1
    locked[locked.index(b"PK\x01\x02") + 8] |= 1
    files = spark.createDataFrame([("z", bytearray(z.getvalue())), ("t", bytearray(t.getvalue())), ("bad", bytearray(b"x")), ("null", None), ("locked", locked)], "source string, data binary")
    members = archive.members(files)
    assert sorted(r.source for r in members.where("error IS NOT NULL").collect()) == ["bad", "locked", "null"]
    assert archive._rows("big", z.getvalue(), 4) == [("big", None, None, None, "too large")]
    got = archive.reading_order(members).orderBy("source", "ord").collect()
    assert [(r.source, r.member, r.kind) for r in got] == [("t", "a.md", "markdown"), ("z", "c2.txt", "markdown"), ("z", "c10.txt", "markdown")] and got[1].text == "t�wo"


def test_staging_replaces_whole_slugs(spark, tmp_path):
    folder = str(tmp_path / "corpus")
    assert sinks.current(spark, folder) is None
    sinks.stage(spark, folder, spark.createDataFrame([("a", "1"), ("b", "1")], "slug string, content string"))
    sinks.stage(spark, folder, spark.createDataFrame([("b", "2"), ("c", "2")], "slug string, content string"))
    assert sorted(tuple(r) for r in sinks.current(spark, folder).collect()) == [("a", "1"), ("b", "2"), ("c", "2")]
    pages = spark.createDataFrame([("m", 3, "p", "html", "https://h", "<p>")], "slug string, ord int, stem string, ext string, source_url string, body string")
    assert sinks.file_tree(sinks.raw_pages(pages), str(tmp_path / "tree")).first().file == "m/raw/0003-p.html"
    assert (tmp_path / "tree/m/raw/0003-p.html").read_text() == "<!-- source: https://h -->\n<p>"


def test_streams(spark, tmp_path):
    from datetime import datetime

    t = datetime(2025, 1, 1)
    df = spark.createDataFrame([(1, t, "a"), (1, t, "a"), (2, t, "b"), (3, datetime(2025, 1, 1, 3), "a")], "id int, ts timestamp, k string")
    df.write.parquet(str(tmp_path / "in"))
    stream = progress.once(progress.feed(spark, str(tmp_path / "in"), "id int, ts timestamp, k string"), "ts", "id", "1 hour")
    q = stream.writeStream.format("memory").queryName("once_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.table("once_out").collect()) == [1, 2, 3]
    assert sorted((r.k, r.n) for r in progress.tumbling(df, "ts", "k").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert sorted((r.k, r.n) for r in progress.sessions(df, "ts", "k", "6 hours").collect()) == [("a", 3), ("b", 1)]


def test_markup_scalars(spark):
    assert one(spark, markup.page_title(F.col("h")), h="<TITLE> A &amp; B </TITLE>").strip("  ") == "A & B" and one(spark, markup.page_title(F.col("h")), h="<p>") is None
    assert one(spark, markup.generator_meta(F.col("h")), h='<meta content="MkDocs-1" name=generator>') == "mkdocs-1"
    assert one(spark, markup.strip_scripts(F.col("h")), h="a<script>x</script>b<STYLE>y</STYLE >c") == "abc"
    assert one(spark, urls.human_size(F.lit(2304))  , h="") == "2.2 KB" and one(spark, urls.image_name(F.col("u")), u="https://h/A b.JPEG?x=1") == "a-b.jpg" and one(spark, urls.image_name(F.col("u")), u="https://h/") == "image"


def test_single_systems(spark):
    from manualmill.sources import systems as s

    assert one(spark, s.clickhelp_slug(F.col("u")), u="https://h/docs/Prod_One/manual/HTML/x.html") == "prod-one" and one(spark, s.clickhelp_slug(F.col("u")), u="https://h/x.html") == "manual"
    assert one(spark, s.paligo_base(F.col("u"), F.col("b")), u="https://h/p/index.html", b='<a href="de/start.html">') == "https://h/p/de" and one(spark, s.paligo_base(F.col("u"), F.col("b")), u="https://h/p/x.html", b="") == "https://h/p"
    assert one(spark, s.st4_title(F.col("t")), t='var projectTitle = "[web] Pump 7";') == "Pump 7" and one(spark, s.st4_title(F.col("t")), t="none") is None
    assert one(spark, s.book_title(F.col("h")), h="<title>1.1 Cells - Why - Concepts of Biology | OpenStax</title>") == "Concepts of Biology" and one(spark, s.book_title(F.col("h")), h="") is None
    assert tuple(one(spark, s.language_and_version(F.col("u")), u="https://x.readthedocs.io/de/stable/a")) == ("de", "stable") and tuple(one(spark, s.language_and_version(F.col("u")), u="https://x/")) == ("en", "latest")
    assert one(spark, s.pdf_slug(F.col("u")), u="https://h/My%20Manual+1.PDF") == "my-manual-1" and one(spark, s.pdf_slug(F.col("u")), u="https://www.site.example/_/downloads/en/1/pdf/") == "site"
    assert [r[0] for r in spark.createDataFrame([("Café Ü/2",), ("///",), (None,), ("..",)], "t string").select(s.folded_slug(F.col("t"))).collect()] == ["cafe-u-2", None, None, None]
    data = spark.createDataFrame([(bytearray(b"\r\n%PDF-1.4"),), (bytearray(b"x" * 1024 + b"%PDF-"),), (None,)], "d binary")
    assert [r[0] for r in data.select(s.is_pdf(F.col("d"))).collect()] == [True, False, None]


def test_contents_tree_of_a_guide():
    from manualmill.sources.systems import _topics

    html = '<div id="modal-toc-container"><ul class="toc"><li><button>Basics</button><ul><li><a href="/guide/n/one-1/mac">One</a></li><li><a href="/guide/n/one-1/mac">Again</a></li></ul></li><li><a data-ajax-endpoint="/guide/n/two-2/x">Two</a><ul><li><a href="/guide/n/three-3/x">Three</a></li></ul></li></ul></div>'
    assert [(t["kind"], t["name"], t["level"]) for t in _topics(html)] == [("group", "Basics", 2), ("topic", "one-1", 3), ("topic", "two-2", 2), ("topic", "three-3", 3)]
    assert _topics(None) == [] and _topics("<p>") == []


def test_images_of_rendered_pages(spark):
    from manualmill.sources import systems as s

    html = '<img src="~gitbook/image?url=https%3A%2F%2Fh%2Fo%2Fassets%252FB7.png%3Falt&w=1"><img src="~gitbook/image?url=https%3A%2F%2Fh%2Fo%2Fuploads%252Fx.png"><img src="~gitbook/image?url=https%3A%2F%2Fh%2Fspace%252Ficon%252Fy.png">'
    assert one(spark, s.proxied_images(F.col("h")), h=html) == ["https://h/o/assets%2FB7.png?alt", "https://h/o/uploads%2Fx.png"] and one(spark, s.proxied_images(F.col("h")), h=None) == []
    got = one(spark, s.gitbook_page(F.col("m"), F.col("h"), F.lit("https://o")), m="![a](/files/Q1) ![b](/files/B7) ![c](/files/Z9) [d](/e)\n\n---\n\n# Agent Instructions\nx", h=html)
    assert got == "![a](https://h/o/uploads%2Fx.png) ![b](https://h/o/assets%2FB7.png?alt) ![c](https://o/files/Z9) [d](https://o/e)"
    assert one(spark, s.gitbook_page(F.col("m"), F.col("h"), F.lit("https://o")), m=None, h=None) is None


def test_articles_and_aliases(spark):
    from manualmill.sources import systems as s

    pages = spark.createDataFrame([("a", 1, '<h1>T</h1><div id="ocArticle">x</div>'), ("a", 2, '<div id="ocArticle">shell</div>'), ("a", 3, "<p>none</p>")], "s string, ord int, html string")
    got = s.support_article(pages.withColumn("url", F.lit("https://h/")), "html", "url").orderBy("ord").collect()
    assert [(r.ord, r.title, r.body) for r in got] == [(1, "T", "x"), (3, "", None)]
    same = spark.createDataFrame([("a", 2, "x"), ("a", 1, "x"), ("a", 3, None), ("a", 4, None), ("b", 5, "x")], "s string, ord int, body string")
    assert sorted(r.ord for r in s.unaliased(same, ["s"], "ord", "body").collect()) == [1, 3, 4, 5]
