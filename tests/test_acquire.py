import io
import zipfile

import pytest
from pyspark.sql import functions as F

from manualmill.sources import acquire

ANSWER = "url string, final_url string, status int, body string, data binary"


def answers(spark, rows):
    """rows are (url, body), (url, body, status) or (url, body, status, final_url)."""
    full = [(r[0], r[3] if len(r) > 3 else r[0], r[2] if len(r) > 2 else 200, r[1] if isinstance(r[1], str) else None, bytearray(r[1]) if isinstance(r[1], bytes) else None) for r in rows]
    return spark.createDataFrame(full, ANSWER)


def run(spark, system, url, rows, cap=None, **more):
    seeds = spark.createDataFrame([("s", url)], "source string, url string")
    found = acquire.acquired(system, seeds, answers(spark, rows), cap)
    pages = [(r.url.rsplit("/", 1)[-1] if r.url else None, r.body) for r in found.pages.orderBy("ord").collect()]
    return pages, acquire.counters(found).first()


def article(text):
    return f"<article><p>{text}</p></article>"


def urlset(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


D = "https://d.example"


def test_an_index_with_losses_and_a_cap(spark):
    pages = [f"{D}/docs/p{k}" for k in range(5)]
    rows = [(f"{D}/sitemap.xml", urlset(*pages, f"{D}/docs/2.x/p", f"{D}/blog/p"))] + [(u, article(u[-1])) for u in pages[:2]] + [(pages[2], "gone", 404), (pages[3], "<p>no article</p>")]
    got, c = run(spark, "docusaurus", f"{D}/docs/", rows)
    assert [b for _, b in got] == ["<article><p>0</p></article>", "<article><p>1</p></article>", None, None, None] and (c.pages, c.lost, c.truncated, c.error) == (2, 3, False, None)
    got, c = run(spark, "docusaurus", f"{D}/docs", rows + rows, cap=2)
    assert (c.pages, c.lost, c.truncated) == (2, 0, True)
    assert run(spark, "docusaurus", D, [])[1].error == "index: no response" and run(spark, "docusaurus", D, [(f"{D}/sitemap.xml", "<html>")])[1].error == "the index lists no page"
    assert run(spark, "docusaurus", D, [(f"{D}/sitemap.xml", None)])[1].error == "index: no body" and run(spark, "docusaurus", D, [(f"{D}/sitemap.xml", "x", 500)])[1].error == "index: HTTP 500"


def test_sitemaps_of_sitemaps(spark):
    index = f"<sitemapindex><sitemap><loc>{D}/en/sitemap.xml</loc></sitemap><sitemap><loc>{D}/de/sitemap.xml</loc></sitemap></sitemapindex>"
    rows = [(f"{D}/sitemap.xml", index), (f"{D}/de/sitemap.xml", urlset(f"{D}/a/x", f"{D}/a/print/x")), (f"{D}/a/x", "<main>x<nav>n</nav></main>"), (f"{D}/a/sitemap.xml", "not found", 404)]
    got, c = run(spark, "hugo", f"{D}/a/index.html", rows)
    assert got == [("x", "<main>x</main>")] and c.truncated and c.lost == 0
    rows.append((f"{D}/en/sitemap.xml", urlset(f"{D}/a/y")))
    got, c = run(spark, "hugo", f"{D}/a/index.html", rows)
    assert [u for u, _ in got] == ["y", "x"] and not c.truncated and c.lost == 1
    assert run(spark, "hugo", f"{D}/a/", [])[1].error == "index: no sitemap"


def test_a_crawl_follows_links_in_its_order_and_stops_at_saved_pages(spark):
    page = lambda text, *links: f'<div role="main">{text}</div>' + "".join(f'<a href="{x}">l</a>' for x in links)
    rows = [
        (f"{D}/en/", page("home", "b.html#x", "a.html", "genindex.html", "../de/z.html", "https://o.example/en/q.html")), (f"{D}/en/b.html", page("b", "c.html", "a.html")), (f"{D}/en/a.html", "<p>none</p><a href='d.html'>d</a>"),
        (f"{D}/en/c.html", page("c", "index.html")), (f"{D}/en/d.html", page("d")), (f"{D}/en/unlinked.html", page("u")), (f"{D}/de/z.html", page("z")),
    ]
    got, c = run(spark, "sphinx", f"{D}/en/index.html", rows)
    assert [u for u, _ in got] == ["", "b.html", "a.html", "c.html", "d.html", "index.html"] and (c.pages, c.lost, c.truncated) == (4, 2, False)
    got, c = run(spark, "sphinx", f"{D}/en", rows, cap=3)
    assert [u for u, _ in got] == ["", "b.html", "a.html", "c.html"] and (c.pages, c.lost, c.truncated) == (3, 1, True)


def test_siblings_that_are_absent_are_not_lost(spark):
    page = lambda text, *links: f'<div id="content">{text}</div>' + "".join(f'<a href="{x}">l</a>' for x in links)
    rows = [
        (f"{D}/m/", page("home", "a.html", "b.html", "c.html", "e.html", "f.html", "../x.html"), 200, f"{D}/m/index.html"), (f"{D}/m/a.html", page("a")), (f"{D}/m/b.html", "", 404), (f"{D}/m/c.html", "", 500),
        (f"{D}/m/e.html", page("a")), (f"{D}/m/f.html", page("away"), 200, f"{D}/other/f.html"), (f"{D}/x.html", page("up")),
    ]
    got, c = run(spark, "asciidoctor", f"{D}/m", rows)
    assert [u for u, _ in got] == ["index.html", "a.html", "c.html"] and (c.pages, c.lost) == (2, 1)


def test_a_chain_is_cut_by_a_page_that_does_not_answer(spark):
    base = "https://openstax.org/books/b/pages"
    page = lambda k, back, on: f"<title>P - The Book | OpenStax</title>" + (f'<a aria-label="Previous Page" href="{back}">p</a>' if back else "") + (f'<a href="{on}" aria-label="Next Page">n</a>' if on else "") + f'<main class="page-content"><p>{k}</p></main>'
    rows = [(f"{base}/a", page(1, None, "b")), (f"{base}/b", page(2, "a", "c")), (f"{base}/c", page(3, "b", "d"))]
    got, c = run(spark, "openstax", f"{base}/c", rows)
    assert [u for u, _ in got] == ["a", "b", "c"] and c.truncated and c.title == "The Book" and c.lost == 0
    got, c = run(spark, "openstax", f"{base}/b", rows + [(f"{base}/d", page(4, "c", "a"))])
    assert [u for u, _ in got] == ["a", "b", "c", "d"] and not c.truncated
    assert run(spark, "openstax", "https://openstax.org/books/b", [])[1].error == "no first page"


def test_a_long_chain_is_whole(spark):
    base = "https://openstax.org/books/b/pages"
    rows = [(f"{base}/{k}", (f'<a aria-label="Next Page" href="{k + 1}">n</a>' if k < 1199 else "") + f'<main class="page-content">{k}</main>') for k in range(1200)]
    got, c = run(spark, "openstax", f"{base}/0", rows)
    assert [int(u) for u, _ in got] == list(range(1200)) and not c.truncated
    assert run(spark, "openstax", f"{base}/0", rows, cap=700)[1].truncated


def most_rows(spark, action):
    """The result of action, and the most rows that an operator of its plans made."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before, most = store.executionsCount(), 0
    last = store.executionsList().last().executionId() if before else -1
    result = action()
    bus.waitUntilEmpty(30_000)
    done = store.executionsList()
    for e in (done.apply(k) for k in range(done.size())):
        if e.executionId() > last:
            rows = {e.metrics().apply(k).accumulatorId() for k in range(e.metrics().size()) if e.metrics().apply(k).name() == "number of output rows"}
            values = store.executionMetrics(e.executionId()).iterator()
            while values.hasNext():
                pair = values.next()
                if pair._1() in rows:
                    most = max(most, int(pair._2().replace(",", "")))
    return result, most


def test_guides_of_one_host_meet_only_their_own_pages(spark):
    g = "https://support.apple.com/guide"
    page = lambda k, *links: f'<div id="article-section"><div><h1>P{k}</h1>{" ".join(links)}</div></div>'
    seeds, rows = [], []
    for n in range(60):
        seeds.append((f"s{n}", f"{g}/g{n}/welcome/1/mac/1"))
        paths = [f"/guide/g{n}/p{k}/1/mac/1" for k in range(3)]
        rows.append((seeds[-1][1], page("w", *paths, f"/guide/g{n + 1}/p0/1/mac/1", f"/guide/g{n}/p9/1/macos/1")))
        rows += [(f"https://support.apple.com{x}", page(f"{n}.{k}"), 500 if k == 2 else 200) for k, x in enumerate(paths)]
    seeds.append(("other platform", f"{g}/g0/welcome/1/macos/1"))
    rows += [(seeds[-1][1], page("w", "/guide/g0/p7/1/macos/1")), (f"{g}/g0/p7/1/macos/1", page("m")), ("https://o.example/guide/g0/p8/1/mac/1", page("o"))]
    answered = answers(spark, rows)

    def action():
        found = acquire.acquired("apple_help", spark.createDataFrame(seeds, "source string, url string"), answered)
        return [(r.source, r.body) for r in found.pages.orderBy("source", "ord").collect()], {r.source: (r.pages, r.lost) for r in acquire.counters(found).collect()}

    (got, c), most = most_rows(spark, action)
    assert c == {f"s{n}": (2, 1) for n in range(60)} | {"other platform": (1, 0)}
    assert [b.split("<")[1] for _, b in got if b and b.startswith("<h2>P7.")] == ["h2>P7.0", "h2>P7.1"] and [b for s, b in got if s == "other platform"] == ["<h2>Pm</h2>"]
    assert most < 1000  # each with each are 61 times 243


def test_books_of_one_host_are_walked_along_links_that_are_kept_once(spark):
    b = "https://openstax.org/books"
    page = lambda k, back, on: f"<title>P - Book {k} | OpenStax</title>" + (f'<a aria-label="Previous Page" href="{back}">p</a>' if back else "") + (f'<a href="{on}" aria-label="Next Page">n</a>' if on else "") + f'<main class="page-content"><p>{k}</p></main>'
    seeds = [(f"s{n}", f"{b}/b{n}/pages/p1") for n in range(60)] + [("again", f"{b}/b7/pages/p2"), ("none", f"{b}/none/pages/p0")]
    rows = [(f"{b}/b{n}/pages/p{k}", page(f"{n}.{k}", f"p{k - 1}" if k else "", f"p{k + 1}" if k < 3 else ""), 500 if n == 9 and k == 2 else 200) for n in range(60) for k in range(4)]
    rows[3] = (rows[3][0], page("0.3", "p2", "/books/b1/pages/p2"))  # leads on into another book
    answered = answers(spark, rows)

    def action():
        found = acquire.acquired("openstax", spark.createDataFrame(seeds, "source string, url string"), answered, 5)
        return [(r.source, r.body[3:-4]) for r in found.pages.orderBy("source", "ord").collect()], {r.source: r for r in acquire.counters(found).collect()}

    (got, c), most = most_rows(spark, action)
    want = {s: [f"{n}.{k}" for k in range(4)] for n, s in [(n, f"s{n}") for n in range(60)] + [(7, "again")]} | {"s0": ["0.0", "0.1", "0.2", "0.3", "1.2"], "s9": ["9.0", "9.1"]}
    assert got == [(s, x) for s in sorted(want) for x in want[s]]
    assert {s for s in c if c[s].truncated} == {"s0", "s9", "none"} and c["none"].error == "no first page" and c["again"].title == "Book 7.0"
    assert most < 1000  # each with each are 62 times 239


def test_numbered_sitemaps_end_at_the_first_that_is_missing(spark):
    s, a = "https://support.microsoft.com/_sitemaps/word_en-us_", "https://support.microsoft.com/en-us/office/"
    rows = [(f"{s}1.xml", urlset(a + "x")), (f"{s}2.xml", "", 404), (f"{s}3.xml", urlset(a + "z")), (a + "x", '<h1>T</h1><div id="ocArticle">body</div>')]
    got, c = run(spark, "microsoft_support", "https://support.microsoft.com/en-us/word", rows)
    assert got == [("x", "body")] and not c.truncated
    assert run(spark, "microsoft_support", "https://support.microsoft.com/en-us/word", rows[:1] + [(f"{s}2.xml", "", 403)] + rows[3:])[1].truncated
    hub = "https://support.microsoft.com/en-us/excel"
    got, c = run(spark, "microsoft_support", hub, [(hub, '<a href="/en-us/office/x">1</a><a href="/en-us/office/shell">2</a><a href="/en-us/office/x">3</a>'), rows[3], (a + "shell", '<div id="ocArticle">short</div>')])
    assert got == [("x", "body")] and c.lost == 0
    assert run(spark, "microsoft_support", hub, [])[1].error == "no article is listed"


def test_a_project_without_a_build_is_crawled(spark):
    p = "https://x.readthedocs.io"
    got, c = run(spark, "readthedocs", f"{p}/de/stable/a.html", [(f"{p}/_/downloads/de/stable/pdf/", "%PDF-1.4 x")])
    assert got[0][1] == "%PDF-1.4 x" and c.error is None
    got, c = run(spark, "readthedocs", p, [(f"{p}/_/downloads/en/latest/pdf/", "", 404), (f"{p}/en/latest/", '<div role="main">h</div>')])
    assert got == [("", '<div role="main">h</div>')] and c.pages == 1
    assert run(spark, "readthedocs", p, [(f"{p}/_/downloads/en/latest/pdf/", "<html>")])[1].error == "not a PDF" and run(spark, "readthedocs", p, [(f"{p}/_/downloads/en/latest/pdf/", "", 503)])[1].error == "HTTP 503"


def test_single_documents(spark):
    u = "https://a.example/x"
    got, c = run(spark, "api_spec", u, [(u, '{"openapi": "3", "info": {"title": "T", "version": "1"}, "paths": {}}')])
    assert got[0][1] == "# T 1\n" and c.title == "T 1"
    assert run(spark, "api_spec", u, [(u, "<html>")])[1].error == "neither OpenAPI nor Postman" and run(spark, "pdf_url", u, [(u, "<html>")])[1].error == "not a PDF"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("b2.html", "<body><p>two</p><script>x</script></body>")
        z.writestr("b10.html", "<body>ten</body>")
    got, c = run(spark, "archive_download", u, [(u, b.getvalue())])
    assert got == [("b2.html", "<p>two</p>"), ("b10.html", "ten")] and c.error is None
    assert run(spark, "archive_download", u, [(u, b"no")])[1].error and run(spark, "archive_download", u, [])[1].error == "no response"


def test_one_bad_source_ends_nothing(spark):
    seeds = spark.createDataFrame([("a", f"{D}/docs"), ("b", "https://b.example/x"), ("c", "ftp://c.example"), ("d", "https://d.example/none"), ("e", None), ("..", f"{D}/llms.txt")], "source string, url string")
    rows = [(f"{D}/docs", '<meta name="generator" content="Docusaurus">'), (f"{D}/sitemap.xml", urlset(f"{D}/docs/p")), (f"{D}/docs/p", article("p")), ("https://b.example/x", "<p>unknown</p>"), (f"{D}/llms.txt", f"- {D}/p.md"), (f"{D}/p.md", "text")]
    made = acquire.ingested(seeds, answers(spark, rows)).cache()
    got = {r.source: r for r in made.collect()}
    assert len(got) == 6 and got["a"].system == "docusaurus" and "<p>p</p>" in got["a"].content and got["a"].error is None and got[".."].content.endswith("text\n")
    assert got["b"].error.startswith("no content system") and got["c"].error == got["e"].error == "no pattern takes the address" and got["d"].error == "no response"
    none = spark.createDataFrame([], "slug string, sha256 string, ingested_at string")
    outcomes, manifests = acquire.staged(made, none, F.lit("2025-01-02 03:04:05").cast("timestamp"), "1")
    ended = {r.source: (r.status, r.error) for r in outcomes.collect()}
    assert ended["a"] == ("changed", None) and ended[".."] == ("failed", "the slug folds to nothing") and ended["d"][0] == "failed"
    assert [r.slug for r in manifests.collect()] == ["a"]
    sha = manifests.first().sha256
    held = spark.createDataFrame([("a", sha, "x"), ("other", sha, "x")], "slug string, sha256 string, ingested_at string")
    outcomes, manifests = acquire.staged(made, held, F.lit("2025-01-02 03:04:05").cast("timestamp"), "1")
    assert [(r.status, r.duplicate_of) for r in outcomes.where("source = 'a'").collect()] == [("unchanged", "other")] and manifests.count() == 0
    assert acquire.ingested(seeds.limit(0), answers(spark, [])).count() == 0


@pytest.mark.parametrize("system", sorted(acquire.SYSTEMS))
def test_no_seeds_and_no_answers(spark, system):
    none = spark.createDataFrame([], "source string, url string")
    found = acquire.acquired(system, none, answers(spark, []))
    assert found.pages.count() == 0 and found.flags.count() == 0
