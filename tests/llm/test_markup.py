import pytest

from manualmill.llm import residue_table, site_lines, style_tree
from manualmill.llm.residue import count_constructs
from manualmill.llm.style_tree import blocks

FOUND = [
    ("markdown", "a <b>c</b> d", {"html"}), ("markdown", "a &nbsp; b", {"html"}), ("markdown", "<!-- note -->", {"html"}), ("pdf", "x <br/> y", {"html"}),
    ("html", "<p>a **b** c</p>", {"markdown"}), ("html", "<p>a __b__ c</p>", {"markdown"}), ("html", "<p>~~a~~</p>", {"markdown"}), ("html", "<p>[a](/b)</p>", {"markdown"}),
    ("html", "<p>![a](b.png)</p>", {"markdown"}), ("html", "<p>## Title</p>", {"markdown"}), ("pdf", "Title\n=====\ntext", {"markdown"}), ("pdf", "| a | b |\n|---|---|\n| 1 | 2 |", {"markdown"}),
    ("pdf", "[a]: /b", {"markdown"}), ("pdf", "see [a][b]", {"markdown"}), ("html", "<p>[[A|b]]</p>", {"wiki"}), ("markdown", "{{ui|x}}", {"wiki"}), ("pdf", "'''a'''", {"wiki"}),
    ("markdown", "== Title ==", {"wiki"}), ("pdf", "{| class=x\n|-\n| a || b\n|}", {"wiki"}), ("html", "[[Category:X]]", {"wiki"}), ("markdown", "[[File:a_b.png|thumb|c]]", {"wiki"}),
    ("html", r"\begin{itemize}", {"latex"}), ("markdown", r"\textbf{a}", {"latex"}), ("pdf", r"\(a \leq b\)", {"latex"}), ("pdf", r"\[ a = \frac{1}{2} \]", {"latex"}), ("html", "<p>$t_{max} = 3k^2$</p>", {"latex"}),
    ("markdown", "{{Infobox device\n| name = a\n}}", {"wiki"}), ("markdown", r"a~\cite{b}", {"latex"}),
]
CLEAN = [
    ("markdown", "a **b** _c_ [d](e)\n\n# h\n\n| a | b |\n|---|---|"), ("html", "<p>a &amp; b</p>"), ("pdf", "It costs $3, a spare one $4."), ("markdown", r"kept at C:\fabric\nozzle\{x}"), ("pdf", "holds if 3 < 4, and 5 > 2"),
    ("html", "<p>set max_a_b to 4 * 5 * 6</p>"), ("markdown", "```\n<b>[[x]] $a_b$\n```"), ("html", "<pre><code>## x **y** [[z]]</code></pre>"), ("pdf", "text\n    <b>**code**</b> {{x}}\ntext"),
    ("markdown", "if [[ -f x ]]; then"), ("pdf", "a List<String> b"), ("html", "<p>snake_case_name and path/_private_/x</p>"), ("pdf", ""), ("pdf", None), (None, "plain"),
]


@pytest.mark.parametrize("kind, text, markups", FOUND)
def test_residue(kind, text, markups):
    assert set(count_constructs(kind, text)) == markups


@pytest.mark.parametrize("kind, text", CLEAN)
def test_no_residue(kind, text):
    assert count_constructs(kind, text) == {}


def test_plain_form_keeps_structure():
    text = "## A '''b'''\n\n- x <b>y</b>\n\n```\n<b>$HOME</b>\n```\n\n\\begin{equation}\na = \\sqrt{2}\n\\end{equation}\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n{| \n|-\n| p || q\n|}\n\n\\section{End}\n\nsee \\(x \\leq y\\) &amp; [[C|d]]"
    got = [b for *_, b in blocks("markdown", text)]
    assert got == ["## A b", "- x y", "```\n<b>$HOME</b>\n```", "$$a = \\sqrt{2}$$", "| h | i |", "| --- | --- |", "| 1 | 2 |", "| p | q |", "## End", "see $x \\leq y$ & d"]
    html = "<html><head><title>t</title></head><body><section><h2>A</h2><ul><li>x</li><li>y</li></ul><table><tr><td>1</td><td>2</td></tr></table><pre><code>a &lt; b</code></pre><footer>f</footer></section>"
    got = blocks("html", html)
    assert [b for *_, b in got] == ["## A", "- x", "- y", "| 1 | 2 |", "```\na < b\n```", "f"] and got[-1][:2] == (("body", "section", "footer", "p"), ("footer", "p"))
    assert blocks("pdf", "") == []


def test_table_of_residues(spark):
    rows = [("a", "html", "<p>**b**</p>", 1), ("a", "html", "<p>**b**</p>", 1), ("b", None, "<b>x</b>", 2), ("c", "pdf", None, 3), (None, "pdf", "<b>", 4), ("d", "pdf", "", 5)]
    got = residue_table.residues(spark.createDataFrame(rows, "slug string, kind string, content string, constructs int"), "slug", "kind", "content").collect()
    assert {tuple(r) for r in got} == {("a", "markdown", 1), ("b", "html", 2)}


def test_unimportant_branches_go(spark):
    docs = [(f"s{k}", "html", f"<p>Only in manual {k} of them all, number {k * k}</p><footer>Same footer on every page here</footer>") for k in range(12)]
    docs += [("alone", "html", "<footer>Same footer on every page here</footer>"), ("null", "html", None), ("empty", "pdf", ""), docs[0]]
    manifests = [(f"s{k}", "https://a.example/", "x") for k in range(12)] + [("alone", "https://b.example/", "x")]
    site = site_lines.sites(spark.createDataFrame(manifests, "slug string, source_url string, ingested_at string"))
    out = {r.key: r for r in style_tree.cleaned(spark.createDataFrame(docs, "slug string, kind string, content string"), "slug", "kind", "content", site).collect()}
    assert len(out) == 15 and out["s3"].text == "Only in manual 3 of them all, number 9" and out["s3"].removed == 1
    assert out["alone"].text == "Same footer on every page here" and out["null"].text is None and out["empty"].text == ""


def test_only_the_unimportant_place_of_a_leaf_goes(spark):
    docs = [(f"s{k}", "html", f"<h2>{'Getting started guide' if k == 3 else f'The chapter of manual {k}'}</h2><p>Text of {k} and no other</p><footer>Getting started guide</footer>") for k in range(12)]
    site = site_lines.sites(spark.createDataFrame([(d[0], "https://a.example/", "x") for d in docs], "slug string, source_url string, ingested_at string"))
    out = {r.key: r for r in style_tree.cleaned(spark.createDataFrame(docs, "slug string, kind string, content string"), "slug", "kind", "content", site).collect()}
    assert out["s3"].text == "## Getting started guide\n\nText of 3 and no other" and {r.removed for r in out.values()} == {1}


SIDE = "Every page has this sentence in its sidebar"


@pytest.mark.parametrize("around", ["ul", "ol"])
def test_a_sentence_of_the_sidebar_stays_in_the_article(spark, around):
    page = lambda k: f'<div class="side"><{around}><li>{SIDE}</li></{around}></div><div class="article"><{around}><li>{SIDE if k == 5 else f"Item {k} that no other page has"}</li></{around}></div>'
    docs = [(f"s{k}", "html", page(k)) for k in range(12)]
    site = site_lines.sites(spark.createDataFrame([(d[0], "https://a.example/", "x") for d in docs], "slug string, source_url string, ingested_at string"))
    out = {r.key: r.text for r in style_tree.cleaned(spark.createDataFrame(docs, "slug string, kind string, content string"), "slug", "kind", "content", site).collect()}
    assert out == {f"s{k}": f"- {SIDE if k == 5 else f'Item {k} that no other page has'}" for k in range(12)}


def test_a_branch_of_low_importance_goes_whole(spark):
    # The number of the page is unique, but it is a small part of a branch that every page has.
    chrome = "".join(f"<p>Link number {n} of the footer of all the pages</p>" for n in range(20))
    docs = [(f"s{k}", "html", f"<p>Only in manual {k} of them all, number {k * k}</p><footer><div>{chrome}</div><h3>Footer heading of all pages</h3><p>v {k}</p></footer>") for k in range(12)]
    site = site_lines.sites(spark.createDataFrame([(d[0], "https://a.example/", "x") for d in docs], "slug string, source_url string, ingested_at string"))
    out = {r.key: r.text for r in style_tree.cleaned(spark.createDataFrame(docs, "slug string, kind string, content string"), "slug", "kind", "content", site).collect()}
    assert out == {f"s{k}": f"Only in manual {k} of them all, number {k * k}" for k in range(12)}


def test_structure_survives():
    html = "<ul><li>a<ul><li>b <code>x_y_z</code></li></ul></li><li>c\ngoes on</li></ul><table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>2</td></tr></table><p>a | b</p>"
    assert [b for *_, b in blocks("html", html)] == ["- a", "  - b `x_y_z`", "- c goes on", "| h | i |", "| --- | --- |", "| 1 | 2 |", "a | b"]
    md = "1. x\n   goes on\n   - y `a_b_c` *e*\n     - z\n2. w\n\n| h |\n|:--|\n| 1 |"
    assert [b for *_, b in blocks("markdown", md)][:4] == ["1. x goes on", "  - y `a_b_c` e", "    - z", "2. w"]
    wiki = "{|\n! p !! q\n|-\n| 1 || 2\n|}"
    assert [b for *_, b in blocks("pdf", wiki)] == ["| p | q |", "| --- | --- |", "| 1 | 2 |"]


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "slug string, kind string, content string, key int, text int, site int, leaf int, gone int")
    site = site_lines.sites(spark.createDataFrame([], "slug string, source_url string, ingested_at string"))
    assert style_tree.cleaned(docs, "slug", "kind", "content", site).count() == 0
    assert residue_table.residues(docs, "slug", "kind", "content").count() == 0


SUM = "+".join(f"x_{{{k}}}" for k in range(1000))
LONG = [
    ("markdown", f"a ${SUM}$ b", {"latex"}), ("pdf", f"a \\({SUM}\\) b", {"latex"}), ("html", f"\\[{SUM}\\]", {"latex"}), ("pdf", f"$${SUM}$$", {"latex"}), ("pdf", f"\\[ a \\\\[2pt] {SUM} \\]", {"latex"}),
    ("markdown", "{{Infobox device\n| name = " + "a " * 3000 + "\n}}", {"wiki"}), ("pdf", "word " * 60 + "\n=====\ntext", {"markdown"}),
]


@pytest.mark.parametrize("kind, text, markups", LONG)
def test_residue_of_any_length(kind, text, markups):
    assert set(count_constructs(kind, text)) == markups


FRACTIONS = " + ".join(rf"\frac{{a_{k}}}{{b_{k}}}" for k in range(300))


@pytest.mark.parametrize("sign, text", [
    ("$$", f"$${FRACTIONS}$$"), ("$", f"${FRACTIONS}$"), ("$$", f"\\[{FRACTIONS}\\]"), ("$", f"\\({FRACTIONS}\\)"), ("$$", f"\\begin{{equation}}\n{FRACTIONS}\n\\end{{equation}}"),
    ("$$", f"\\begin{{align*}}{FRACTIONS}\\end{{align*}}"), ("$$", "$$\n" + FRACTIONS.replace(" + ", "\n+ ") + "\n$$"),
])
def test_formulas_of_any_length_are_kept(sign, text):
    (*_, block), = blocks("pdf", text)
    assert block.replace(f"{sign} ", sign).replace(f" {sign}", sign) == f"{sign}{FRACTIONS}{sign}"
    assert len(style_tree._IS_FORMULA.findall(block)) == 1


def test_long_templates_and_headings_are_converted():
    assert blocks("pdf", "{{Box\n| name = " + "a " * 3000 + "\n}}") == [(("li",), ("li",), "- name : " + "a " * 2999 + "a")]
    assert blocks("pdf", "word " * 60 + "\n=====\n\ntext")[0] == (("h",), ("h",), "# " + "word " * 59 + "word")


def test_no_formula_reaches_over_code():
    for a, b in (("$$", "$$"), ("\\[", "\\]"), ("\\begin{equation}", "\\end{equation}")):
        assert (("code",), ("code",), "```\nx\n  y\n```") in blocks("markdown", f"a {a} b\n\n```\nx\n  y\n```\n\nc {b} d")


@pytest.mark.parametrize("sign", ["\\begin{align} ", "\\[ ", "\\( ", "$$ ", "$a ", "{{a ", "{{a\n|", "\\\\[ ", "a\n"])
def test_unclosed_constructs_take_linear_time(sign):
    count_constructs("pdf", sign * 200_000)
    blocks("pdf", sign * 200_000)
