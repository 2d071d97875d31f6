from manualmill.llm import split
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from manualmill.llm.split import pieces, split_oversized


def check(text, kind, limit, overlap):
    data = text.encode()
    out = pieces(text, kind, limit, overlap)
    assert out[0][0] == out[0][1] == 0 and out[-1][2] == len(data)
    for (start, own, end, _), before in zip(out, [None, *out]):
        assert end - start <= limit and (end > own or len(data) == 0)
        if before:
            assert own == before[2] and overlap - 3 <= own - start <= overlap
        if limit - overlap >= 4:
            data[start:end].decode()
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n#é語😀-<p>/\f", max_size=400), st.sampled_from(["markdown", "html", "pdf", None]), st.integers(8, 60), st.integers(0, 4))
def test_pieces_give_the_whole_text(text, kind, limit, overlap):
    check(text, kind, limit, overlap)


def test_boundaries_are_the_coarsest_that_fit():
    text = "# A\n" + "One sentence. " * 10 + "\n# B\n" + "x" * 30 + "\n\n" + "word " * 40
    out = check(text, "markdown", 160, 10)
    assert out[0][3] == "section"
    assert [b for *_, b in check("word " * 40, "markdown", 50, 5)][0] == "word"
    assert [b for *_, b in check("x" * 300, "markdown", 50, 5)][0] == "character"
    assert [b for *_, b in check("One two. " * 30, "pdf", 60, 5)][0] == "sentence"
    assert pieces("", "pdf", 10, 0) == [(0, 0, 0, "end")]


@pytest.mark.parametrize("limit, overlap", [(0, 0), (5, 5), (5, -1)])
def test_bad_limits(limit, overlap):
    with pytest.raises(ValueError):
        pieces("text", "pdf", limit, overlap)


def test_table(spark):
    limits = spark.createDataFrame([("pdf", 50, 5), ("pdf", 60, 5), ("html", 10_000_000, 0), (None, 1, 0), ("markdown", None, None)], "kind string, max_bytes int, overlap_bytes int")
    rows = [("a", "pdf", "é" * 40, 1), ("a", "pdf", "é" * 40, 1), ("b", "pdf", "x" * 50, 1), ("c", "pdf", None, 1), ("d", None, "x" * 99, 1), ("e", "html", "x" * 99, 1), ("f", "markdown", "x" * 99, 1), (None, "pdf", "y" * 99, 1)]
    docs = spark.createDataFrame(rows, "slug string, kind string, content string, limit int")
    got = split_oversized(docs, limits, "slug", "kind", "content").collect()
    assert {r.key for r in got} == {"a", None} and sorted(r.piece_no for r in got if r.key == "a") == [1, 2]
    whole = sorted((r.own_start, r.piece.encode()[r.own_start - r.start_byte :]) for r in got if r.key == "a")
    assert b"".join(p for _, p in whole).decode() == "é" * 40 and all(r.bytes <= 50 for r in got)
    empty = spark.createDataFrame([], "slug string, kind string, content string, limit int")
    assert split_oversized(empty, limits, "slug", "kind", "content").count() == 0
    assert split_oversized(docs, limits.limit(0), "slug", "kind", "content").count() == 0


def test_a_very_long_text():
    check("Sentence number one. " * 200_000, "markdown", 12_000, 400)
    check("x" * 3_000_000, "html", 16_000, 600)


def test_a_section_end_goes_before_a_sentence():
    text = "## A\n\n" + "Short one. " * 12 + "\n## B\n\n" + "Another sentence here. " * 40
    cut = split.pieces(text, "markdown", 220, 20)
    assert cut[0][3] == "section" and text[: cut[0][2]].endswith("\n") and "## B" not in text[: cut[0][2]]
    assert all(e - a <= 220 for a, _, e, _ in cut) and cut[-1][2] == len(text) and all(x[2] == y[1] for x, y in zip(cut, cut[1:]))
