import random

import numpy as np
import pytest

from manualmill.llm import near_dup
from manualmill.llm.near_dup import OrderMinHash, banded_lcs, sketch
from manualmill.llm.words import hash_words, runs


def text(rng, n):
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


def jaccard(x, y):
    (a, b), k = [hash_words([t])[0] for t in (x, y)], 4
    a, b = set(runs(a, k).tolist()), set(runs(b, k).tolist())
    return len(a & b) / max(1, len(a | b))


def corpus():
    rng = random.Random(5)
    docs = {}
    for k in range(40):
        words = text(rng, 120 + rng.randrange(200)).split()
        docs[f"s{k:02}"] = " ".join(words)
        edited = [w if rng.random() > 0.04 else "x" for w in words]
        docs[f"t{k:02}"] = " ".join(edited)
        # Moved blocks, last block first.
        docs[f"u{k:02}"] = " ".join(w for i in reversed(range(0, len(words), 30)) for w in words[i : i + 30])
        docs[f"v{k:02}"] = " ".join(words + words[:60] * 3)  # the same again and again
    docs["copy"] = docs["s00"]
    docs["short"], docs["short2"] = "only a few words", "only a few words"
    return docs


def test_pairs_are_those_of_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(k, v) for k, v in docs.items()], "slug string, content string")
    got = {tuple(r) for r in near_dup.near_duplicate_keys(frame, "slug", "content").collect()}
    names = sorted(k for k in docs if len(docs[k].split()) >= 20)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if jaccard(docs[a], docs[b]) >= 0.6}
    assert got == want and ("copy", "s00") in got and len(want) > 60


def test_groups_keep_every_key_once(spark):
    docs = corpus()
    rows = [(k, v) for k, v in docs.items()] * 2
    got = near_dup.near_duplicate_groups(spark.createDataFrame(rows, "slug string, content string"), "slug", "content").collect()
    assert sorted(r.key for r in got) == sorted(docs)
    by = {r.key: r for r in got}
    assert by["copy"].class_id == by["s00"].class_id and by["s00"].group_id == by["t00"].group_id
    assert by["s00"].group_id != by["s01"].group_id and by["short"].links == 0


def test_nulls_empty_tables_and_clashing_columns(spark):
    schema = "slug string, content string, id int, text string, key string, a int, b int, sketch string"
    none = spark.createDataFrame([], schema)
    assert near_dup.near_duplicate_keys(none, "slug", "content").count() == 0
    assert near_dup.near_duplicate_groups(none, "slug", "content").count() == 0
    long = "lorem ipsum dolor " * 30_000 + " ".join(f"n{k}" for k in range(40_000))
    rows = [("a", long, 1, "t", "k", 1, 1, "s"), ("b", long + " end", 1, None, None, None, None, None), ("c", None, *[None] * 6), (None, long, *[None] * 6), ("d", "", *[None] * 6)]
    got = near_dup.near_duplicate_keys(spark.createDataFrame(rows, schema), "slug", "content").collect()
    assert [tuple(r) for r in got] == [("a", "b")]


def test_sketch_keeps_text_order():
    kmers = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    p = OrderMinHash(sketches=32, in_text_order=32)
    assert (sketch(kmers, p) == sketch(kmers, p)).all()
    assert (sketch(kmers, p) != sketch(kmers[::-1].copy(), p)).all()
    assert len(sketch(kmers[:0], p)) == 0 and len(sketch(kmers[:1], p)) == 32


@pytest.mark.parametrize("seed", range(20))
def test_banded_alignment_is_the_common_subsequence(seed):
    rng = random.Random(seed)
    x, y = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
    assert banded_lcs(np.array(x), np.array(y), 100) == table[-1][-1]
    assert banded_lcs(np.array(x), np.array(y), 2) <= table[-1][-1]
    assert banded_lcs(np.array(x), np.array(x), 1) == len(x)
    # Any band: what a table with only the cells of the band gives.
    n, m, band = len(x), len(y), 3
    width = min(n, 2 * band + 1)
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for j in range(m):
        low = min(max(0, j * n // m - band), n - width)
        for i in range(n):
            same = x[i] == y[j] and low <= i < low + width
            table[i + 1][j + 1] = table[i][j] + 1 if same else max(table[i][j + 1], table[i + 1][j])
    assert banded_lcs(np.array(x), np.array(y), band) == table[-1][-1]
