import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from manualmill.llm.words import TAG, hash_words, runs


def plain(text):
    return re.findall(r"[^\W_]+", TAG.sub(" ", text).lower())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abAB1 <>/!_-.éÉßİжЖ語\n", max_size=60), max_size=6))
def test_same_words_as_a_regular_expression(texts):
    hashes, at = hash_words(texts)
    seen = {}
    for k, text in enumerate(texts):
        want = plain(text)
        got = hashes[at[k] : at[k + 1]]
        assert len(got) == len(want)
        for w, h in zip(want, got.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_nulls_empty_and_long_words():
    hashes, at = hash_words([None, "", "x" * 5000, "x" * 5001, "x" * 5000])
    assert at.tolist() == [0, 0, 0, 1, 2, 3]
    assert hashes[0] == hashes[2] != hashes[1]


def test_runs_are_by_position():
    words, _ = hash_words(["a b a b a"])
    r = runs(words, 2)
    assert len(r) == 4 and r[0] == r[2] and r[1] == r[3] and r[0] != r[1]
    assert len(runs(words, 6)) == 0 and runs(words, 5).dtype == np.uint64
