import random

from manualmill.llm import repetition
from manualmill.llm.repetition import label_model


def rows():
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    out = [(f"f{k}", fresh(80)) for k in range(30)]
    out += [(f"r{k}", (fresh(10) + ". ") * 12) for k in range(6)]
    return [*out, ("few", "one two three four"), ("five", "a b c d e"), ("null", None), ("empty", ""), (None, "a b c d e"), out[0]]


def brute(text, n=5):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    r = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
    return bool(r) and (len(r) - len(set(r))) / len(r) >= 0.25


def test_cases_are_those_of_brute_force(spark):
    data = rows()
    got = repetition.judged(spark.createDataFrame(data, "slug string, content string"), "slug", "content").collect()
    assert {r.key for r in got if r.is_case} == {k for k, t in data if k and t and brute(t)} and len(got) == 39
    by = {r.key: r for r in got}
    assert all(r.is_candidate for r in got if r.is_case) and not by["f1"].is_candidate
    assert by["r1"].posterior > 0.9 and by["f1"].posterior < 0.1 and by["few"].run_share is None


def test_exactly_a_quarter_is_a_case(spark):
    words = "a b c d e".split() + ["x1", "x2", "x3"] + "a b c d e".split()  # 9 runs, 1 again
    text = " ".join(words)
    got = repetition.judged(spark.createDataFrame([("k", text)], "slug string, content string"), "slug", "content").first()
    assert (got.runs, got.repeated_runs, got.is_case) == (9, 1, False)
    rules = repetition.RepetitionRules(share=1 / 9)
    assert repetition.judged(spark.createDataFrame([("k", text)], "slug string, content string"), "slug", "content", rules).first().is_case


def test_label_model_learns_a_bad_rule():
    # Rules 0 and 1 agree, rule 2 votes at random.
    patterns = [((1, 1, 1), 50), ((1, 1, 0), 50), ((0, 0, 1), 400), ((0, 0, 0), 400), ((-1, -1, -1), 10), ((-1, -1, 1), 5)]
    post = label_model(patterns)
    assert post[1, 1, 0] > 0.9 and post[0, 0, 1] < 0.1 and 0 < post[-1, -1, -1] < 0.5
    assert label_model([]) == {}


def test_empty_table_and_clashing_columns(spark):
    schema = "slug string, content string, key int, runs int, posterior int, vote_0 int"
    assert repetition.judged(spark.createDataFrame([], schema), "slug", "content").count() == 0
    long = "many words " * 300_000
    got = repetition.judged(spark.createDataFrame([("k", long, 1, 1, 1, 1)], schema), "slug", "content").first()
    assert got.is_case and got.runs == 599_996
