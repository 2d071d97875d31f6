import random
import re

from manualmill.llm import leak
from manualmill.llm.leak import LeakRules
from manualmill.llm.words import TAG


def words(t):
    return re.findall(r"[^\W_]+", TAG.sub(" ", t or "").lower())


def brute(docs, items, n=12):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            k = min(n, len(v))
            if d is not None and i is not None and k and {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}:
                out.add((str(d), str(i)))
    return out


def data():
    rng = random.Random(9)
    line = lambda n: [f"v{rng.randrange(30)}" for _ in range(n)]
    items = [(k, " ".join(line(20))) for k in range(12)] + [(20, "Only Five-Short words here"), (21, ""), (22, None), (23, "..."), (24, "one")]
    items.append((30, items[0][1] + " and more"))  # quotes another
    docs = []
    for k in range(60):
        v = words(items[k % 12][1])
        cut = rng.randrange(8, 20)
        docs.append((k, " ".join(line(30)) + " <b>" + ",  ".join(v[:cut]).upper() + "</b> " + " ".join(line(10))))
    docs += [(100, "x only five SHORT words<br>here y"), (101, None), (102, ""), (103, "x five short words"), (104, "One"), (0, docs[0][1]), (None, docs[0][1])]
    # The end of one text and the beginning of the next make no passage.
    v = words(items[1][1])
    return [*docs, (200, " ".join(v[:6])), (201, " ".join(v[6:]))], items


def test_same_as_brute_force(spark):
    docs, items = data()
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(2), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    got = {(r.doc, r.item) for r in leak.leaks(d, i, "doc_id", "text", "item_id", "text").collect()}
    assert got == want and ("100", "20") in want and len(want) > 20
    blocks = {(r.doc, r.item) for r in leak.leaks(d, i, "doc_id", "text", "item_id", "text", LeakRules(items_at_once=3)).collect()}
    assert blocks == want
    near = [{(r.doc, r.item) for r in leak.leaks(d, i, "doc_id", "text", "item_id", "text", rules, span=14).collect()} for rules in (LeakRules(), LeakRules(items_at_once=3))]
    assert near[0] == near[1] >= want


def test_near_finds_other_orders(spark):
    docs = spark.createDataFrame([(1, "c x b y a"), (2, "c " + "z " * 30 + "b a"), (3, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    got = {(r.doc, r.item) for r in leak.leaks(docs, items, "doc_id", "text", "item_id", "text", span=5).collect()}
    assert got == {("1", "1")}


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, id int, item int, doc int, passages int")
    items = spark.createDataFrame([(1, "a b", 1)], "item_id bigint, text string, id int")
    assert leak.leaks(docs, items, "doc_id", "text", "item_id", "text").count() == 0
    one = spark.createDataFrame([(1, "x a b " + "long " * 500_000, 1, 1, 1, 1)], docs.schema)
    assert leak.leaks(one, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert leak.leaks(one, items, "doc_id", "text", "item_id", "text").count() == 1
