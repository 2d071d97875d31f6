"""Iterative operators: breadth-first crawl and chain walk over a table of links."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .ordering import numbered


#: Rows of a round up to this number are broadcast (some 200 bytes each), so that links and visited nodes stay where they
#: are; larger rounds are joined by shuffle.
BROADCAST_ROUND = 100_000
#: Rounds that are kept as tables of their own before they are written together.
ROUNDS_APART = 32


def crawl(edges: DataFrame, seeds: DataFrame, cap: int | None = None) -> DataFrame:
    """(source, node, depth, ord, truncated): what a first-in-first-out crawl of each source visits, in its order.

    edges is (source, src, dst, pos), seeds (source, node).  A node is queued once, where it is first seen; of the
    nodes found in one round the order is that of (order of the page, position of the link).  A round joins the links
    with the nodes of the round before, is written to the checkpoint folder and only appended to, so a lost
    executor costs that round and nothing is written twice but for the merging of every 32 rounds.
    A source stops at cap nodes and is then marked truncated; nothing else ends it before its last node.  NULL nodes
    are ignored, cycles end.
    """
    edges = checkpointed(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("source", "src", "dst", F.col("pos").cast("bigint").alias("pos")))
    first = seeds.where("node IS NOT NULL").groupBy("source", "node").agg(F.lit(0).cast("bigint").alias("_a"), F.lit(0).cast("bigint").alias("_b"))
    front = checkpointed(_round(first.withColumn("_base", F.lit(0).cast("bigint")), 0))
    rounds, n = [front], front.count()
    for depth in count(1):
        going = front if cap is None else front.where(F.col("ord") < cap)
        near = (F.broadcast(going) if n <= BROADCAST_ROUND else going).select("source", F.col("node").alias("src"), "ord", "_next")
        found = edges.join(near, ["source", "src"]).groupBy("source", F.col("dst").alias("node"))
        found = checkpointed(found.agg(F.min(F.struct("ord", "pos")).alias("_k"), F.max("_next").alias("_base")))
        n = found.count()
        seen = reduce(DataFrame.unionByName, [r.select("source", "node") for r in rounds])
        if n <= BROADCAST_ROUND:  # of the visited nodes only those that were found again are needed
            seen = F.broadcast(checkpointed(seen.join(F.broadcast(found.select("source", "node")), ["source", "node"], "left_semi")))
        fresh = found.join(seen, ["source", "node"], "left_anti")
        front = checkpointed(_round(fresh.select("source", "node", F.col("_k.ord").alias("_a"), F.col("_k.pos").alias("_b"), "_base"), depth))
        n = front.count()
        if not n:
            break
        rounds.append(front)
        if len(rounds) > ROUNDS_APART:
            rounds = [checkpointed(reduce(DataFrame.unionByName, rounds))]
    out = reduce(DataFrame.unionByName, rounds).select("source", "node", "depth", "ord")
    if cap is None:
        return out.withColumn("truncated", F.lit(False))
    cut = out.groupBy("source").agg((F.max("ord") >= cap).alias("truncated"))
    return out.where(F.col("ord") < cap).join(cut, "source").select("source", "node", "depth", "ord", "truncated")


def _round(rows: DataFrame, depth: int) -> DataFrame:
    """(source, node, depth, ord, _next): the nodes of one round in their order, after the _base nodes of their source."""
    rows = checkpointed(rows)
    size = rows.groupBy("source").agg((F.count("*") + F.max("_base")).alias("_next"))
    placed = numbered(rows, ["source"], ["_a", "_b", "node"], "_n").join(size, "source")
    return placed.select("source", "node", F.lit(depth).alias("depth"), (F.col("_base") + F.col("_n")).alias("ord"), "_next")


def chain(edges: DataFrame, seeds: DataFrame, cap: int, by: str = "source") -> DataFrame:
    """The rows of crawl() along links of which a page has one (the first by pos), safe on cycles.

    Pages reached and links are doubled: after n rounds the first 2^n pages of a walk are known and each link spans
    2^n pages, so the rounds are logarithmic in the walk, not one for each page.  As crawl() does, several seeds of a
    source are walked side by side, and of a page that several reach the nearest seed counts (then the smaller one).
    by: the column of edges and seeds that tells whose links they are, if many sources share them, such as their host; a
    source has one value.  Links are then kept once, not once for each source.
    """
    keys = list(dict.fromkeys(["source", by]))
    one = edges.groupBy(by, "src").agg(F.min(F.struct("pos", "dst")).alias("m")).select(by, "src", F.col("m.dst").alias("dst"))
    jump = checkpointed(one.where("src IS NOT NULL AND dst IS NOT NULL"))
    start = seeds.where("node IS NOT NULL").select(*keys, "node").distinct()
    seen = checkpointed(start.select(*keys, "node", F.struct(F.lit(0).cast("bigint").alias("depth"), F.col("node").alias("seed")).alias("_w")))
    known = seen.count()
    for n in count():
        far = seen.where(F.col("_w.depth") <= cap).withColumnRenamed("node", "src").join(jump, [by, "src"])
        far = far.select(*keys, F.col("dst").alias("node"), F.struct((F.col("_w.depth") + (1 << n)).alias("depth"), F.col("_w.seed").alias("seed")).alias("_w"))
        # A source shows no page beyond its cap; one more tells that the cap was hit.
        far = far.where(F.col("_w.depth") <= cap)
        seen = checkpointed(seen.unionByName(far).groupBy(*keys, "node").agg(F.min("_w").alias("_w")))
        now = seen.count()
        if now == known:
            break
        known = now
        further = jump.select(by, F.col("src").alias("dst"), F.col("dst").alias("_to"))
        jump = checkpointed(jump.join(further, [by, "dst"]).select(by, "src", F.col("_to").alias("dst")))
    rows = seen.select("source", "node", F.col("_w.depth").cast("int").alias("depth"), F.col("_w.seed").alias("_seed"))
    rows = numbered(rows, ["source"], ["depth", "_seed", "node"]).where(F.col("ord") <= cap)
    cut = rows.groupBy("source").agg((F.max("ord") >= cap).alias("truncated"))
    return rows.where(F.col("ord") < cap).join(cut, "source").select("source", "node", "depth", "ord", "truncated")


def chain_from_head(edges: DataFrame, seeds: DataFrame, cap: int) -> DataFrame:
    """Walk against the links to the head of the chain first, by at most cap links, then along them from there.

    A source whose head is farther away than that is truncated, too.
    """
    back = edges.select("source", F.col("dst").alias("src"), F.col("src").alias("dst"), "pos")
    walked = chain(back, seeds, cap + 1)
    ends = checkpointed(walked.groupBy("source").agg(F.max(F.struct("ord", "node")).alias("m"), F.max("truncated").alias("_cut")))
    out = chain(edges, ends.select("source", F.col("m.node").alias("node")), cap)
    return out.join(ends.select("source", "_cut"), "source").withColumn("truncated", F.col("truncated") | F.col("_cut")).drop("_cut")
