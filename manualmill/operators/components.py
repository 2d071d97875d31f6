"""Connected components without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links; the component is its smallest node.

    Alternating large-star and small-star steps: each round replaces the links
    of a node by links to its smallest neighbour, which converges in a number of
    rounds logarithmic in the longest path.  A node's neighbours are reduced by
    min() with map-side combine, never gathered in one task.  Every round is
    written to the shared checkpoint folder, so lost executors cost one round.

    Links with a NULL end are ignored; self links make a node of its own;
    an empty table gives an empty one.
    """
    raw = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = raw.select(F.col("u").alias("node")).union(raw.select(F.col("v"))).distinct()
    edges = raw.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = checkpointed(edges)
    state = None
    for _ in range(rounds):
        # Large star: neighbours above a node move to the smallest of its closed neighbourhood.
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: neighbours below a node, and the node, move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(edges.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )
