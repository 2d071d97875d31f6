"""Problem 7: filling containers of fixed capacity, by sum-of-squares packing.

The sum-of-squares rule keeps, for every fill level, the number of open
containers at that level and puts the next item where the sum of the squares of
these numbers grows least, which keeps the levels evenly stocked so that
complements exist for later items.

Plan: a text is reduced to its size in the JVM, so only (id, size) is shuffled,
in 30 bytes or less a document.  Documents are dealt by a hash into shards of bounded size, each
packed on its own with a level array.  What a shard leaves badly filled is packed
once more with the leftovers of other shards, so the loss does not grow with the
number of shards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


@dataclass(frozen=True)
class PackRules:
    #: Documents a shard is aimed to have, whatever the size of the input.
    shard: int = 20_000
    #: Containers filled to less than this share after the first round are emptied and packed again.
    repack_below: float = 0.97
    #: Shards whose leftovers are packed together.
    shards_together: int = 16


class LevelArray:
    """Open containers by fill level, for one capacity.

    add() is the sum-of-squares rule: with N[h] open containers at level h, putting size s into one of them changes the
    sum of squares by 2 (N[h+s] - N[h] + 1), filling one up by 1 - 2 N[h], and opening a container by 2 N[s] + 1.
    The least change wins; of equal changes the fullest level does.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def add(self, size: int) -> int:
        """Number of the container that takes the item."""
        c, n = self.capacity, self.count
        room = c - size
        best, level = (2 * int(n[size]) + 1 if size < c else 0), 0
        if room > 0:
            here = n[1 : room + 1]
            change = n[1 + size : c + 1] - here
            change += change
            change += 2
            change[-1] = 1 - 2 * here[-1]  # level room is filled up; full containers are not counted
            change[here == 0] = np.iinfo(np.int64).max
            at = room - 1 - int(change[::-1].argmin())
            if here[at] and change[at] <= best:
                level = at + 1
        if level:
            box = self.open[level].pop()
            n[level] -= 1
        else:
            box = self.made
            self.made += 1
        if level + size < c:
            n[level + size] += 1
            self.open[level + size].append(box)
        return box


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item; every size must be from 1 to capacity."""
    levels = LevelArray(capacity)
    return [levels.add(s) for s in sizes]


#: Specs of one call; each makes a row of every document.
MOST_SPECS = 1000
RESULT = "spec_id int, doc_id string, size long, part int, parts int, capacity int, container string, first_token long, tokens long, fill long"
OUT = "spec_id int, doc_id string, size long, part int, parts int, tokens long, capacity int, shard long, box long, fill long, settled boolean"


def _items(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """One row per part: whole texts, and for a text above the capacity its full parts and the rest."""
    parts = np.maximum(1, -(-pdf["size"].to_numpy() // capacity))
    at = np.repeat(np.arange(len(pdf)), parts)
    out = pdf.iloc[at].reset_index(drop=True)
    out["part"] = (np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts) + 1).astype(np.int32)
    out["parts"] = parts[at].astype(np.int32)
    out["tokens"] = np.where(out["part"] < out["parts"], capacity, out["size"] - capacity * (out["parts"] - 1))
    return out


def _first_round(rules: PackRules):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        spec, capacity = int(pdf["spec_id"].iloc[0]), int(pdf["capacity"].iloc[0])
        pdf = pdf.drop_duplicates(["doc_id"]).sort_values(["order", "doc_id"])
        items = _items(pdf, capacity)
        items["box"] = pack(items["tokens"].tolist(), capacity)
        items["fill"] = items.groupby("box")["tokens"].transform("sum")
        items["settled"] = items["fill"] >= rules.repack_below * capacity
        items["shard"] = int(key[1])
        return items[[c.split()[0] for c in OUT.split(", ")]]

    return run


def _second_round(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    pdf = pdf.sort_values(["tokens", "doc_id", "part"], ascending=[False, True, True])
    pdf["box"] = pack(pdf["tokens"].tolist(), capacity)
    pdf["fill"] = pdf.groupby("box")["tokens"].transform("sum")
    pdf["settled"] = False
    pdf["shard"] = -1 - int(key[1])
    return pdf[[c.split()[0] for c in OUT.split(", ")]]


def packed(docs: DataFrame, specs: DataFrame, key: str, text: str, rules: PackRules = PackRules()) -> DataFrame:
    """(spec_id, doc_id, size, part, parts, capacity, container, first_token, tokens, fill): where every part of every text goes.

    size is the number of UTF-8 bytes plus one end token.  Only a text above the capacity is split, into full parts and
    a rest.  A NULL text has no size and no row; an empty one has size 1.  A row that is given twice counts once, of
    different texts under one id the longest holds.  doc_id is a string.
    """
    sized = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size")
    )
    spec = specs.where("spec_id IS NOT NULL AND capacity > 0").select(F.col("spec_id").cast("int"), F.col("capacity").cast("int")).distinct()
    wanted = sorted(tuple(r) for r in spec.limit(MOST_SPECS + 1).collect())
    if len(wanted) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} specs; pack for them in parts")
    if not wanted:
        return docs.sparkSession.createDataFrame([], RESULT)
    total = docs.count()
    shards = max(1, -(-total // rules.shard))
    sized = sized.groupBy("doc_id").agg(F.max("size").alias("size")).withColumn("order", F.xxhash64("doc_id"))
    dealt = sized.withColumn("shard", F.pmod(F.shiftright("order", 7), F.lit(shards)))
    each = F.array(*[F.struct(F.lit(i).alias("spec_id"), F.lit(c).alias("capacity")) for i, c in wanted])
    dealt = dealt.select("doc_id", "size", "order", "shard", F.inline(each))
    first = dealt.groupBy("spec_id", "shard").applyInPandas(_first_round(rules), OUT)
    first = checkpointed(first)
    loose = first.where("NOT settled")
    groups = max(1, -(-shards // rules.shards_together))
    again = loose.withColumn("shard", F.pmod("shard", F.lit(groups)))
    second = again.groupBy("spec_id", "shard").applyInPandas(_second_round, OUT)
    done = first.where("settled").unionByName(second)
    return done.select(
        "spec_id",
        "doc_id",
        "size",
        "part",
        "parts",
        "capacity",
        F.concat_ws("-", "spec_id", "shard", "box").alias("container"),
        ((F.col("part") - 1) * F.col("capacity")).cast("bigint").alias("first_token"),
        "tokens",
        "fill",
    )


def used(assigned: DataFrame) -> DataFrame:
    """(spec_id, containers, tokens, used_share): how well the containers of each spec are filled."""
    box = assigned.groupBy("spec_id", "container").agg(F.sum("tokens").alias("tokens"), F.max("capacity").alias("capacity"))
    total = box.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("capacity").alias("room"))
    return total.select("spec_id", "containers", "tokens", (F.col("tokens") / F.col("room")).alias("used_share"))
