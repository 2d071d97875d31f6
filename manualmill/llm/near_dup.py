"""Problem 1: near-duplicate records, by Order MinHash.

A text is the set of its occurrence-labelled word runs (k-mers).  A sketch
takes the few k-mers that are smallest under one hash function and keeps them
in the order they have in the text, so that two texts agree in a sketch only if
they share those k-mers *and* their order.  A third of the sketches see every
occurrence in text order.  The others see only the first occurrence of each k-mer
(so that mere repetition cannot hide a pair), in the text order inside blocks whose
own order is made canonical (so that moved pages or sections cannot).  Texts that
agree in several sketches are candidates; a candidate is verified by the exact share of
common runs and described by a banded alignment of its word sequences.

Plan: one narrow pass makes (sketch, text hash) rows of 16 bytes, in which exact copies fall together; candidates come from a self equi-join of these
rows on the sketch value (AQE splits skewed values); only the texts of
candidates are read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import checkpointed, small_batches
from .words import chunks, hash_words, mix, runs


@dataclass(frozen=True)
class OrderMinHash:
    """Parameters.

    Texts of similarity s whose order is kept agree in a sketch with probability s^length, so at 0.6 in 27 of 128
    sketches on average and in 15 if moved blocks cost the rest; texts of similarity 0.05, as boilerplate makes them, in
    0.01.  With agree = 2 a pair of 0.6 that differs by scattered edits is lost with a probability of about 1 in 100,000 by
    this formula; lines of a dozen words in another order break the blocks as well, and about 1 in 1,000 such pairs may be
    lost.  Texts that merely share boilerplate, whose number grows as the square of the corpus, hardly ever become candidates.
    """

    run: int = 4
    sketches: int = 128
    in_text_order: int = 32
    length: int = 3
    #: Sketches in which two texts must agree to become candidates.
    agree: int = 2
    similarity: float = 0.6
    least_words: int = 20
    #: Half width of the alignment band: this share of the longer text, within these bounds, in words.
    band_share: float = 0.2
    band: tuple[int, int] = (64, 2048)
    #: Candidate ids and shared sketch values up to this number are broadcast (at most 40 bytes each), more are shuffled.
    broadcast_ids: int = 400_000


def _occurrences(x: np.ndarray) -> np.ndarray:
    """For each position, how often its value occurred before."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    seen = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
    out = np.empty(len(x), np.int64)
    out[order] = seen
    return out


def _hash_rows(x: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    low = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    with np.errstate(over="ignore"):
        return (low[None, :] ^ seeds[:, :1]) * seeds[:, 1:]


def _block_order(kmers: np.ndarray) -> np.ndarray:
    """Rank of each position when the blocks of a text are put in an order that depends on their contents only.

    Blocks begin at k-mers with a hash divisible by 16 and are sorted by it; inside a block the text order holds.
    """
    begins = (kmers & np.uint64(15)) == 0
    begins[0] = True
    block = np.cumsum(begins) - 1
    rank = np.empty(len(kmers), np.int64)
    rank[np.lexsort((np.arange(len(kmers)), kmers[begins][block]))] = np.arange(len(kmers))
    return rank


def sketch(kmers: np.ndarray, p: OrderMinHash) -> np.ndarray:
    """One value for each sketch of a text with these k-mers (in text order); empty if it has none."""
    if not len(kmers):
        return np.zeros(0, np.uint64)
    seen = _occurrences(kmers)
    with np.errstate(over="ignore"):
        labelled = mix(kmers + seen.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    raw = mix(np.arange(1, 2 * p.sketches + 1, dtype=np.uint64)).astype(np.uint32).reshape(-1, 2)
    raw[:, 1] |= np.uint32(1)
    once = seen == 0
    families = (
        (np.arange(p.in_text_order), labelled, np.arange(len(kmers))),
        (np.arange(p.in_text_order, p.sketches), labelled[once], _block_order(kmers)[once]),
    )
    out = []
    for sketches, pick, rank in families:
        for block in np.array_split(sketches, max(1, len(pick) * len(sketches) >> 19)):
            if not len(block):
                continue
            h = _hash_rows(pick, raw[block])
            at = []
            row = np.arange(len(block))
            for _ in range(min(p.length, len(pick))):
                least = h.argmin(axis=1)
                at.append(least)
                h[row, least] = np.uint32(0xFFFFFFFF)
            at = np.stack(at, axis=1)
            chosen = pick[np.take_along_axis(at, rank[at].argsort(axis=1), axis=1)]  # their order is kept
            value = mix(block.astype(np.uint64))
            with np.errstate(over="ignore"):
                for k in range(chosen.shape[1]):
                    value = mix(value * np.uint64(31) + chosen[:, k])
            out.append(value)
    return np.concatenate(out)


def banded_lcs(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """Longest common subsequence of two sequences within a diagonal band, bit-parallel.

    Bit i of a row stands for x[base + i]; only x[i] with |i - j*len(x)/len(y)| <= band can match y[j] (at the ends of
    x the band keeps its full width).
    """
    n, m = len(x), len(y)
    if not n or not m:
        return 0
    where: dict[int, int] = {}
    for i, v in enumerate(x.tolist()):
        where[v] = where.get(v, 0) | (1 << i)
    # Only the bits of the band are kept: those below it don't change any more, those above it are still ones.
    width = min(n, 2 * band + 1)
    ones = (1 << width) - 1
    row, base, common = ones, 0, 0
    for j, v in enumerate(y.tolist()):
        step = min(max(0, j * n // m - band), n - width) - base
        if step > 0:
            common += step - (row & ((1 << step) - 1)).bit_count() if step <= width else width - row.bit_count()
            row = (row >> step) | (((1 << min(step, width)) - 1) << (width - min(step, width)))
            base += step
        match = where.get(v)
        if match is None:
            continue
        u = row & (match >> base)
        row = ((row + u) | (row - u)) & ones
    return common + width - row.bit_count()


def _sketch_batches(p: OrderMinHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("id").to_pylist()
            out_id: list = []
            values, index = [], []
            for a, b in chunks(texts):
                words, at = hash_words(texts[a:b])
                for k in range(b - a):
                    own = words[at[k] : at[k + 1]]
                    if len(own) < max(p.least_words, p.run):
                        continue
                    s = sketch(runs(own, p.run), p)
                    values.append(s)
                    index.append(np.arange(len(s), dtype=np.int32))
                    out_id += [ids[a + k]] * len(s)
            if values:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_id, pa.int64()), pa.array(np.concatenate(values).view(np.int64))], ["id", "sketch"]
                )

    return run


def _verify_batches(p: OrderMinHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            share, edit = [], []
            for x, y in zip(left, right):
                words, at = hash_words([x, y])
                u, v = words[: at[1]], words[at[1] :]
                ru, rv = np.unique(runs(u, p.run)), np.unique(runs(v, p.run))
                both = len(np.intersect1d(ru, rv, assume_unique=True))
                share.append(both / max(1, len(ru) + len(rv) - both))
                if share[-1] >= p.similarity:  # the alignment of a pair that the exact check rejects is never used
                    band = min(max(p.band[0], int(p.band_share * max(len(u), len(v)))), p.band[1])
                    edit.append(2 * banded_lcs(u, v, band) / max(1, len(u) + len(v)))
                else:
                    edit.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(share, pa.float64()), pa.array(edit, pa.float64())],
                ["a", "b", "jaccard", "alignment"],
            )

    return run


def _id(text: str) -> Column:
    """16 bytes that tell texts apart."""
    return F.unhex(F.md5(F.col(text)))


def _bounded(df: DataFrame, p: OrderMinHash) -> DataFrame:
    """df, to be broadcast if it is proved small; it must be cheap to read again."""
    return F.broadcast(df) if df.limit(p.broadcast_ids + 1).count() <= p.broadcast_ids else df


def classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id) for all rows with a text: id is the hash of the text, equal for exact copies only."""
    return (
        docs.select(F.col(key).cast("string").alias("key"), _id(text).alias("id"))
        .where("key IS NOT NULL AND id IS NOT NULL")
        .distinct()
    )


def candidates(docs: DataFrame, text: str, p: OrderMinHash) -> DataFrame:
    """(a, b), a < b: 64-bit hashes of different texts that agree in enough sketches.

    Two texts with one hash, of which there are a few among ten billion, share their candidates, which verification sorts out.
    """
    small_batches(docs.sparkSession)
    own = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("id"), F.col(text).alias("text"))
    rows = checkpointed(own.mapInArrow(_sketch_batches(p), "id long, sketch long"))
    # Values that one text alone has, nearly all, are dropped before the join.
    several = rows.groupBy("sketch").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("sketch")
    rows = checkpointed(rows.join(_bounded(checkpointed(several), p), "sketch", "left_semi").distinct())
    left, right = rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b")
    met = left.join(right, "sketch").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return met.where(F.col("n") >= p.agree).select("a", "b")


def similar_texts(docs: DataFrame, text: str, p: OrderMinHash = OrderMinHash()) -> DataFrame:
    """(a, b, jaccard, alignment) of all pairs of different texts of the wanted similarity, each once, ids as in classes().

    NULL texts and texts of fewer than least_words words are in no pair; repeated rows count once.
    """
    pairs = checkpointed(candidates(docs, text, p))
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = _bounded(wanted, p)
    texts = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("id"), _id(text).alias("whole"), F.col(text).alias("text"))
    texts = checkpointed(texts.join(wanted, "id", "left_semi").dropDuplicates(["whole"]))
    left = texts.select(F.col("id").alias("a"), F.col("whole").alias("whole_a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("whole").alias("whole_b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select(F.col("whole_a").alias("a"), F.col("whole_b").alias("b"), "text_a", "text_b")
    found = both.mapInArrow(_verify_batches(p), "a binary, b binary, jaccard double, alignment double")
    return found.where(F.col("jaccard") >= p.similarity)


def _long_enough(p: OrderMinHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keep = np.zeros(len(texts), bool)
            for a, b in chunks(texts):
                keep[a:b] = np.diff(hash_words(texts[a:b])[1]) >= p.least_words
            yield batch.select(["id"]).filter(pa.array(keep))

    return run


def near_duplicate_keys(docs: DataFrame, key: str, text: str, p: OrderMinHash = OrderMinHash()) -> DataFrame:
    """(a, b) of keys with a < b: all pairs of similar or identical contents.

    The number of rows is the number of such pairs, so a group of n copies gives n*(n-1)/2 rows;
    near_duplicate_groups() is the form without that growth.
    """
    member = checkpointed(classes(docs, key, text))
    pairs = similar_texts(docs, text, p).select("a", "b")
    left = member.select(F.col("id").alias("a"), F.col("key").alias("x"))
    right = member.select(F.col("id").alias("b"), F.col("key").alias("y"))
    near = pairs.join(left, "a").join(right, "b").select("x", "y")
    # Copies: only classes of several keys, and of these only texts that are long enough.
    several = member.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    copies = docs.where(F.col(text).isNotNull()).select(_id(text).alias("id"), F.col(text).alias("text"))
    copies = copies.join(several, "id", "left_semi").mapInArrow(_long_enough(p), "id binary").distinct()
    group = member.join(copies, "id", "left_semi")
    same = group.select("id", F.col("key").alias("x")).join(group.select("id", F.col("key").alias("y")), "id")
    same = same.where("x < y").select("x", "y")
    return near.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def near_duplicate_groups(docs: DataFrame, key: str, text: str, p: OrderMinHash = OrderMinHash()) -> DataFrame:
    """(key, class_id, group_id, links): one row per key with its class of exact copies and its group of similar texts.

    links counts the other classes that the class is similar to.  Keys of short or unlike texts are groups of their own.
    """
    member = classes(docs, key, text)
    pairs = checkpointed(similar_texts(docs, text, p).select("a", "b"))
    group = connected_components(pairs).withColumnRenamed("node", "id")
    links = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("links"))
    return (
        member.join(group, "id", "left")
        .join(links, "id", "left")
        .select(
            F.col("key"),
            F.lower(F.hex("id")).alias("class_id"),
            F.lower(F.hex(F.coalesce("component", "id"))).alias("group_id"),
            F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
        )
    )
