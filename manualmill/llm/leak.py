"""Problem 8: evaluation texts leaking into training text, by a positional inverted index.

The index is distributed by document: a shard holds the postings (term ->
positions) of a chunk of training texts.  For test items that fit one pass the shards are made, for the terms of the items
only, as the texts go by; for more they are stored once, with all terms, and every pass reads the postings instead of the
texts.  A test passage is looked up from its rarest
term: its positions, moved to the start of the passage, are intersected with
the moved positions of the next rarest term, and so on until none is left or all
terms agree.  As a document is whole in its shard, no posting is shuffled and no
document frequency has to be agreed on; the result does not depend on the shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, small_batches
from .words import chunks, gathered, hash_words

#: Characters of text in one shard of the index.
SHARD_CHARS = 1 << 22


@dataclass(frozen=True)
class LeakRules:
    #: Consecutive words that make a leak; an item with fewer words must be there whole.
    run: int = 12
    #: Test items searched in one pass; more are searched in further passes over the stored index.
    items_at_once: int = 20_000


@dataclass
class Passages:
    """All passages of a block of test items, one row of term numbers each."""

    vocabulary: np.ndarray  # sorted term hashes
    terms: np.ndarray  # (passages, run) numbers of terms; -1 beyond the end of a short passage
    items: list[np.ndarray]  # items that hold the passage


def passages(ids: list, texts: list[str | None], run: int) -> Passages:
    rows: dict[tuple, set] = {}
    words, at = hash_words(texts)
    vocabulary = np.unique(words)
    number = np.searchsorted(vocabulary, words)
    for k, item in enumerate(ids):
        own = number[at[k] : at[k + 1]]
        if not len(own):
            continue
        n = min(run, len(own))
        for start in range(len(own) - n + 1):
            row = tuple(own[start : start + n].tolist()) + (-1,) * (run - n)
            rows.setdefault(row, set()).add(item)
    terms = np.array(list(rows), np.int64).reshape(-1, run)
    return Passages(vocabulary, terms, [np.array(sorted(v)) for v in rows.values()])


class Postings:
    """Positional postings of one chunk of texts, for the terms of a vocabulary."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> None:
        at = np.searchsorted(vocabulary, words)
        at[at == len(vocabulary)] = 0
        known = np.flatnonzero(vocabulary[at] == words) if len(vocabulary) else np.zeros(0, np.int64)
        term = at[known]
        doc = np.searchsorted(offsets, known, side="right") - 1
        # A gap between texts keeps a passage from running over the end of a text.
        place = known + doc * 64
        order = np.argsort(term, kind="stable")
        self.positions = place[order]
        self.start = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
        self.shifted = offsets[:-1] + np.arange(len(offsets) - 1) * 64

    STORED = "docs array<string>, terms array<long>, start array<int>, positions array<int>, shifted array<int>"

    @classmethod
    def stored(cls, row: dict) -> Postings:
        """The postings of a row of a stored index."""
        self = cls.__new__(cls)
        self.start, self.positions, self.shifted = (np.asarray(row[c]) for c in ("start", "positions", "shifted"))
        return self

    def of(self, term: int) -> np.ndarray:
        return self.positions[self.start[term] : self.start[term + 1]]

    def frequency(self) -> np.ndarray:
        return np.diff(self.start)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.shifted, places, side="right") - 1

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Places where the terms stand in a row."""
        n = self.start[terms + 1] - self.start[terms]
        hits = None
        for k in np.argsort(n, kind="stable"):
            own = self.of(terms[k]) - k
            if hits is None:
                hits = own
            else:
                at = np.searchsorted(own, hits)
                at[at == len(own)] = 0
                hits = hits[own[at] == hits] if len(own) else hits[:0]
            if not len(hits):
                break
        return hits

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Places of the rarest of the terms within span positions of which every other term stands, in any order."""
        distinct = np.unique(terms)
        n = self.start[distinct + 1] - self.start[distinct]
        order = np.argsort(n, kind="stable")
        hits = self.of(distinct[order[0]])
        for k in order[1:]:
            own = self.of(distinct[k])
            if not len(own) or not len(hits):
                return hits[:0]
            at = np.searchsorted(own, hits)
            right = np.abs(own[np.minimum(at, len(own) - 1)] - hits)
            left = np.abs(own[np.maximum(at - 1, 0)] - hits)
            hits = hits[np.minimum(left, right) <= span]
        return hits


def _search(p: Passages, index: Postings, ids: list[str], span: int | None, found: dict[tuple, int]) -> None:
    """Add to found how many passages of an item stand in each text of a shard whose terms have the numbers of p."""
    real, filled = p.terms >= 0, np.where(p.terms >= 0, p.terms, p.terms[:, :1])
    # Only passages all of whose terms are in this shard can match.
    for row in np.flatnonzero((index.frequency()[filled] > 0).all(axis=1)):
        terms = p.terms[row][real[row]]
        hits = index.phrase(terms) if span is None else index.near(terms, span)
        for k in set(index.text_of(hits).tolist()):
            for item in p.items[row].tolist():
                found[ids[k], item] = found.get((ids[k], item), 0) + 1


def _found_batch(found: dict[tuple, int]) -> pa.RecordBatch:
    keys = list(found)
    columns = [pa.array([x for x, _ in keys], pa.string()), pa.array([y for _, y in keys], pa.string()), pa.array(list(found.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["doc", "item", "passages"])


FOUND = "doc string, item string, passages long"


def _text_batches(sent, span: int | None):
    """sent: the broadcast passages, some hundred bytes for each word of the items of one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in gathered(batches):
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            found: dict[tuple, int] = {}
            for a, b in chunks(texts, SHARD_CHARS):
                _search(p, Postings(*hash_words(texts[a:b]), p.vocabulary), ids[a:b], span, found)
            yield _found_batch(found)

    return run


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard, with the postings of all its terms."""
    types = [pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
    for batch in gathered(batches):
        ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
        for a, b in chunks(texts, SHARD_CHARS):
            words, offsets = hash_words(texts[a:b])
            own = np.unique(words)
            index = Postings(words, offsets, own)
            row = [ids[a:b], own.view(np.int64), index.start, index.positions, index.shifted]
            yield pa.RecordBatch.from_arrays([pa.array([x if isinstance(x, list) else x.tolist()], t) for x, t in zip(row, types)], [c.split()[0] for c in Postings.STORED.split(", ")])


def _stored_batches(sent, span: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                index, own = Postings.stored(row), np.asarray(row["terms"], np.int64).view(np.uint64)
                found: dict[tuple, int] = {}
                if len(own):
                    at = np.searchsorted(own, p.vocabulary)
                    at[at == len(own)] = 0
                    here = own[at] == p.vocabulary
                    # Passages with a term that the shard lacks can't match; the others get its numbers.
                    good = np.flatnonzero(np.where(p.terms >= 0, here[p.terms], True).all(axis=1))
                    terms = np.where(p.terms[good] >= 0, at[p.terms[good]], -1)
                    _search(Passages(own, terms, [p.items[k] for k in good]), index, row["docs"], span, found)
                yield _found_batch(found)

    return run


def leaks(
    docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, rules: LeakRules = LeakRules(), span: int | None = None
) -> DataFrame:
    """(doc, item, passages): the documents that hold a passage of an item, and how many different ones. Ids are strings.

    span None asks for the words in a row, a number for all words of a passage within that distance of its rarest
    word, in any order.  Items come to the driver in blocks of at most items_at_once, one after the other; what a block
    finds is written before the next one is sent.  NULL and empty texts match nothing; a row that is given twice counts once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    asked = items.select(F.col(item_key).cast("string").alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct()
    if asked.limit(rules.items_at_once + 1).count() <= rules.items_at_once:
        rows = asked.collect()
        p = passages([r["id"] for r in rows], [r["text"] for r in rows], rules.run)
        if not len(p.terms):
            return spark.createDataFrame([], FOUND)
        return _once(own.mapInArrow(_text_batches(spark.sparkContext.broadcast(p), span), FOUND))
    index = checkpointed(own.mapInArrow(_index_batches, Postings.STORED))
    parts, block = [], []

    def search() -> None:
        p = passages([r["id"] for r in block], [r["text"] for r in block], rules.run)
        if len(p.terms):
            sent = spark.sparkContext.broadcast(p)
            parts.append(checkpointed(_once(index.mapInArrow(_stored_batches(sent, span), FOUND))))
            sent.destroy()
        block.clear()

    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) >= rules.items_at_once:
            search()
    search()
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FOUND)


def _once(found: DataFrame) -> DataFrame:
    return found.groupBy("doc", "item").agg(F.max("passages").alias("passages"))
