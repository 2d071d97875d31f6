"""Vectorised word streams.

The words of a text are its longest runs of letters and digits after every
tag became a space and the text was put in lower case.  A whole chunk of texts
is turned into one code point array, so that splitting, lower-casing and
hashing are a fixed number of array passes and no Python object is made for
a word.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

TAG = re.compile(r"<[A-Za-z/!][^<>]*>")
#: Characters handled in one pass; bounds the memory of the arrays below.
CHUNK_CHARS = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); bijective."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += _GOLDEN
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter or digit, its one-character lower case, its random value."""
    top = sys.maxunicode + 1
    alnum = np.zeros(top, bool)
    lower = np.arange(top, dtype=np.uint32)
    for start in range(0, top, 0x1000):
        block = [chr(c) for c in range(start, start + 0x1000)]
        alnum[start : start + 0x1000] = [c.isalnum() for c in block]
        low = [c.lower() for c in block]
        lower[start : start + 0x1000] = [ord(n) if len(n) == 1 else ord(c) for n, c in zip(low, block)]
    return alnum, lower, mix(np.arange(top, dtype=np.uint64))


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(256, 0xD6E8FEB86659FD93, np.uint64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def strip_tags(text: str) -> str:
    return TAG.sub(" ", text) if "<" in text else text


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most limit characters together (a longer text stands alone)."""
    start = total = 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if k > start and total + n > limit:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 4096, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in larger ones, of at most so many rows and about so many bytes (a longer row stands alone)."""
    held: list[pa.RecordBatch] = []
    count = total = 0
    for batch in batches:
        if held and (count + batch.num_rows > rows or total + batch.nbytes > size):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count, total = [], 0, 0
        if batch.num_rows:
            held.append(batch)
            count, total = count + batch.num_rows, total + batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def hash_words(texts: list[str | None], tags: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and for each text where its words begin (one more at the end).

    NULL is an empty text.  Words of any length are hashed whole.
    """
    alnum, lower, value = _tables()
    powers = _powers()
    clean = [(strip_tags(t) if tags else t) if t else "" for t in texts]
    special = "İ"  # the one letter whose lower case is two characters
    clean = [t.replace(special, "i̇") if special in t else t for t in clean]
    lengths = np.fromiter((len(t) + 1 for t in clean), np.int64, len(clean))
    cp = code_points("\n".join(clean) + "\n")
    ok = alnum[cp]
    edge = np.flatnonzero(np.diff(ok.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    offsets = np.searchsorted(starts, bounds).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    inside = np.flatnonzero(ok)
    length = ends - starts
    first = np.cumsum(length) - length
    at = np.arange(len(inside)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        part = value[lower[cp[inside]]] * powers[at & 255] + (at >> 8).astype(np.uint64) * _GOLDEN
        hashed = np.add.reduceat(part, first)
    return mix(hashed), offsets


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words, by position; empty when there are fewer than n words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:count].copy()
        for k in range(1, n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + count]
    return mix(out)
