"""Problem 5: oversized items cut at natural boundaries.

A recursive hierarchy of separators (section, paragraph, sentence, word,
character) turns a text into atoms that fit the room of a piece; a coarser
separator is kept wherever its parts fit.  Atoms are packed greedily up to the
limit; a full piece is cut at the last of its coarsest boundaries in its second half, and
every piece but the first begins with the last bytes of the piece
before it.  Sizes and positions are bytes of UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches

LEVELS = ("section", "paragraph", "sentence", "word", "character")

# What ends (look-behind) or begins (look-ahead) a part, by kind and level, on bytes.
_SECTION = {
    "markdown": rb"\n\r?\n---\r?\n\r?\n|\n(?=#{1,6} )",
    "html": rb"</section>\s*|\n?(?=<section\b)|\n?(?=<h[1-6]\b)",
    "pdf": rb"\x0c",
}
_PARAGRAPH = {
    "markdown": rb"\n[ \t\r]*\n\s*",
    "html": rb"</(?:p|ul|ol|table|pre|div|blockquote|footer)>\s*|\n[ \t\r]*\n\s*",
    "pdf": rb"\n[ \t\r]*\n\s*",
}
_SENTENCE = rb"[.!?](?:[\"')\]]|\xe2\x80\x9d|</[a-z]+>)*\s+|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)|\r?\n"
_WORD = rb"\s+"


def _patterns(kind: str | None) -> list[re.Pattern]:
    kind = kind if kind in _SECTION else "markdown"
    return [re.compile(x) for x in (_SECTION[kind], _PARAGRAPH[kind], _SENTENCE, _WORD)]


def _char_start(data: bytes, at: int) -> int:
    """The last start of a character at or before at."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _atoms(data: bytes, start: int, end: int, level: int, room: int, patterns: list[re.Pattern]) -> Iterator[tuple[int, int]]:
    """(end, level) of the atoms of data[start:end], each of at most room bytes."""
    if end - start <= room:
        yield end, level
        return
    if level >= len(patterns):
        while end - start > room:
            cut = _char_start(data, start + room)
            cut = cut if cut > start else start + room
            yield cut, level
            start = cut
        yield end, level
        return
    last = start
    for m in patterns[level].finditer(data, start, end):
        cut = m.end()
        if last < cut < end:
            yield from _part(data, last, cut, level, room, patterns)
            last = cut
    yield from _part(data, last, end, level, room, patterns)


def _part(data: bytes, start: int, end: int, level: int, room: int, patterns: list[re.Pattern]) -> Iterator[tuple[int, int]]:
    if end - start <= room:
        yield end, level
        return
    inner = end
    for inner, deeper in _atoms(data, start, end, level + 1, room, patterns):
        yield inner, deeper if inner < end else level


def pieces(text: str, kind: str | None, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start, own_start, end, boundary) of the pieces of a text, in bytes of its UTF-8 form.

    A piece is bytes start to end; own_start is where it goes beyond the piece before it; boundary says
    at what kind of place it ends.  The overlap is the wanted one, or up to three bytes less where it would
    cut a character.  A text within the limit is one piece.  Pieces always end between characters, unless
    limit - overlap is smaller than a character.
    """
    data = text.encode("utf-8", "surrogatepass")
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap smaller")
    if len(data) <= limit:
        return [(0, 0, len(data), "end")]
    out: list[tuple[int, int, int, str]] = []
    begin = own = 0
    held: list[tuple[int, int]] = []  # (end, level) of the atoms of the piece that is open
    for end, level in _atoms(data, 0, len(data), 0, limit - overlap, _patterns(kind)):
        while held and end - begin > limit:
            full = [(lv, -e) for e, lv in held if 2 * (e - begin) >= limit]
            lv, cut = min(full) if full else (held[-1][1], -held[-1][0])
            out.append((begin, own, -cut, LEVELS[min(lv, 4)]))
            own = -cut
            begin = own - overlap
            while begin < own and data[begin] & 0xC0 == 0x80:
                begin += 1
            held = [x for x in held if x[0] > own]
        held.append((end, level))
    out.append((begin, own, len(data), "end"))
    return out


SCHEMA = "key string, kind string, piece_no int, pieces int, start_byte long, own_start long, end_byte long, bytes long, boundary string, piece string"


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "kind", "piece_no", "pieces", "start_byte", "own_start", "end_byte", "bytes", "boundary", "piece"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for key, kind, text, limit, overlap in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "text", "limit", "overlap"))):
            data = text.encode("utf-8", "surrogatepass")
            cut = pieces(text, kind, limit, overlap)
            for n, (start, own, end, boundary) in enumerate(cut, 1):
                part = data[start:end].decode("utf-8", "replace")
                rows.append((key, kind, n, len(cut), start, own, end, end - start, boundary, part))
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def split_oversized(docs: DataFrame, limits: DataFrame, key: str, kind: str, text: str) -> DataFrame:
    """The pieces of every text above the limit of its kind, one row each (SCHEMA).

    limits is (kind, max_bytes, overlap_bytes), a handful of rows.  Texts within their limit, NULL texts and kinds
    without a limit give no rows; a row that is given twice gives its pieces once; of two limits of a kind the
    smaller holds.
    """
    small_batches(docs.sparkSession)
    bound = limits.where("kind IS NOT NULL AND max_bytes > 0").groupBy("kind").agg(
        F.min(F.struct("max_bytes", F.coalesce("overlap_bytes", F.lit(0)).alias("o"))).alias("m")
    )
    bound = bound.select(F.col("kind"), F.col("m.max_bytes").alias("limit"), F.least(F.col("m.o"), F.col("m.max_bytes") - 1).alias("overlap"))
    if bound.limit(10_001).count() <= 10_000:
        bound = F.broadcast(bound)
    own = docs.select(F.col(key).cast("string").alias("key"), F.col(kind).alias("kind"), F.col(text).alias("text"))
    large = own.where("text IS NOT NULL").join(bound, "kind").where(F.octet_length("text") > F.col("limit"))
    return large.dropDuplicates(["key", "kind", "text"]).mapInArrow(_split_batches, SCHEMA)
