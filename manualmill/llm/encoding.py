"""Problem 9: text that was decoded with a wrong character encoding.

Characters are mapped back to the bytes they stand for in a legacy encoding.
On these bytes an automaton for the structure of UTF-8 finds the maximal
well-formed multibyte spans, and only those spans are decoded; this is repeated
while it helps, for text decoded wrongly twice.  Text that was in one
single-byte encoding and read as another has no byte structure to recognise, so
there the mapped-back bytes are decoded with the other encoding word by word.

Either repair is accepted only if it makes the text more usual: the pairs of
neighbouring characters with a character beyond ASCII are counted over all
documents, and the repaired text must be likelier by these counts.  So correct
unusual characters stay as they are.

A character may be written as a numeric or named character reference; references
to characters beyond ASCII are read as their characters everywhere, and a repair
replaces the references it covers and no others.

Plan: two narrow passes over the texts and no shuffle of texts.  The counts are
pre-aggregated by chunk; their number is bounded by the alphabet (CLASSES squared)
whatever the size of the corpus.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches
from .words import chunks, code_points, gathered

LOST = 0xFFFD
# Encodings that UTF-8 is read as by mistake, and pairs (true, read as) of single-byte encodings.
READ_AS = ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "latin-1", "iso8859-2", "cp1254", "cp866", "koi8-r", "cp852")
SINGLE_BYTE = (
    ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1250", "cp850"), ("cp1250", "cp852"), ("cp1250", "cp1252"), ("cp1250", "cp437"), ("cp1252", "cp1250"),
    ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp852", "cp1250"), ("cp852", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"),
    ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8-r", "cp1252"),
    ("cp866", "cp1252"), ("cp1251", "mac_roman"), ("cp1251", "cp850"), ("cp1251", "cp437"), ("cp1252", "cp1251"), ("cp1250", "cp1251"), ("iso8859-2", "cp1252"),
    ("iso8859-2", "cp1250"), ("cp1250", "iso8859-2"), ("koi8-r", "cp866"), ("cp866", "koi8-r"),
)
#: Maximal spans of well-formed multibyte sequences of UTF-8 (no overlong forms, no surrogates).
AUTOMATON = re.compile(
    rb"(?:[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    rb"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})+"
)


@dataclass(frozen=True)
class EncodingRules:
    #: By how much (natural logarithm) a repair must be likelier: a multibyte span, for which each byte after the first
    #: of a character adds byte_gain, as it is unlikely to be well-formed by chance; a line's words; one word.
    span_gain: float = 1.0
    byte_gain: float = 1.5
    #: Characters in a row that no chance makes well-formed.
    sure_chars: int = 5
    line_gain: float = 5.0
    word_gain: float = 5.0
    rounds: int = 3


def _ranges() -> list[tuple[int, int]]:
    return [(0x80, 0x250), (0x2B0, 0x300), (0x370, 0x530), (0x2000, 0x20D0), (0x2100, 0x2300), (0x2500, 0x2600), (0xFFF0, 0x10000)]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: its own for the alphabets in question, one for a block of others; ASCII is merged."""
    out = (np.arange(0x110000) >> 8) % 61
    n = 61
    for c in range(128):
        ch = chr(c)
        out[c] = n + (ord(ch) - 97 if ch.islower() else 26 if ch.isupper() else 27 if ch.isdigit() else 28 if ch.isspace() else 29 + c)
    n += 29 + 128
    for a, b in _ranges():
        out[a:b] = n + np.arange(b - a)
        n += b - a
    return out.astype(np.int32)


CLASSES = 61 + 29 + 128 + sum(b - a for a, b in _ranges())


def _byte_char(encoding: str, b: int) -> str:
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)  # what decoders do with bytes that have no character


@lru_cache(maxsize=None)
def byte_of(encoding: str) -> np.ndarray:
    """By code point, the byte that reads as it in the encoding; 0 if none does."""
    out = np.zeros(0x110000, np.uint8)
    for b in range(1, 256):
        out[ord(_byte_char(encoding, b))] = b
    return out


@lru_cache(maxsize=None)
def reread(true: str, seen: str) -> np.ndarray:
    """By code point, what it was before a text in encoding true was read as seen; 0 if it can't come from that."""
    table = np.array([ord(_byte_char(true, b)) if b else 0 for b in range(256)], np.uint32)
    return table[byte_of(seen)]


@dataclass
class Usual:
    """How usual pairs of neighbouring characters are: the logarithm of their share, less the corpus mean of it."""

    codes: np.ndarray
    counts: np.ndarray

    def table(self) -> np.ndarray:
        if getattr(self, "_table", None) is None:
            total = max(1.0, float(self.counts.sum()))
            t = np.full(CLASSES * CLASSES, np.log(0.5 / total), np.float32)
            t[self.codes] = np.log((self.counts + 0.5) / total)
            self._mean = float((t[self.codes] * self.counts).sum() / total)
            self._table = t - np.float32(self._mean)  # above 0: more usual than the usual pair
            self.unseen = float(np.log(0.5 / total) - self._mean)
        return self._table

    def known(self, cp: np.ndarray) -> bool:
        """Did at least half of the pairs occur?"""
        value = self.pairs(cp)[(cp[:-1] > 127) | (cp[1:] > 127)]
        return 2 * int((value > self.unseen + 0.1).sum()) >= len(value)

    def __getstate__(self) -> dict:
        return {"codes": self.codes, "counts": self.counts}

    def pairs(self, cp: np.ndarray) -> np.ndarray:
        """One value for each neighbouring pair of the array; 0 for two characters of ASCII."""
        k = classes()[cp]
        out = self.table()[k[:-1].astype(np.int64) * CLASSES + k[1:]]
        return np.where((cp[:-1] > 127) | (cp[1:] > 127), out, np.float32(0))


def pair_codes(cp: np.ndarray) -> np.ndarray:
    k = classes()[cp].astype(np.int64)
    return (k[:-1] * CLASSES + k[1:])[(cp[:-1] > 127) | (cp[1:] > 127)]


#: A character reference, also one whose & was escaped again.
_REFERENCE = re.compile(r"&(?:amp;)*(?:#0*([0-9]{1,7})(?![0-9]);?|#[xX]0*([0-9A-Fa-f]{1,6})(?![0-9A-Fa-f]);?|([A-Za-z][A-Za-z0-9]*;?)(?!=))")


def _referred(m: re.Match) -> int:
    """The code point a reference stands for; 0 if it is none, or in ASCII, or no single character."""
    if m.group(3):
        c = html5.get(m.group(3), "")
        return ord(c) if len(c) == 1 and c > "\x7f" else 0
    n = int(m.group(1)) if m.group(1) else int(m.group(2), 16)
    return n if 0x80 <= n < 0xD800 or 0xE000 <= n < 0x110000 else 0


class Read:
    """A text with its references to characters beyond ASCII read as these characters, and where they were.

    A reference to a control character is that character in seen, as it may be a byte; in meant it is what HTML takes
    it for.  Both have the same length.
    """

    def __init__(self, text: str) -> None:
        self.at: list[int] = []  # places of the references in seen
        self.more = [0]  # by how many characters the first n of them were longer
        self.seen = self.meant = text
        found = [(m, c) for m in _REFERENCE.finditer(text) if (c := _referred(m))] if "&" in text else []
        if not found:
            return
        parts, last = [], 0
        for m, c in found:
            parts += [text[last : m.start()], chr(c)]
            last = m.end()
            self.at.append(m.start() - self.more[-1])
            self.more.append(self.more[-1] + m.end() - m.start() - 1)
        parts.append(text[last:])
        self.seen = self.meant = "".join(parts)
        if any(c < 0xA0 for _, c in found):
            parts[1::2] = [_byte_char("cp1252", c) if c < 0xA0 else chr(c) for _, c in found]
            self.meant = "".join(parts)

    def place(self, at: int) -> int:
        """Where in the text a place in seen is."""
        return at + self.more[bisect_left(self.at, at)]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches):
        texts = [Read(t).meant for t in batch.column("text").to_pylist() if "&" in t or not t.isascii()]
        texts = [t for t in texts if not t.isascii()]
        for a, b in chunks(texts):
            codes, counts = np.unique(pair_codes(code_points(" " + " \n ".join(texts[a:b]) + " ")), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], ["code", "n"])


def usual_pairs(docs: DataFrame, text: str) -> Usual:
    """The counts over all documents; at most CLASSES squared numbers (in practice some ten thousand) come to the driver."""
    small_batches(docs.sparkSession)
    own = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    rows = own.mapInArrow(_count_batches, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    return Usual(rows["code"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def telling(cp: np.ndarray) -> np.ndarray:
    """Is a character beyond ASCII and no typographic mark?  Marks alone are no sign of a wrong reading."""
    return (cp > 127) & ~((cp >= 0x2010) & (cp <= 0x2044)) & (cp != 0x2122)


#: A word: no white space of ASCII inside, some character beyond ASCII.  It is only tried where a word begins, so that
#: a long word without such a character is read once.
_WORD = re.compile(r"(?<![^\x09-\x0d\x20])[^\x09-\x0d\x20\x80-\U0010ffff]*[^\x00-\x7f][^\x09-\x0d\x20]*")


def _decodings(cp: np.ndarray, a: int, b: int, goods: set[str], usual: Usual, rounds: int) -> tuple[float, str]:
    """The likeliest text that cp[a:b] may be a wrong reading of, and how usual it is; decoded up to rounds times."""
    best = None
    for good in goods:
        inner = code_points(good)
        value = float(usual.pairs(np.concatenate((cp[a - 1 : a], inner, cp[b : b + 1]))).sum())
        if best is None or value > best[0]:
            best = (value, good)
        if rounds > 1:
            again = {
                m.group(0).decode("utf-8") for e in READ_AS for m in [AUTOMATON.fullmatch(byte_of(e)[inner].tobytes())] if m
            }
            if again:
                best = max(best, _decodings(cp, a, b, again, usual, rounds - 1))
    return best


class Words:
    """What the distinct words of some texts may be wrong readings of.  Words stand between spaces in one array."""

    def __init__(self, words: list[str], meant: list[str], usual: Usual, rules: EncodingRules) -> None:
        self.words, self.meant, self.usual, self.rules = words, meant, usual, rules
        self.cp = code_points(" " + "".join(w + "  " for w in words))
        size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        self.first = np.cumsum(size) - size
        self.size = size
        self.usual.table()
        self.spans = self._spans()
        self.gain, self.sure, self.tables = self._gains()

    def _spans(self) -> dict[int, tuple[list[tuple[int, int, str]], float]]:
        """Spans (start, end, text) and gain, of the words with a wrongly read multibyte span."""
        cp, usual, rules = self.cp, self.usual, self.rules
        spans: dict[tuple[int, int], set[str]] = {}
        for encoding in READ_AS:
            for m in AUTOMATON.finditer(byte_of(encoding)[cp].tobytes()):
                spans.setdefault(m.span(), set()).add(m.group(0).decode("utf-8"))
        now = np.concatenate(([0.0], np.cumsum(usual.pairs(cp), dtype=np.float64)))
        found: dict[int, list] = {}
        for (a, b), goods in spans.items():
            value, good = _decodings(cp, a, b, goods, usual, rules.rounds)
            bytes_after_first = len(good.encode()) - len(good)
            gain = value - float(now[b] - now[a - 1]) + rules.byte_gain * bytes_after_first
            # A few bytes may be well-formed by chance: then what they give must occur elsewhere.
            sure = len(good) >= rules.sure_chars or usual.known(np.concatenate((cp[a - 1 : a], code_points(good), cp[b : b + 1])))
            if gain >= rules.span_gain and sure and telling(cp[a:b]).any():
                word = int(np.searchsorted(self.first, a, side="right")) - 1
                found.setdefault(word, []).append((gain, a - int(self.first[word]) - 1, b - int(self.first[word]) - 1, good))
        out = {}
        for word, options in found.items():
            taken: list[tuple[int, int, str]] = []
            for _, a, b, good in sorted(options, key=lambda x: (-x[0], x[1])):
                if all(b <= c or a >= d for c, d, _ in taken):
                    taken.append((a, b, good))
            out[word] = (sorted(taken), sum(g for g, a, b, x in options if (a, b, x) in taken))
        return out

    def _gains(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """For each table of SINGLE_BYTE (row) and word: how much likelier the re-read word is; the same without unsure words."""
        own, first, usual = code_points(" " + "".join(w + "  " for w in self.meant)).copy(), self.first, self.usual
        # A no-break space between ASCII characters is one.
        joint = (own[1:-1] == 0xA0) & (own[:-2] < 128) & (own[2:] < 128)
        own[1:-1][joint] = 32
        pairs = lambda x: np.add.reduceat(np.append(usual.pairs(x), np.float32(0)), first)
        now = pairs(own)
        gain = np.zeros((len(SINGLE_BYTE), len(first)), np.float32)
        tables = []
        for k, (true, seen) in enumerate(SINGLE_BYTE):
            new = reread(true, seen)[own]
            new[own < 128] = own[own < 128]
            whole = np.minimum.reduceat(new, first) > 0
            new = np.where(new > 0, new, own)
            gain[k] = np.where(whole, pairs(new) - now, -20.0)
            tables.append(new)
        # A word of one character says too little: it follows its line.
        tells = (self.size > 3) & (np.add.reduceat(telling(own), first) > 0)
        return gain, np.where(tells, gain, 0), tables

    def reread(self, word: int, table: int) -> list[tuple[int, int, str]]:
        """The characters (start, end, text) of the word that the table changes."""
        a = int(self.first[word]) + 1
        b = a + len(self.words[word])
        new = self.tables[table][a:b]
        old = code_points(self.meant[word])
        return [(k, k + 1, chr(new[k])) for k in np.flatnonzero((new != old) & (new != 32)).tolist()]


def restore_all(texts: list[str], usual: Usual, rules: EncodingRules = EncodingRules()) -> list[tuple[str, int, int, int]]:
    """For each text (repaired text, spans decoded, words re-read, characters lost)."""
    number: dict[tuple[str, str], int] = {}
    reads: list[Read] = []
    places: list[list[tuple[int, int]]] = []  # by text: start, word
    lines: list[np.ndarray] = []
    base = 0
    for text in texts:
        own = []
        read = Read(text)
        if not read.seen.isascii():
            for m in _WORD.finditer(read.seen):
                own.append((m.start(), number.setdefault((m.group(0), read.meant[m.start() : m.end()]), len(number))))
        reads.append(read)
        places.append(own)
        ends = np.flatnonzero(code_points(read.seen) == 10) if own else np.zeros(0, int)
        lines.append(base + np.searchsorted(ends, [a for a, _ in own]))
        base += len(ends) + 1
    if not number:
        return [(t, 0, 0, 0) for t in texts]
    words = Words([w for w, _ in number], [m for _, m in number], usual, rules)
    line = np.concatenate(lines).astype(np.int64)
    which = np.array([w for own in places for _, w in own], np.int64)
    by_span = np.full(len(number), -1.0)
    for w, (_, g) in words.spans.items():
        by_span[w] = g
    _, line = np.unique(line, return_inverse=True)
    by_line = np.stack([np.bincount(line, g[which]) for g in words.sure])
    choice = by_line.argmax(axis=0)
    enough = by_line.max(axis=0) >= rules.line_gain
    single = words.sure.argmax(axis=0)
    alone = words.sure.max(axis=0) >= rules.word_gain
    table = np.where(enough[line] & (words.gain[choice[line], which] > 0), choice[line], np.where(alone[which], single[which], -1))
    # Of two explanations of a word the better one holds.
    other = np.where(table >= 0, words.gain[np.maximum(table, 0), which], -np.inf)
    table[(by_span[which] >= 0) & (by_span[which] >= other)] = -1
    out, at = [], 0
    for text, read, own in zip(texts, reads, places):
        spans = reread = 0
        parts, last = [], 0
        for k, (a, w) in enumerate(own, at):
            new = []
            if table[k] >= 0:
                new = words.reread(w, int(table[k]))
                reread += 1
            elif w in words.spans:
                new = words.spans[w][0]
                spans += len(new)
            for x, y, good in new:
                parts += [text[last : read.place(a + x)], good]
                last = read.place(a + y)
        at += len(own)
        out.append(("".join([*parts, text[last:]]) if parts else text, spans, reread, read.seen.count(chr(LOST)) if own else 0))
    return out


def restore(text: str, usual: Usual, rules: EncodingRules = EncodingRules()) -> tuple[str, int, int, int]:
    """restore_all() of one text."""
    return restore_all([text], usual, rules)[0]


SCHEMA = "key string, spans long, words long, lost long, text string"


def _restore_batches(usual, rules: EncodingRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = usual.value
        for batch in gathered(batches):
            keys, texts, rows = batch.column("key").to_pylist(), batch.column("text").to_pylist(), []
            for a, b in chunks(texts, 1 << 22):
                rows += [(key, *r[1:], r[0]) for key, r in zip(keys[a:b], restore_all(texts[a:b], table, rules)) if any(r[1:])]
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "spans", "words", "lost", "text"])

    return run


def garbled(docs: DataFrame, key: str, text: str, rules: EncodingRules = EncodingRules()) -> DataFrame:
    """(key, spans, words, lost, text) of every garbled document: what was repaired, what is lost, and the repaired text.

    Lost characters (U+FFFD) can't be restored and stay.  NULL, empty and correct texts have no row; a row given twice
    counts once.
    """
    usual = docs.sparkSession.sparkContext.broadcast(usual_pairs(docs, text))
    own = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    return own.mapInArrow(_restore_batches(usual, rules), SCHEMA).dropDuplicates(["key", "text"])
