"""Evaluation passages inside a corpus: every document that holds one, whole or in part, and which.

Method: q-gram lemma filtering. A stretch of ``m`` characters that two texts share with at most ``k`` edits leaves at
least m + 1 - q (k + 1) common q-grams whose positions differ by nearly the same amount. The q-grams of the corpus are
looked up in an index of the passages' q-grams, hits are counted in overlapping bands of diagonals (position in the
document minus position in the passage), and bands that reach the bound are cut into regions and verified by banded
alignment: +1 for an equal character, -(q + 1) for an edit, and a region is kept if some local alignment scores at least
m - k (q + 1). ``m`` is the length of the shortest stretch of ``words`` words of the passage, so that any such
stretch meets bound and score. Both texts are compared as words in lower case (runs of letters and digits) with one space
between, so layout and punctuation don't matter.

``q`` is each passage's own: the largest of 16, 8, 4 and 2 (halved down from the one asked for) with which its shortest stretch
leaves a bound of at least one. Passages of one q share an index, so what a passage finds never depends on which
others it is searched with.

The passages, a stated set, are indexed in blocks of bounded size, and all documents are scanned once per block; nothing is
shuffled.

Defined results: null or short passages (under ``words`` words) cannot be held by a document; null texts hold nothing;
repeated documents and repeated passages are each reported under their own id; texts of any length are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
BLOCK_CHARS = 1_000_000  # characters of passages in one index, which every task holds
BATCH_CHARS = 2_000_000
TABLE_BITS = 22
_MUL = np.uint64(0x9E3779B97F4A7C15)
FIELDS = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("run", pa.int32())])
REGIONS = "doc bigint, item bigint, start bigint, stop bigint, score double, run int"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every stretch of q characters, by doubling."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    width = 1
    out, done = None, 0
    level = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    rest = q
    while rest:
        if rest & 1:
            part = level[done : done + n]
            out = part.copy() if out is None else out * _power(width) + part
            done += width
        rest >>= 1
        if rest:
            level = level[:-width] * _power(width) + level[width:]
            width *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_MUL), n, 1 << 64))


def own_q(m: int, edits: int, q: int) -> int:
    """The largest q, halved from the one asked for, whose grams no ``edits`` edits of a stretch of m characters can all hit."""
    while q > 2 and m + 1 - q * (edits + 1) < 1:
        q //= 2
    return q


class Index:
    """The q-grams of a block of passages of one q, sorted by hash."""

    def __init__(self, items: list[tuple[int, list[str], int]], least_words: int, edits: int, q: int):
        self.q, self.edits, self.least_words = q, edits, least_words
        self.ids, self.words, self.m = [i for i, _, _ in items], [w for _, w, _ in items], [m for _, _, m in items]
        self.texts = [" ".join(w) for w in self.words]
        self.codes = [_codes(t) for t in self.texts]
        grams = [_grams(c, self.q) for c in self.codes]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.grams, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.item, self.pos = item[order].astype(np.int64), pos[order].astype(np.int64)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.grams >> np.uint64(64 - TABLE_BITS)] = True
        self.bound = np.array([max(1, x + 1 - self.q * (edits + 1)) for x in self.m], np.int64)
        w = least_words
        self.runs = [{" ".join(x[i : i + w]) for i in range(len(x) - w + 1)} for x in self.words]

    @staticmethod
    def of(passages: list[tuple[int, str]], least_words: int, edits: int, q: int) -> list[Index]:
        """One index for each q that occurs; passages of fewer words than ``least_words`` are left out."""
        by_q: dict[int, list] = {}
        for i, passage in passages:
            w = words(passage)
            if len(w) >= least_words:
                ends = np.cumsum([len(x) + 1 for x in w])
                m = int((ends[least_words - 1 :] - np.concatenate(([0], ends[:-least_words])) - 1).min())
                by_q.setdefault(own_q(m, edits, q), []).append((i, w, m))
        return [Index(items, least_words, edits, k) for k, items in sorted(by_q.items())]

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in the corpus, item, position in the passage) of every common q-gram."""
        at = np.flatnonzero(self.table[grams >> np.uint64(64 - TABLE_BITS)])
        if not len(at) or not len(self.grams):
            z = np.zeros(0, np.int64)
            return z, z, z
        k = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[k] == grams[at]
        at, k = at[same], k[same]
        n = self.first[k + 1] - self.first[k]
        to = np.repeat(self.first[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[to], self.pos[to]


def align(doc: np.ndarray, passage: np.ndarray, low: int, high: int, cost: int) -> tuple[int, int, int]:
    """(score, start, stop) of the best local alignment whose diagonals (place in doc minus place in passage) lie in
    [low, high]; the place is that of doc."""
    width = high - low + 1
    score, begin = [0] * (width + 2), [0] * (width + 2)
    best = (0, 0, 0)
    n = len(doc)
    doc, passage = doc.tolist(), passage.tolist()
    for i, c in enumerate(passage):
        left, left_begin = 0, i + low
        for b in range(1, width + 1):
            j = i + low + b - 1
            if j < 0 or j >= n:
                score[b], left = 0, 0
                continue
            s, o = score[b], begin[b]
            if s <= 0:
                s, o = 0, j
            s = s + 1 if doc[j] == c else s - cost
            if score[b + 1] - cost > s:  # the passage has one more
                s, o = score[b + 1] - cost, begin[b + 1]
            if left - cost > s:  # the document has one more
                s, o = left - cost, left_begin
            if s < 0:
                s = 0
            score[b], begin[b] = s, o
            left, left_begin = s, o
            if s > best[0]:
                best = (s, o, j + 1)
    return best


def _longest_run(doc: list[str], index: Index, item: int) -> int:
    """The most consecutive words of the passage in the document, from ``least_words`` up; 0 if fewer."""
    w, runs = index.least_words, index.runs[item]
    best = now = 0
    for i in range(len(doc) - w + 1):
        now = now + 1 if " ".join(doc[i : i + w]) in runs else 0
        best = max(best, now)
    return best + w - 1 if best else 0


def scan(batches: Iterator[pa.RecordBatch], indexes: list[Index]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int | None, list[str]]] = []
    size = 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text:
                held.append((doc, words(text)))
                size += len(text)
            if size >= BATCH_CHARS:
                yield from (_scan(held, index) for index in indexes)
                held, size = [], 0
    yield from (_scan(held, index) for index in indexes)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIELDS)], schema=FIELDS)


def _scan(docs: list[tuple[int | None, list[str]]], index: Index) -> pa.RecordBatch:
    texts = [" ".join(w) for _, w in docs]
    if not texts or not index.ids:
        return _batch([])
    codes = _codes("\n".join(texts))
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    at, item, pos = index.hits(_grams(codes, index.q))
    if not len(at):
        return _batch([])
    doc = np.searchsorted(starts, at, side="right") - 1
    diagonal = at - starts[doc] - pos
    reach = 2 * (index.edits + 1)  # a stretch with up to k edits lies within k diagonals, so within one of two shifted bands
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    for shift in (0, reach // 2):
        band = (diagonal + shift) // reach
        key = np.stack([doc, item, band], axis=1)
        order = np.lexsort((at, band, item, doc))
        key, p, g = key[order], at[order], diagonal[order]
        gap = np.ones(len(key), bool)
        gap[1:] = (key[1:] != key[:-1]).any(axis=1) | (p[1:] - p[:-1] > index.q * (index.edits + 1))
        first = np.flatnonzero(gap)
        n = np.diff(np.append(first, len(key)))
        for r in np.flatnonzero(n >= index.bound[key[first, 1]]):
            d, i, _ = (int(x) for x in key[first[r]])
            if n[r] < found.get((d, i), (0, 0, 0))[0] - index.q:
                continue
            lo, hi = first[r], first[r] + n[r]
            start = int(p[lo] - starts[d])
            stop = int(p[hi - 1] - starts[d]) + index.q
            d_low, d_high = int(g[lo:hi].min()), int(g[lo:hi].max())
            p_low = max(0, start - d_high)
            p_high = min(len(index.codes[i]), stop - d_low)
            part = codes[starts[d] + start : starts[d] + stop]
            if d_low == d_high:  # one diagonal: the longest run without edits scores best or nearly so
                score, a, z = _diagonal(part, index.codes[i][p_low:p_high], index.q + 1)
            else:
                score, a, z = align(part, index.codes[i][p_low:p_high], d_low + p_low - start, d_high + p_low - start, index.q + 1)
            if score >= index.m[i] - index.edits * (index.q + 1) and score > found.get((d, i), (0, 0, 0))[0]:
                found[d, i] = (score, start + a, start + z)
    rows = [(docs[d][0], index.ids[i], a, z, float(s), _longest_run(docs[d][1], index, i)) for (d, i), (s, a, z) in found.items()]
    return _batch(rows)


def _diagonal(doc: np.ndarray, passage: np.ndarray, cost: int) -> tuple[int, int, int]:
    """The best local alignment on one diagonal (the band is one wide)."""
    n = min(len(doc), len(passage))
    step = np.where(doc[:n] == passage[:n], 1, -cost)
    total = np.concatenate(([0], np.cumsum(step)))
    low = np.minimum.accumulate(total)
    z = int(np.argmax(total - low))
    a = int(np.flatnonzero(total[: z + 1] == low[z])[-1])
    return int(total[z] - low[z]), a, z


def regions(
    docs: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str,
    least_words: int = 13, edits: int = 2, q: int = 16,
) -> DataFrame:
    """(doc, item, start, stop, score, run): the best region of each document and passage that meets the budget;
    start and stop in the normalized document, run the longest stretch of common words (0 if under ``least_words``)."""
    spark = docs.sparkSession
    corpus = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where("text is not null")
    known = items.select(F.col(item).cast("bigint"), F.col(passage)).where(F.col(passage).isNotNull())
    out, block, size = None, [], 0

    def one(block: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(Index.of(block, least_words, edits, q))  # bounded by BLOCK_CHARS
        return corpus.mapInArrow(lambda it: scan(it, sent.value), REGIONS)

    for i, p in known.toLocalIterator():
        block.append((i, p))
        size += len(p)
        if size >= BLOCK_CHARS:
            part = one(block)
            out, block, size = part if out is None else out.unionByName(part), [], 0
    if block or out is None:
        part = one(block)
        out = part if out is None else out.unionByName(part)
    return out
