"""Benchmark decontamination by the q-gram lemma (operator 1).

A document is contaminated by a benchmark item if some stretch of its text
is within the item's edit budget, k = floor(``rate`` * length) edits of m
characters. Such a stretch keeps at least m + 1 - (k + 1) q of the item's
q-grams, and their diagonals (place in the text less place in the item) lie
within k of each other, so within one of the overlapping bands that start at
every multiple of k + 1 and are twice as wide. Shared q-grams are counted for
each band, bands that reach the bound are kept, and a banded alignment of the
item with the band's region confirms or rejects each.

Items under ``min_chars`` characters have too few q-grams to be counted: they
are looked up exactly, as whole words, through hashes of the text's word
sequences. Items from ``long_chars`` on are also searched by windows of a
third of the item, half of one apart, so that a document that quotes half of
an item word for word (or within a window's own budget) is found; shorter
items count only whole.

Texts and items are compared in lower case with each run of other characters
than letters and digits as one space, so changed case, line breaks and
punctuation cost no edits. Whole texts are scanned, batch by batch, in one
pass with no shuffle. The benchmark is split into slices of at most
``slice_chars`` characters (checked), whose index is broadcast, one after the
other; a larger benchmark takes more passes, not more memory. Places that
share a q-gram with items are counted in portions of ``PORTION``, so that a
text of a sentence that very many items share costs time, not memory.

Defined results: null or empty texts match nothing; null items and those
without a letter or digit are no evidence and are left out; repeated items
and documents match row by row; empty tables give no match; each (document
row, item) gives its best stretch: the whole item before a window, then the
fewest edits, then the first. Only the named columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import Hashes

Q = 8
RATE = 0.08
MIN_CHARS = 24
LONG_CHARS = 240
SLICE_CHARS = 2_000_000
#: Pairs of places counted at once.
PORTION = 4_000_000
#: Bands before a text's begin have negative numbers.
BIAS = 1 << 30

MATCH = [T.StructField(n, T.LongType()) for n in ("item_id", "start", "stop", "edits", "matched")]


@lru_cache(maxsize=1)
def _characters() -> np.ndarray:
    """For every code point: its lower-case form, or a space if it is no
    letter or digit."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def compared(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in compared form, each ended by a 0; for each character its
    place in its own text; and for each text its first and last place + 1."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum(lengths + 1) - 1                 # places of the closing 0s
    x = _characters()[raw]
    x[ends] = 0
    space = x == 32
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = ~(space[1:] & (space[:-1] | (x[:-1] == 0)))   # runs and leading spaces
    if len(x):
        keep[0] = not space[0]
    at = np.flatnonzero(keep)
    x = x[at]
    closing = np.searchsorted(at, ends)
    first = np.concatenate([[0], closing[:-1] + 1]) if len(ends) else closing
    starts = ends - lengths
    place = at - np.repeat(starts, closing + 1 - first)
    return x, place, first, closing


def grams(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q = 8 characters from every place on."""
    h = x.astype(np.uint64) + np.uint64(1)
    for width, m in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        if len(h) <= width:
            return np.zeros(0, dtype=np.uint64)
        h = h[:-width] * np.uint64(m) + h[width:]
        h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """One slice of the benchmark: patterns (items and windows of long ones)
    with their q-grams, and the short items by their number of words."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int, long_chars: int = LONG_CHARS):
        x, _, first, closing = compared([t for _, t in items])
        self.ids: list[int] = []
        #: (number of the item, characters, budget, least q-grams, whole)
        self.items: list[tuple] = []
        self.short: dict[int, dict[bytes, list[int]]] = {}
        hashes, owner, place = [], [], []
        for (ident, _), a, b in zip(items, first, closing):
            while b > a and x[b - 1] == 32:
                b -= 1
            m = int(b - a)
            if not m:
                continue
            number = len(self.ids)
            self.ids.append(ident)
            if m < max(min_chars, Q):
                words = int((x[a:b] == 32).sum()) + 1
                self.short.setdefault(words, {}).setdefault(x[a:b].tobytes(), []).append(number)
                continue
            spans = [(a, b)]
            if m >= long_chars:
                width = -(-m // 3)
                spans += [(i, i + width) for i in (*range(a, b - width, width // 2), b - width)]
            for i, j in spans:
                # no larger than leaves two q-grams to be counted
                k = max(0, min(int(rate * (j - i)), (j - i - 1) // Q - 1))
                g = grams(x[i:j])
                hashes.append(g)
                owner.append(np.full(len(g), len(self.items)))
                place.append(np.arange(len(g)))
                self.items.append((number, x[i:j].copy(), k, j - i + 1 - (k + 1) * Q, j - i == m))
        cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        h, o, p = cat(hashes, np.uint64), cat(owner, np.int64), cat(place, np.int64)
        order = np.argsort(h, kind="stable")
        self.hashes, counts = np.unique(h, return_counts=True)
        self.offsets = np.concatenate([[0], np.cumsum(counts)])
        self.owner, self.place = o[order], p[order]
        self.budget = np.array([i[2] for i in self.items], dtype=np.int64)
        self.least = np.array([i[3] for i in self.items], dtype=np.int64)
        self.length = np.array([len(i[1]) for i in self.items], dtype=np.int64)
        # the short items' hashes, by their number of words
        self.short_hashes = {n: np.sort(np.array([_sequence_hash(k) for k in by], dtype=np.uint64))
                             for n, by in self.short.items()}

    def bitmap(self) -> np.ndarray:
        bits = np.zeros(1 << self.BITS, dtype=bool)
        bits[self.hashes >> np.uint64(64 - self.BITS)] = True
        return bits


def _sequence_hash(raw: bytes) -> int:
    x = np.frombuffer(raw, dtype=np.uint32)
    return int(Hashes(x).of(np.array([0]), np.array([len(x)]))[0])


def align(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Least edits of the item against any stretch of ``text`` whose
    alignment stays on diagonals low..high, and the first end of such."""
    m, n, width = len(item), len(text), high - low + 1
    far = m + 1
    step = np.arange(width)
    padded = np.full(n + m + 2 * width + abs(low) + abs(high) + 4, 0xFFFFFFFF, dtype=np.uint32)
    shift = width + abs(low) + 1
    padded[shift:shift + n] = text
    at = step + low
    row = np.where((at >= 0) & (at <= n), 0, far)
    for i in range(1, m + 1):
        col = at + i                                   # the text's length used so far
        new = row + (padded[shift + low + i - 1:shift + low + i - 1 + width] != item[i - 1])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where((col >= 0) & (col <= n), new, far)
        row = np.minimum(np.minimum.accumulate(new - step) + step, far)
        row = np.where((col >= 0) & (col <= n), row, far)
    best = int(row.argmin())
    return int(row[best]), best + low + m


def _exact(index: Index, x: np.ndarray, closing: np.ndarray):
    """(text number, item number, start, stop) of the short items, whole words
    each."""
    letter = (x != 32) & (x != 0)
    if not letter.any():
        return
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(closing, starts)
    hashes = Hashes(x)
    for words, by in index.short.items():
        if len(starts) < words:
            continue
        a, z = starts[:len(starts) - words + 1], stops[words - 1:]
        same = np.flatnonzero(doc[:len(a)] == doc[words - 1:])
        wanted, h = index.short_hashes[words], hashes.of(a[same], z[same])
        at = np.searchsorted(wanted, h)
        at[at == len(wanted)] = 0
        for i in same[wanted[at] == h].tolist():
            for item in by.get(x[a[i]:z[i]].tobytes(), ()):
                yield int(doc[i]), item, int(a[i]), int(z[i])


def _strong(index: Index, hit: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The (pattern, band) that share enough q-grams, as pattern << 40 | band
    + BIAS. Places come in order, so that a band behind them can't gain more."""
    n = index.offsets[at + 1] - index.offsets[at]
    ends = np.cumsum(n)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    strong = [keys]
    start = 0
    while start < len(hit):
        # at least one place, at most PORTION pairs
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PORTION, "right")))
        m = n[start:stop]
        total = int(m.sum())
        entry = np.arange(total) - np.repeat(np.cumsum(m) - m, m) + np.repeat(index.offsets[at[start:stop]], m)
        item = index.owner[entry]
        band = (np.repeat(hit[start:stop], m) - index.place[entry]) // (index.budget[item] + 1)
        new, more = np.unique(np.concatenate([(item << 40) + band + BIAS, (item << 40) + band + BIAS - 1]),
                              return_counts=True)
        keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([counts, more]), minlength=len(keys)).astype(np.int64)
        item = keys >> 40
        done = counts >= index.least[item]
        strong.append(keys[done])
        if stop < len(hit):
            reach = ((keys & ((1 << 40) - 1)) - BIAS + 2) * (index.budget[item] + 1) + index.length[item]
            keep = reach >= hit[stop]
            keys, counts = keys[keep], counts[keep]
        start = stop
    return np.unique(np.concatenate(strong))


def scan(index: Index, bits: np.ndarray, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
    """(text number, item number, start, stop, edits, matched characters) of
    every match."""
    x, place, first, closing = compared(texts)
    best: dict[tuple[int, int], tuple] = {}

    def offer(doc, item, whole, edits, start, stop):
        found = (not whole, edits, start, stop)
        if found < best.get((doc, item), (True, 1 << 62)):
            best[doc, item] = found

    if index.short:
        for doc, item, start, stop in _exact(index, x, closing):
            offer(doc, item, True, 0, start, stop)
    g = grams(x)
    hit = np.flatnonzero(bits[g >> np.uint64(64 - Index.BITS)])
    if len(hit) and len(index.hashes):
        at = np.searchsorted(index.hashes, g[hit])
        at[at == len(index.hashes)] = 0
        same = index.hashes[at] == g[hit]
        keys = _strong(index, hit[same], at[same])
    else:
        keys = np.zeros(0, np.int64)
    for i, b in zip((keys >> 40).tolist(), ((keys & ((1 << 40) - 1)) - BIAS).tolist()):
        item, pattern, k, _, whole = index.items[i]
        m = len(pattern)
        lowest, highest = b * (k + 1), (b + 2) * (k + 1) - 1
        middle = min(max((lowest + highest + m) // 2, 0), len(x) - 1)
        doc = int(np.searchsorted(closing, middle))
        for d in {doc, min(int(np.searchsorted(closing, max(lowest, 0))), len(closing) - 1)}:
            a = max(lowest - k, int(first[d]))
            z = min(highest + m + k, int(closing[d]))
            if z - a < m - k:
                continue
            known = best.get((d, item))
            if known and known[:2] <= (not whole, 0) and known[2] <= a:
                continue
            exact = x[a:z].tobytes().find(pattern.tobytes())
            if exact >= 0 and exact % 4 == 0:      # no edits: no need to align
                offer(d, item, whole, 0, a + exact // 4, a + exact // 4 + m)
                continue
            edits, stop = align(pattern, x[a:z], lowest - k - a, highest + k - a)
            if edits <= k:
                _, back = align(pattern[::-1], x[a:a + stop][::-1], 0 - k, k)
                offer(d, item, whole, edits, a + stop - back, a + stop)
    return [(d, i, int(place[a]), int(place[z - 1]) + 1, e, z - a) for (d, i), (_, e, a, z) in sorted(best.items())]


def _slices(items: DataFrame, slice_chars: int) -> int:
    """How many hash slices keep each within the bound (or at one item)."""
    total = items.agg(F.sum("chars").alias("c"), F.count("*").alias("n")).first()
    if not total.n:
        return 0
    n = max(1, -(-(total.c or 0) // slice_chars))
    while True:
        got = (items.groupBy(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("s"))
               .agg(F.sum("chars").alias("c"), F.count("*").alias("n"))
               .where((F.col("c") > slice_chars) & (F.col("n") > 1)).limit(1).count())
        if not got or n >= 4 * total.n:
            return n
        n *= 2


def _indexes(benchmark: DataFrame, item_col: str, item_text_col: str, rate: float, min_chars: int,
             slice_chars: int):
    """One index for each slice (at most slice_chars characters, or one item),
    broadcast: the driver keeps no more than one."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"),
                             F.length(item_text_col).alias("chars")).where("text is not null")
    n = _slices(items, slice_chars)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text")
        index = Index([(r.item_id, r.text) for r in part.collect()], rate, min_chars)
        yield benchmark.sparkSession.sparkContext.broadcast(index)


#: Characters scanned at once.
CHUNK = 2_000_000


def _batch_matches(index: Index, bits: np.ndarray, texts: list[str | None]):
    """scan() over a batch, a bounded number of characters at a time."""
    at = 0
    while at < len(texts):
        size, stop = 0, at
        while stop < len(texts) and (stop == at or size < CHUNK):
            size += len(texts[stop] or "")
            stop += 1
        for d, *rest in scan(index, bits, [t or "" for t in texts[at:stop]]):
            yield at + d, *rest
        at = stop


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE,
            min_chars: int = MIN_CHARS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """doc_id, item_id, start, stop (characters of the text), edits and the
    number of compared characters of the best stretch of each document row for
    each item that it holds, or a window of it."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([src.schema["doc_id"], *MATCH])
    out = None
    for index in _indexes(benchmark, item_col, item_text_col, rate, min_chars, slice_chars):
        def run(batches, sent=index):
            index = sent.value
            bits = index.bitmap()
            for b in batches:
                got = list(_batch_matches(index, bits, b.column("text").to_pylist()))
                if got:
                    d, i, *rest = zip(*got)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(d, pa.int64())),
                         pa.array([index.ids[k] for k in i], pa.int64()),
                         *(pa.array(r, pa.int64()) for r in rest)], names=schema.names)

        found = src.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                        item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE,
                        min_chars: int = MIN_CHARS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns. Rows
    are dropped where they are scanned, so that no join is needed and rows
    of equal or null ids are judged one by one."""
    for index in _indexes(benchmark, item_col, item_text_col, rate, min_chars, slice_chars):
        def run(batches, sent=index):
            index = sent.value
            bits = index.bitmap()
            for b in batches:
                texts = b.column(text_col).to_pylist()
                hit = {d for d, *_ in _batch_matches(index, bits, texts)}
                yield b.take(pa.array([i for i in range(b.num_rows) if i not in hit], pa.int64()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
