"""Removal of byte strings that occur twice, by suffix sorting (operator 9).

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else, in the same or in another document, is removed.

Candidates: of the m-byte strings inside a window of LENGTH bytes the one of
least hash is its anchor. Equal windows have equal anchors at equal places,
so windows are only compared within the class of their anchor. Runs of
windows with one anchor form a block; a block is a row of hashes, about one
for 75 bytes of text. Blocks of equal content are equal suffixes and settled
by their count. The other blocks of a class, where texts begin or cease to
agree, are fetched and suffix-sorted: a merge sort whose comparisons find
the common extension of two suffixes by binary search over prefix polynomial
hashes. Neighbours in that order and the hashes of what stands left of the
anchors tell which windows are equal; equal windows are then compared byte
by byte, and a collision repeats the work with another base.

A class of more than ``HOT`` distinct blocks (a frequent short passage in
ever other surroundings) is split by longer anchors, at last by the whole
window, so that no class has to fit one task.

Defined results: a null text is empty; texts shorter than LENGTH keep all;
rows of equal id and text are separate documents (copies of each other);
null ids are allowed; an empty table gives an empty result; only the id and
text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread, stored
from .hashing import BASES, Hashes, mix

LENGTH = 200
#: Anchor lengths, the first for all classes, the others for hot ones.
ANCHORS = (50, 100, 150, 200)
HOT = 4_000
#: Bytes of text hashed at once; the windows of longer texts are dealt out
#: over several pieces.
PIECE = 4_000_000
#: Bytes of blocks that are suffix-sorted at once, at least one class.
SORTED = 1_000_000
#: Document keys (16 bytes each) that may be broadcast, after a count.
BROADCAST_KEYS = 1_000_000

_PLACE = 24                                   # bits of a place in a piece
_LOW = np.uint64((1 << _PLACE) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(x)
    if width == 1:
        return x
    rows = -(-n // width)
    padded = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
    padded[:n] = x
    grid = padded.reshape(rows, width)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n - width + 1], head[width - 1:n])


def blocks(data: np.ndarray, ends: np.ndarray, anchor: int, salt: int = 0):
    """Blocks of the texts that ``data`` holds one after the other (``ends``:
    where each stops): anchor hash, content hash, place of the anchor, and
    first and last window start."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    h = Hashes(data)
    start = np.arange(n - anchor + 1)
    gram = mix(h.of(start, start + anchor) + np.uint64(anchor))
    order = (mix(gram + np.uint64(0x5851F42D4C957F2D)) & ~_LOW) | start.astype(np.uint64)
    place = (_sliding_min(order, LENGTH - anchor + 1) & _LOW).astype(np.int64)
    p = np.arange(len(place))
    whole = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[:len(p)] >= p + LENGTH
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (place[1:] != place[:-1])
    last = whole.copy()
    last[:-1] &= ~whole[1:] | (place[1:] != place[:-1])
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    q = place[s]
    content = mix(h.of(s, e + LENGTH) + (q - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                   + (e - s).astype(np.uint64))
    return gram[q], content, q, s, e


def _pieces(texts: list[bytes]):
    """Lists of (text number, offset, bytes) of bounded size; a longer text's
    pieces overlap so that each window is in just one."""
    got, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            part = t[at:at + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if got and size + len(part) > PIECE:
                yield got
                got, size = [], 0
            got.append((i, at, part))
            size += len(part)
    if got:
        yield got


def _block_rows(batches):
    """doc, h: the document; a, c: hashes of anchor and content; q: place of
    the anchor; lr: how far the first and last window start before it."""
    names = ["doc", "h", "a", "c", "q", "lr"]
    for b in batches:
        texts = [(t.as_py() or "").encode("utf-8") for t in b.column("text")]
        for part in _pieces(texts):
            data = np.frombuffer(b"".join(x for _, _, x in part), dtype=np.uint8)
            ends = np.cumsum([len(x) for _, _, x in part])
            a, c, q, s, e = blocks(data, ends, ANCHORS[0])
            k = np.searchsorted(ends, s, side="right")
            number = np.array([i for i, _, _ in part])[k]
            # a place in the piece to a place in the text
            shift = (np.array([at for _, at, _ in part]) - (ends - [len(x) for _, _, x in part]))[k]
            at = pa.array(number, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(at), b.column("h").take(at), pa.array(a.view(np.int64)),
                 pa.array(c.view(np.int64)), pa.array(q + shift), pa.array(((q - s) * 256 + (q - e)).astype(np.int32))],
                names=names)


# --- suffix sorting -------------------------------------------------------

def extension(h: Hashes, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many bytes from a and from b on are equal, up to ``limit``."""
    low, high = np.zeros_like(limit), limit.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high + 1) >> 1
        same = h.of(a, a + middle) == h.of(b, b + middle)
        low = np.where(open_ & same, middle, low)
        high = np.where(open_ & ~same, middle - 1, high)


def suffix_order(h: Hashes, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffixes data[start:start + size] in order, by merge sort; all
    merges of one level run together, each row looking for its place in the
    sibling run by binary search. Equal suffixes keep their order."""
    n = len(start)
    order = np.arange(n)

    def before(i, j):
        """Suffix i < suffix j."""
        limit = np.minimum(size[i], size[j])
        e = extension(h, start[i], start[j], limit)
        inside = e < limit
        x = np.where(inside, data[np.minimum(start[i] + e, len(data) - 1)].astype(np.int64), -1)
        y = np.where(inside, data[np.minimum(start[j] + e, len(data) - 1)].astype(np.int64), -1)
        return np.where(inside, x < y, size[i] < size[j])

    width = 1
    while width < n:
        rows = np.arange(n)
        run = rows // width
        sibling = run ^ 1
        begin = np.minimum(sibling * width, n)
        low, high = begin.copy(), np.minimum(begin + width, n)
        left = (run & 1) == 0
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            mine, other = order[open_], order[middle]
            # rows of the left run go before equal ones of the right run
            lefts = left[open_]
            up = before(np.where(lefts, other, mine), np.where(lefts, mine, other)) == lefts
            low[open_] = np.where(up, middle + 1, low[open_])
            high[open_] = np.where(up, high[open_], middle)
        # own rank in the run, and how many of the sibling come before
        place = (run >> 1) * 2 * width + (rows - run * width) + (low - begin)
        new = np.empty(n, dtype=np.int64)
        new[place] = order
        order = new
        width *= 2
    return order


def equal_windows(parts: list[bytes], left: np.ndarray, right: np.ndarray, base: int = BASES[0]):
    """For blocks of one or more classes (bytes; how far the first and last
    window start before the anchor): rows x LENGTH + 1 flags, true where the
    window that starts x bytes before the anchor is also in another block.
    None after a hash collision."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    h = Hashes(data, base)
    sizes = np.array([len(x) for x in parts], dtype=np.int64)
    at = np.cumsum(sizes) - sizes + left
    order = suffix_order(h, data, at, sizes - left)
    a, b = at[order[:-1]], at[order[1:]]
    common = extension(h, a, b, np.minimum((sizes - left)[order[:-1]], (sizes - left)[order[1:]]))
    flags = np.zeros((len(parts), LENGTH + 1), dtype=bool)
    window = np.arange(LENGTH)
    for x in range(int(right.min()), int(left.max()) + 1):
        # suffixes that agree in the LENGTH - x bytes from the anchor on
        group = np.concatenate([[0], np.cumsum(common < LENGTH - x)])
        fit = (left[order] >= x) & (right[order] <= x)
        if fit.sum() < 2:
            continue
        row, group = order[fit], group[fit]
        before = h.of(at[row] - x, at[row])
        by = np.lexsort((before, group))
        row, group, before = row[by], group[by], before[by]
        same = (group[1:] == group[:-1]) & (before[1:] == before[:-1])
        pair = np.flatnonzero(same)
        for k in range(0, len(pair), 10_000):
            i, j = row[pair[k:k + 10_000]], row[pair[k:k + 10_000] + 1]
            if not (data[(at[i] - x)[:, None] + window] == data[(at[j] - x)[:, None] + window]).all():
                return None
        flags[row[pair], x] = True
        flags[row[pair + 1], x] = True
    return flags


def _sorted_spans(batches):
    """Rows of classes (sorted by a) to (doc, h, first, last): runs of window
    starts of single blocks that another block of the class has too."""
    names = ["a", "n", "doc", "h", "q", "lr", "bytes"]

    def spans(rows):
        parts = [r[6] for r in rows]
        lr = np.array([r[5] for r in rows], dtype=np.int64)
        left, right = lr >> 8, lr & 255
        for base in BASES:
            flags = equal_windows(parts, left, right, base)
            if flags is not None:
                break
        else:
            raise RuntimeError("three bases in turn gave colliding hashes")
        flags[np.array([r[1] for r in rows]) > 1] = False       # settled by their count
        edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, x1 = np.nonzero(edge == 1)
        _, x2 = np.nonzero(edge == -1)
        q = np.array([r[4] for r in rows], dtype=np.int64)[i]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[k][2] for k in i], pa.int64()), pa.array([rows[k][3] for k in i], pa.int64()),
             pa.array(q - x2 + 1), pa.array(q - x1)], names=["doc", "h", "first", "last"])

    rows, size = [], 0
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in names)):
            if size >= SORTED and r[0] != rows[-1][0]:
                yield spans(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r[6])
    if rows:
        yield spans(rows)


# --- the operator ---------------------------------------------------------

def _parted(docs: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(documents that ``lists`` is about, the others), parted in the scan by
    a broadcast of their keys where these are few enough, so that the others'
    texts are not shuffled; beyond the bound (all documents, None)."""
    keys = lists.select("doc", "h")
    if keys.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
        return docs, None
    keys = F.broadcast(keys)
    return docs.join(keys, ["doc", "h"], "left_semi"), docs.join(keys, ["doc", "h"], "left_anti")


def _row_key(id_col: Column, text: Column) -> tuple[Column, Column]:
    """A document row: its id (for null ids one hash of the text) and another
    hash of the text, which tell rows of one id, and those without, apart
    (equal id and text: the same result)."""
    text = F.coalesce(text, F.lit(""))
    return (F.coalesce(id_col.cast("long"), F.xxhash64(text, F.lit("no id"))).alias("doc"),
            F.xxhash64(text).alias("h"))


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted blocks (doc, h, a, c, n, q, lr)."""
    lists = wanted.groupBy("doc", "h").agg(F.collect_list(F.struct("a", "c", "n", "q", "lr")).alias("wanted"))
    lists = stored(lists, "wanted-blocks")
    rows = _parted(docs, lists)[0].join(lists.hint("merge"), ["doc", "h"])

    def run(batches):
        for b in batches:
            out = []
            for doc, h, text, wanted in zip(*(b.column(c).to_pylist() for c in ("doc", "h", "text", "wanted"))):
                raw = (text or "").encode("utf-8")
                for w in wanted:
                    s, e = w["q"] - (w["lr"] >> 8), w["q"] - (w["lr"] & 255)
                    out.append((w["a"], w["c"], w["n"], doc, h, w["q"], w["lr"], raw[s:e + LENGTH]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)],
                names=["a", "c", "n", "doc", "h", "q", "lr", "bytes"])

    return rows.select("doc", "h", "text", "wanted").mapInArrow(
        run, "a long, c long, n long, doc long, h long, q long, lr int, bytes binary")


def _smaller_blocks(rows: DataFrame, anchor: int) -> DataFrame:
    """Blocks cut anew by a longer anchor."""
    def run(batches):
        for b in batches:
            out = []
            for n, doc, h, q0, lr, raw in zip(*(b.column(c).to_pylist() for c in ("n", "doc", "h", "q", "lr", "bytes"))):
                a, c, q, s, e = blocks(np.frombuffer(raw, dtype=np.uint8), np.array([len(raw)]), anchor)
                base = q0 - (lr >> 8)
                for x in zip(a.view(np.int64).tolist(), c.view(np.int64).tolist(), q.tolist(), s.tolist(), e.tolist()):
                    out.append((x[0], x[1], n, doc, h, base + x[2], (x[2] - x[3]) * 256 + x[2] - x[4],
                                raw[x[3]:x[4] + LENGTH]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)],
                names=["a", "c", "n", "doc", "h", "q", "lr", "bytes"])

    return rows.select("n", "doc", "h", "q", "lr", "bytes").mapInArrow(
        run, "a long, c long, n long, doc long, h long, q long, lr int, bytes binary")


def _whole(rows: DataFrame) -> DataFrame:
    """Every window start of a block."""
    return rows.select("doc", "h", (F.col("q") - F.shiftright("lr", 8)).alias("first"),
                       (F.col("q") - F.col("lr").bitwiseAND(255)).alias("last"))


def _settle(rows: DataFrame, level: int, hot: int) -> list[DataFrame]:
    """Spans of the blocks in ``rows`` (with their bytes, equal contents
    already one row or counted here), class by class."""
    classes = stored(rows.groupBy("a").agg(F.count("*").alias("k")).where("k > 1"), "classes")
    shared = rows.join(classes, "a")
    small = shared.where(F.col("k") <= hot)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = [small.select("a", "n", "doc", "h", "q", "lr", "bytes").repartition(partitions, "a")
           .sortWithinPartitions("a").mapInArrow(_sorted_spans, "doc long, h long, first long, last long")]
    if level + 1 < len(ANCHORS) and classes.where(F.col("k") > hot).limit(1).count():
        finer = stored(_smaller_blocks(shared.where((F.col("k") > hot)), ANCHORS[level + 1]), "smaller-blocks")
        counts = stored(finer.groupBy("a", "c").agg(F.sum("n").alias("total"), F.min(F.struct("doc", "h", "q")).alias("one")), "contents")
        counted = finer.join(counts, ["a", "c"])
        out.append(_whole(counted.where("total > 1")))
        once = stored(counted.where("struct(doc, h, q) = one").withColumn("n", F.col("total"))
                      .select("a", "c", "n", "doc", "h", "q", "lr", "bytes"), "contents-once")
        out += _settle(once, level + 1, hot)
    return out


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed
    spans [start, stop) in bytes, for every row."""
    src = docs.select(F.col(id_col).alias("doc_id"), *_row_key(F.col(id_col), F.col(text_col)),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = src.select("doc", "h", "text")
    rows = spread(keyed).mapInArrow(_block_rows, "doc long, h long, a long, c long, q long, lr int")

    # classes of two or more blocks; 'alike' if all have one content
    classes = stored(rows.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"))
                     .where("n > 1").select("a", (F.col("lo") == F.col("hi")).alias("alike")), "classes")
    shared = stored(rows.join(classes, "a"), "shared-blocks")
    spans = [_whole(shared.where("alike"))]
    mixed = shared.where("not alike")
    contents = stored(mixed.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc", "h", "q", "lr")).alias("one")),
                      "contents")
    spans.append(_whole(mixed.join(contents.where("n > 1").select("a", "c"), ["a", "c"])))
    once = contents.select("a", "c", "n", "one.doc", "one.h", "one.q", "one.lr")
    fetched = stored(_fetch(keyed, once), "block-bytes")
    spans += _settle(fetched, 0, hot)

    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    lists = stored(every.groupBy("doc", "h").agg(
        F.sort_array(F.collect_set(F.struct("first", "last"))).alias("starts")), "spans")
    return _without(src, lists)


def _without(src: DataFrame, lists: DataFrame) -> DataFrame:
    """The rows with what is left of their texts, by the starts of repeated
    windows."""
    mine, others = _parted(src, lists)
    joined = mine.join(lists.hint("merge"), ["doc", "h"], "left").select("doc_id", "text", "starts")
    if others is not None:
        nothing = F.lit(None).cast(lists.schema["starts"].dataType).alias("starts")
        joined = joined.unionByName(others.select("doc_id", "text", nothing))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    schema = T.StructType([src.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")),
                           T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(span))])

    def run(batches):
        for b in batches:
            cols = [[], [], [], [], []]
            for text, starts in zip(b.column("text"), b.column("starts").to_pylist()):
                raw = (text.as_py() or "").encode("utf-8")
                merged: list[list[int]] = []
                for x in starts or ():
                    if merged and x["first"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["last"] + LENGTH)
                    else:
                        merged.append([x["first"], x["last"] + LENGTH])
                left, at = hashlib.sha256(), 0
                for s, e in merged:
                    left.update(raw[at:s])
                    at = e
                left.update(raw[at:])
                for c, v in zip(cols, (len(raw), sum(e - s for s, e in merged), len(merged), left.hexdigest(),
                                       [{"start": s, "stop": e} for s, e in merged])):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(),
                     pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=schema.names)

    return joined.select("doc_id", "text", "starts").mapInArrow(run, schema)
