"""Hard-negative mining with an STR-packed R-tree (operator 11).

The vectors are packed by sort-tile-recursive: slabs of the first coordinate,
in each slab tiles by the second (a range-partitioned sort over the cluster),
in each tile leaves by the third and fourth. Leaves, groups of leaves and the
tile have minimum bounding boxes. For an anchor, a box gives an interval of
every coordinate's product and, summed, of the inner product. A best-first
queue descends each tile's tree: the box with the highest possible score
comes next, boxes whose interval misses the wanted window of scores are
pruned, and so is what lies strictly below the k-th best score found (not what
equals it: ties are decided by the id). Nothing else is left out, so the
results are exact.

How the work travels: anchors are packed into blocks; waves of a bounded
number of blocks go to every task, which keeps the best of each anchor over
all its tiles and sends these alone. A first search gives an anchor's
positives (same label), a second one the negatives of their windows. A wave
is bounded by ``WAVE`` anchors, so memory doesn't grow with the table; the
number of waves does.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part; a shorter vector counts as padded with
zeros, so that an empty one scores 0; floor(256 * x) beyond the long range
takes its end, and so do scores, before windows are set; repeated rows of an id are rows like
others, but no row is a positive of an anchor with its own id; ties go to the
smaller id; an empty table gives an empty result; only the three columns
are read.
"""

from __future__ import annotations

import heapq
import math
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import stored

#: Rows of a tile, of a leaf; boxes under one inner box.
TILE, LEAF, FANOUT = 8192, 256, 8
#: Rows of a range of tiles, anchors in one block, anchors searched at a time.
RANGE, BLOCK, WAVE = 1_000_000, 1024, 16_384
#: Percentiles of the first coordinate, from which the slabs' bounds are taken.
PERCENTILES = 1000
LONG = (1 << 63) - 1

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v: whole numbers) of the rows that take part."""
    src = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                      F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return src.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite).select(
        "vec_id", "label", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


# --- packing --------------------------------------------------------------

PACKED = "size int, ids binary, labels binary, vectors binary"


def _matrix(column, width: int) -> np.ndarray:
    """A batch's vectors as rows of ``width`` whole numbers."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(lengths) * width and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def str_order(v: np.ndarray, leaf: int, first: int = 2) -> np.ndarray:
    """The order of a tile's rows: slabs by one coordinate, each by the next."""
    n, width = v.shape
    if not width:
        return np.arange(n)
    leaves = -(-n // leaf)
    slab = leaf * math.ceil(math.sqrt(leaves))
    order = np.argsort(v[:, first % width], kind="stable")
    return np.concatenate([part[np.argsort(v[part, (first + 1) % width], kind="stable")]
                           for part in (order[i:i + slab] for i in range(0, n, slab))])


def _pack(width: int, number: str, rows: int, ordered: bool):
    """Rows in the order they come -> packed tiles of one slab each."""
    def run(batches):
        held, size, slab = [], 0, None

        def close():
            ids, labels, v = (np.concatenate(x) for x in zip(*held))
            if ordered:
                o = str_order(v, LEAF)
                ids, labels, v = ids[o], labels[o], v[o]
            return pa.RecordBatch.from_arrays(
                [pa.array([len(ids)], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                 pa.array([labels.astype("<i8").tobytes()], pa.binary()),
                 pa.array([v.astype(number).tobytes()], pa.binary())],
                names=["size", "ids", "labels", "vectors"])

        for b in batches:
            ids, labels = (b.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            slabs, v = b.column("slab").to_numpy(zero_copy_only=False), _matrix(b.column("v"), width)
            at = 0
            while at < len(ids):
                if size and (size >= rows or slabs[at] != slab):
                    yield close()
                    held, size = [], 0
                slab = slabs[at]
                same = len(ids) if slabs[-1] == slab else at + int(np.argmax(slabs[at:] != slab))
                to = min(same, at + rows - size)
                held.append((ids[at:to], labels[at:to], v[at:to]))
                size, at = size + to - at, to
        if size:
            yield close()
    return run


class Packed:
    """Ids, labels and vectors of one packed row."""

    def __init__(self, row: dict, width: int, number: str, exact: bool):
        self.ids = np.frombuffer(row["ids"], dtype="<i8")
        self.labels = np.frombuffer(row["labels"], dtype="<i8")
        v = np.frombuffer(row["vectors"], dtype=number).reshape(len(self.ids), width)
        # doubles hold every sum exactly up to 2^53; beyond, Python's numbers
        self.v = v.astype(np.float64) if exact else v.astype(object)


# --- search ---------------------------------------------------------------

class Tree:
    """Boxes of a packed tile: leaves, groups of FANOUT boxes, one root."""

    def __init__(self, tile: Packed):
        self.tile = tile
        starts = range(0, len(tile.ids), LEAF)
        boxes = [(tile.v[i:i + LEAF].min(axis=0), tile.v[i:i + LEAF].max(axis=0)) for i in starts]
        self.leaves = len(boxes)
        children: list[range] = []
        level = range(self.leaves)
        while len(level) > 1:
            groups = [level[i:i + FANOUT] for i in range(0, len(level), FANOUT)]
            for g in groups:
                boxes.append((np.min([boxes[i][0] for i in g], axis=0), np.max([boxes[i][1] for i in g], axis=0)))
            children += groups
            level = range(len(boxes) - len(groups), len(boxes))
        self.children = children
        self.lo, self.hi = (np.stack(x).T for x in zip(*boxes))
        self.root = len(boxes) - 1

    def intervals(self, v: np.ndarray):
        """(lowest, highest) inner product of each anchor with each box."""
        up, down = np.maximum(v, 0), np.minimum(v, 0)
        return up @ self.lo + down @ self.hi, up @ self.hi + down @ self.lo


class Best:
    """The k best (score, id) of one anchor and window so far."""

    __slots__ = ("k", "low", "high", "scores", "ids")

    def __init__(self, k: int, low=None, high=None):
        self.k, self.low, self.high = k, low, high
        self.scores = self.ids = np.zeros(0, dtype=np.int64)

    @property
    def least(self):
        """What a score must reach to matter."""
        if len(self.scores) < self.k:
            return self.low
        kth = self.scores[-1]
        return kth if self.low is None or kth > self.low else self.low

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = np.ones(len(scores), dtype=bool)
        least = self.least
        if least is not None:
            keep &= scores >= least
        if self.high is not None:
            keep &= scores <= self.high
        if not keep.any():
            return
        scores, ids = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, ids[keep]])
        if scores.dtype == object:
            order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:self.k]
        else:
            order = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]


def search(tree: Tree, anchors: np.ndarray, goals: list[list[Best]], fits) -> None:
    """Adds the tile's rows to the goals of each anchor; ``fits(i, leaf
    slice)`` tells which rows of a leaf the i-th anchor may take."""
    lowest, highest = tree.intervals(anchors)
    for i, mine in enumerate(goals):
        leaves: dict[int, tuple] = {}
        low, high = lowest[i], highest[i]
        for goal in mine:
            if goal.high is not None and goal.low > goal.high:
                continue  # a window below a score under 0
            queue = [(-high[tree.root], tree.root)]
            while queue:
                bound, box = heapq.heappop(queue)
                least = goal.least
                if least is not None and -bound < least:
                    break  # all that is left lies strictly below
                if goal.high is not None and low[box] > goal.high:
                    continue
                if box >= tree.leaves:
                    for c in tree.children[box - tree.leaves]:
                        heapq.heappush(queue, (-high[c], c))
                    continue
                found = leaves.get(box)
                if found is None:
                    rows = slice(box * LEAF, (box + 1) * LEAF)
                    may = fits(i, rows)
                    found = leaves[box] = tree.tile.v[rows][may] @ anchors[i], tree.tile.ids[rows][may]
                goal.add(*found)


FOUND = "anchor long, slot int, vec_id long, score long"


def _rows(goals, first: int):
    """The goals' contents as (anchor, slot, vec_id, score)."""
    a, s, i, v = [], [], [], []
    for n, mine in enumerate(goals):
        for slot, goal in enumerate(mine):
            a += [first + n] * len(goal.ids)
            s += [slot] * len(goal.ids)
            i += goal.ids.tolist()
            v += [max(-LONG - 1, min(LONG, int(x))) for x in goal.scores]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(s, pa.int32()), pa.array(i, pa.int64()),
                                       pa.array(v, pa.int64())], names=["anchor", "slot", "vec_id", "score"])


def _searched(tiles: DataFrame, wave, first: int, width: int, number: str, exact: bool,
              goals_of, same_label: bool) -> DataFrame:
    """Each task's best rows for each goal of the wave's anchors."""
    def run(batches):
        anchors = [Packed(r, width, number, exact) for r in wave.value]
        goals = goals_of()
        for b in batches:
            for row in b.to_pylist():
                tree, at = Tree(Packed(row, width, number, exact)), 0
                for block in anchors:
                    def fits(i, rows, block=block):
                        same = tree.tile.labels[rows] == block.labels[i]
                        return same & (tree.tile.ids[rows] != block.ids[i]) if same_label else ~same
                    search(tree, block.v, goals[at:at + len(block.ids)], fits)
                    at += len(block.ids)
        yield _rows(goals, first)
    return tiles.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _waves(blocks: DataFrame):
    """Blocks of at most WAVE anchors together, one wave after the other."""
    held, size = [], 0
    for row in blocks.toLocalIterator():
        if held and size + row["size"] > WAVE:
            yield held
            held, size = [], 0
        held.append(row.asDict())
        size += row["size"]
    if held:
        yield held


def hard_negatives(embeddings: DataFrame, anchor, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, label=None, scale: int = 256, id_col: str = "vec_id",
                   vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Each anchor's ``positives`` best rows of its label and, for each, the
    ``negatives`` best of other labels that score between ``low`` and
    ``high`` hundredths of it. ``anchor`` is a condition on ``vec_id`` and
    ``label``, an expression that replaces the label."""
    spark = embeddings.sparkSession
    rows = quantised(embeddings, id_col, vector_col, label_col, scale)
    if label is not None:
        rows = rows.withColumn("label", label)
    rows = stored(rows, "vectors")
    n, width, most, marks = rows.agg(
        F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)),
        F.coalesce(F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))), F.lit(0.0)),
        F.percentile_approx(F.get("v", F.lit(0)), [(i + 1) / PERCENTILES for i in range(PERCENTILES - 1)], 10_000),
    ).first()
    exact = width * most * most < 2 ** 53
    number = next(t for t, bits in (("<i2", 15), ("<i4", 31), ("<i8", 64)) if most < 2 ** bits)

    # slabs of the first coordinate: as many as tiles in a slab
    slabs = min(PERCENTILES, max(1, math.ceil(math.sqrt(n / TILE))))
    cuts = sorted({marks[len(marks) * i // slabs] for i in range(1, slabs)}) if marks else []
    key = [F.coalesce(F.get("v", F.lit(c)), F.lit(0)) for c in (0, 1, 2)]
    slab = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= key[0])) if cuts else F.lit(0)
    sort = ["slab", "c1", "c2", "vec_id"]
    keyed = rows.withColumns({"slab": slab, "c1": key[1], "c2": key[2]})
    parts = max(spark.sparkContext.defaultParallelism, -(-n // RANGE))
    tiles = stored(keyed.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
                   .select("vec_id", "label", "slab", "v").mapInArrow(_pack(width, number, TILE, True), PACKED), "tiles")
    blocks = stored(rows.where(anchor).withColumn("slab", F.lit(0))
                    .mapInArrow(_pack(width, number, BLOCK, False), PACKED), "anchors")

    folder = os.path.join(checkpoint_dir(spark), f"negatives-{uuid.uuid4().hex}")
    spark.createDataFrame([], RESULT).write.parquet(folder)
    first = 0
    for held in _waves(blocks):
        wave = spark.sparkContext.broadcast(held)
        ids = np.concatenate([np.frombuffer(r["ids"], dtype="<i8") for r in held])
        count = len(ids)
        nearest = _searched(tiles, wave, first, width, number, exact,
                            lambda count=count: [[Best(positives)] for _ in range(count)], True)
        # at most ``positives`` rows for each of the wave's anchors
        windows: list[list] = [[] for _ in ids]
        for r in _best(nearest, positives).select("anchor", "vec_id", "score", "rank").collect():
            windows[r["anchor"] - first].append((r["rank"], r["vec_id"], r["score"]))
        windows = [[(i, s) for _, i, s in sorted(w)] for w in windows]

        def goals(windows=windows):
            # 100 * score from low * s to high * s, in whole numbers
            return [[Best(negatives, -(-low * s // 100), high * s // 100) for _, s in w] for w in windows]

        found = _best(_searched(tiles, wave, first, width, number, exact, goals, False), negatives)
        pairs = [(first + a, slot, int(ids[a]), i, s) for a, w in enumerate(windows) for slot, (i, s) in enumerate(w)]
        known = spark.createDataFrame(pairs, "anchor long, slot int, anchor_id long, positive_id long, positive_score long")
        (found.join(F.broadcast(known), ["anchor", "slot"])  # WAVE * positives rows at most
         .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                 "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(folder))
        wave.unpersist()
        first += count
    return spark.read.schema(RESULT).parquet(folder)
