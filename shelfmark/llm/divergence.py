"""Source divergence audit with hash-consed segment trees (operator 13).

How far is the vocabulary of a source from that of its language, and from
each other source of the language? Terms are runs of letters and characters
beyond ASCII, A-Z lower-cased. Each language keeps its V terms that stand in
at least ``MIN_DOCS`` of its documents. With N occurrences of kept terms, a
group gives a term that it holds ``count`` times the share

    p = 1 + floor(SCALE * (count + 1) / (N + V)),

and the price of p against q is f = floor((p - q)^2 / q); all of it in
integers.

A language's kept terms are cut into slices of consecutive term ids. In a
slice each source's counts are the leaves of a segment tree. Nodes are
hash-consed: a node is the pair of its children's numbers, and equal pairs
are one node, for all sources and places. The trees of two sources are walked
together from the roots down; equal node pairs are one entry with a
multiplicity, so that each is expanded and each pair of leaf counts priced
once, both ways. Spark adds the slices up, as the trees' upper levels would.

How the work travels: each task counts its documents' terms and sends one row
for each (language, source, term) of a bounded table; one shuffle by
(language, term) adds them up to one row a term. Slices hold at most
``SLICE_TERMS`` terms and ``SLICE_COUNTS`` counts; a language's list of
sources joins them by broadcast if it is proven small.

Defined results: null text, lang and source are read as ''; rows with equal
ids are documents of their own; a language without kept terms has value 0
for all its pairs and no terms; a language of one source has no pairs; an
empty table gives an empty result; only the three columns are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import small_side
from .common import stored

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Entries of a task's table of counts before it is sent.
TABLE = 400_000
#: Terms and non-zero counts of a slice; node pairs that are walked at once.
SLICE_TERMS, SLICE_COUNTS, WALK = 4096, 1_000_000, 2_000_000

#: Bytes of UTF-8: letters in lower case, those beyond ASCII, a gap for others.
_KEEP = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 32
              for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_KEEP).split() if text else []


# --- counting -------------------------------------------------------------

def _tables(batches):
    """(lang, source, term, n, docs) sums of a task's documents; the term ''
    stands for the group itself."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def send():
        for (lang, source), (n, docs) in groups.items():
            keys = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(keys) + 1)), pa.array([source] * (len(keys) + 1)),
                 pa.array(["", *(k.decode("utf-8", "replace") for k in keys)], pa.string()),
                 pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, keys)], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    size = 0
    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
            group = groups.get((lang, source))
            if group is None:
                group = groups[lang, source] = Counter(), Counter()
            found = terms(text)
            before = len(group[0])
            group[0].update(found)
            group[1].update(set(found))
            size += len(group[0]) - before
            if size >= TABLE:
                yield from send()
                size = 0
    yield from send()


def tallies(docs: DataFrame, lang_col: str = "lang", source_col: str = "source",
            text_col: str = "text") -> DataFrame:
    """One row for each (lang, term): docs, n and the counts by source;
    the term '' lists all sources of the language."""
    read = lambda c: F.coalesce(F.col(c), F.lit(""))
    src = docs.select(read(lang_col).alias("lang"), read(source_col).alias("source"),
                      F.col(text_col).cast("binary").alias("text"))
    parts = src.mapInArrow(_tables, "lang string, source string, term string, n long, docs long")
    # one shuffle serves both sums
    dealt = parts.repartition("lang", "term")
    return (dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"),
                                         F.collect_list(F.struct("source", "n")).alias("by")))


# --- segment trees --------------------------------------------------------

def _unique(key: np.ndarray):
    """Distinct numbers and each one's place among them."""
    distinct, place = np.unique(key, return_inverse=True)
    return distinct, place.reshape(key.shape)


def tree(counts: np.ndarray):
    """Hash-consed trees over the rows of ``counts`` (a power of two wide).

    Returns (the roots' numbers, the levels from the root down, each as the
    children (left, right) of its nodes, the leaves' values).
    """
    values, ids = _unique(counts)
    levels = []
    while ids.shape[1] > 1:
        # two numbers of a level in one: equal pairs are one node
        width = int(ids.max()) + 1
        keys, above = _unique(ids[:, 0::2] * width + ids[:, 1::2])
        levels.append((keys // width, keys % width))
        ids = above
    return ids[:, 0], levels[::-1], values


def walk(roots, levels, left: np.ndarray, right: np.ndarray):
    """The leaf pairs of the trees ``left[k]`` and ``right[k]``: (k, leaf,
    leaf, multiplicity), equal ones once."""
    k, a, b = np.arange(len(left)), roots[left], roots[right]
    m = np.ones(len(left), dtype=np.int64)
    for lo, hi in levels:
        k, m = np.concatenate([k, k]), np.concatenate([m, m])
        a, b = np.concatenate([lo[a], hi[a]]), np.concatenate([lo[b], hi[b]])
        width = int(max(a.max(), b.max())) + 1
        keys, first, place = np.unique((k * width + a) * width + b, return_index=True, return_inverse=True)
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, place.ravel(), m)
        k, a, b, m = k[first], a[first], b[first], total
    return k, a, b, m


def share(count, total) -> np.ndarray:
    """p of counts, in whole numbers of any size; ``total`` is N + V."""
    if len(count) and int(count.max()) >= (1 << 62) // SCALE:
        return np.array([1 + SCALE * (int(c) + 1) // int(t) for c, t in zip(count, np.broadcast_to(total, count.shape))],
                        dtype=np.int64)
    return 1 + SCALE * (count + 1) // total


def prices(counts: np.ndarray, totals: np.ndarray, tree_of: np.ndarray):
    """(i, j, value) of all ordered pairs of sources in one slice, in blocks.

    ``counts`` has a row for each distinct tree, ``tree_of`` the row of each
    source and ``totals`` its N + V.
    """
    n = counts.shape[1]
    wide = 1 << max(0, n - 1).bit_length()
    # places past the slice's end are leaves of their own (-1), never priced
    padded = np.full((len(counts), wide), -1, dtype=np.int64)
    padded[:, :n] = counts
    roots, levels, values = tree(padded)
    left, right = np.triu_indices(len(tree_of), 1)
    step = max(1, WALK // wide)
    for at in range(0, len(left), step):
        i, j = left[at:at + step], right[at:at + step]
        k, a, b, m = walk(roots, levels, tree_of[i], tree_of[j])
        real = values[a] >= 0
        k, a, b, m = k[real], a[real], b[real], m[real]
        p, q = share(values[a], totals[i[k]]), share(values[b], totals[j[k]])
        square = (p - q) ** 2
        there, back = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
        np.add.at(there, k, square // q * m)
        np.add.at(back, k, square // p * m)
        yield np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([there, back])


# --- slices ---------------------------------------------------------------

SLICE = "lang string, terms int, sources array<string>, at array<int>, who array<int>, n array<long>"
PART = "lang string, source string, item string, value long"


def _slices(batches):
    """Rows of (lang, by), ordered by language, as slices of one language."""
    lang, size, at, who, n = None, 0, [], [], []

    def close():
        names, place = np.unique(np.array(who, dtype=object), return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.string()), pa.array([size], pa.int32()),
             pa.array([names.tolist()], pa.list_(pa.string())), pa.array([at], pa.list_(pa.int32())),
             pa.array([place.tolist()], pa.list_(pa.int32())), pa.array([n], pa.list_(pa.int64()))],
            names=["lang", "terms", "sources", "at", "who", "n"])

    for b in batches:
        for row in b.to_pylist():
            if size and (row["lang"] != lang or size >= SLICE_TERMS or len(at) >= SLICE_COUNTS):
                yield close()
                size, at, who, n = 0, [], [], []
            lang = row["lang"]
            for x in row["by"]:
                at.append(size)
                who.append(x["source"])
                n.append(x["n"])
            size += 1
    if size:
        yield close()


def _priced(batches):
    """Slices with their language's sources -> partial values of pairs."""
    for b in batches:
        for row in b.to_pylist():
            names = [s["source"] for s in row["all"]]
            totals = np.array([s["n"] for s in row["all"]], dtype=np.int64) + row["v"]
            counts = np.zeros((len(row["sources"]) + 1, row["terms"]), dtype=np.int64)
            counts[row["who"], row["at"]] = row["n"]
            # a source without any of the terms has the last tree, all zero
            mine = {s: k for k, s in enumerate(row["sources"])}
            tree_of = np.array([mine.get(s, len(mine)) for s in names])
            labels = pa.array(names, pa.string())
            for i, j, value in prices(counts, totals, tree_of):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["lang"]] * len(i), pa.string()), labels.take(pa.array(i)), labels.take(pa.array(j)),
                     pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])


def _share(count: Column, total: Column) -> Column:
    scaled = (count.cast("decimal(20,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", scaled, total.cast("decimal(20,0)"))


def _ranked(part: DataFrame, name: str) -> DataFrame:
    # text compares by its UTF-8 bytes
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return part.select("lang", "source", F.lit(name).alias("part"), "item", "value",
                       F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the
    language (``pair``) and the ``top`` terms that the source has more of than
    its language (``term``), the farthest first."""
    spark = docs.sparkSession
    all_terms = stored(tallies(docs, lang_col, source_col, text_col), "tallies")
    kept = all_terms.where((F.col("term") != "") & (F.col("docs") >= min_docs))
    counts = kept.select("lang", "term", "total", F.explode("by").alias("x")).select(
        "lang", "term", "total", "x.source", "x.n")

    languages = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = stored(
        all_terms.where(F.col("term") == "").select("lang", F.explode("by.source").alias("source"))
        .join(sizes, ["lang", "source"], "left").join(languages, "lang", "left")
        .select("lang", "source", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n", "v", "lang_n"))),
        "groups")

    mine = small_side(groups.select("lang", "source", F.col("n").alias("group_n"), "v", "lang_n"))
    p, q = _share(F.col("n"), F.col("group_n") + F.col("v")), _share(F.col("total"), F.col("lang_n") + F.col("v"))
    term = (counts.join(mine, ["lang", "source"]).where("n > 0")
            .select("lang", "source", F.col("term").alias("item"), p.cast("long").alias("p"), q.cast("long").alias("q"))
            .where("p > q")
            .select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value")))

    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # terms of like frequency side by side: more subtrees are equal
    slices = (kept.select("lang", "term", "total", "by")
              .repartitionByRange(n, "lang", F.desc("total"), "term")
              .sortWithinPartitions("lang", F.desc("total"), "term")
              .select("lang", "by").mapInArrow(_slices, SLICE))
    lists = groups.where("v > 0").groupBy("lang").agg(
        F.first("v").alias("v"), F.collect_list(F.struct("source", "n")).alias("all"))
    small = groups.limit(100_001).count() <= 100_000
    partial = (slices.join(F.broadcast(lists) if small else lists, "lang")
               .mapInArrow(_priced, PART))
    values = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pair = (groups.select("lang", "source").join(small_side(other), "lang").where("source != item")
            .join(values, ["lang", "source", "item"], "left")
            .select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")))
    return _ranked(pair, "pair").unionByName(_ranked(term, "term").where(F.col("rank") <= top))
