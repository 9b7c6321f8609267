"""Near-duplicate groups by fast similarity sketching (operator 2).

A document's set holds its distinct shingles of k words. The sketch has t
coordinates. In round r < t every shingle is thrown into one hashed bin with
a hashed value; a bin keeps the least value of the first round that reaches
it, and the rounds end when all bins are full. Rounds t to 2t - 1 throw
everything into bin r - t, so that every coordinate is full at the latest
then, even for one shingle. Two sets agree in a coordinate with probability
equal to their similarity, with the concentration of independent trials.
Bands of four coordinates give candidate buckets: with 32 bands a pair at
similarity 0.85 is missed with probability below 1e-10 (0.8: 5e-8).

Links are confirmed on the full sets, exactly, and equal word sequences are
one node. First each bucket's nodes are compared with its least node, in
buckets of four, eight and sixteen coordinates; linked nodes become one
component. A group of n near copies thus costs about n comparisons. What is
left are buckets of several components. Their pairs across components are
judged by a second, larger sketch, block against block: a pair goes on to
the exact comparison unless so few of its ``LARGE`` coordinates agree that a
link has a probability below ``LOSS``. A pair is looked at in the first
bucket it shares only. Big buckets are dealt out over blocks of ``BLOCK``
nodes, so that no task holds a whole group.

Defined results: a null text or one without words has an empty set and is
linked with nothing; nodes are word sequences, so that an id may have
several, and rows of equal ids are one document: its sequences are linked.
A row with a null id belongs to the component of its text, whose id is the
least that it reaches, or null where it reaches none. ``deduplicated`` keeps
one row of each component, copies and rows of null ids included, and all rows
without words. An empty table gives an empty result; only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import small_side
from .common import sieve, spread, stored
from .components import components
from .hashing import Hashes, mix, times

SIZE, BAND = 128, 4
#: Coordinates of the second sketch (their last eight bits are kept), the
#: probability of losing a link by it, and nodes of a bucket in one block.
LARGE, LOSS, BLOCK = 1024, 1e-8, 512

_M1, _M2 = 0x9E3779B97F4A7C15, 0x94D049BB133111EB
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_list(text: str | None) -> list[bytes]:
    """The words, A-Z lower-cased: on bytes, Python's lower() and split()
    know ASCII only, which is what is asked for."""
    return text.encode("utf-8").lower().split() if text else []


def shingles(words: list[bytes], k: int) -> set:
    if len(words) <= k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k))))


def shingle_hashes(docs: list[list[bytes]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every shingle of every document (with repeats), and
    the number of the document: from prefix polynomials over the words."""
    owner, first, last, at = [], [], [], 0
    for i, words in enumerate(docs):
        if not words:
            continue
        ends = np.cumsum([len(w) + 1 for w in words]) + at
        begins = np.concatenate([[at], ends[:-1]])
        n = max(1, len(words) - k + 1)
        width = min(k, len(words))
        first.append(begins[:n])
        last.append(ends[width - 1:width - 1 + n])
        owner.append(np.full(n, i, dtype=np.int64))
        at = int(ends[-1])
    if not owner:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.frombuffer(b"".join(b" ".join(w) + b" " for w in docs if w), dtype=np.uint8)
    return mix(Hashes(raw).of(np.concatenate(first), np.concatenate(last))), np.concatenate(owner)


def sketch(hashes: np.ndarray, owner: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """An n x size matrix; rows without shingles stay at the highest value.
    A round works on the documents that still have an empty bin."""
    out = np.full((n, size), _NONE, dtype=np.uint64)
    live = np.unique(owner)                      # numbers of the open documents
    mine = np.full((len(live), size), _NONE, dtype=np.uint64)
    h, d = hashes, np.searchsorted(live, owner)
    for r in range(2 * size):
        if not len(live):
            break
        v = mix(h ^ times(r + 1, _M1))
        bins = (v % np.uint64(size)).astype(np.int64) if r < size else r - size
        seen = np.full(mine.size, _NONE, dtype=np.uint64)
        np.minimum.at(seen, d * size + bins, v >> np.uint64(8))
        seen = seen.reshape(mine.shape)
        new = (mine == _NONE) & (seen != _NONE)
        mine[new] = mix(seen[new] + times(r, _M2))
        full = (mine != _NONE).all(axis=1)
        if full.any():
            out[live[full]] = mine[full]
            more = ~full[d]
            h, d = h[more], (np.cumsum(~full) - 1)[d[more]]
            live, mine = live[~full], mine[~full]
    out[live] = mine
    return out


def bands(matrix: np.ndarray, rows: int = BAND) -> np.ndarray:
    """One 64-bit bucket key for each band of each row."""
    n, size = matrix.shape
    m = matrix.reshape(n, size // rows, rows)
    key = np.broadcast_to(np.arange(1, size // rows + 1, dtype=np.uint64) * np.uint64(_M1), (n, size // rows)).copy()
    for i in range(rows):
        key = mix(key ^ m[:, :, i]) + np.uint64(_M1)
    return key


def row_key(id_col: Column, text: Column) -> Column:
    """Equal for rows of one id and text only."""
    return F.unhex(F.sha2(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))), 256))


def features(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, raw (the row's key), n_shingles, digest of the word sequence,
    bucket keys; one pass over the whole texts."""
    schema = "doc_id long, raw binary, n_shingles long, digest binary, keys array<long>"

    def run(batches):
        for b in batches:
            texts = [word_list(t.as_py()) for t in b.column("text")]
            h, owner = shingle_hashes(texts, k)
            keys = bands(sketch(h, owner, len(texts))).view(np.int64)
            rows = [x if w else x[:0] for x, w in zip(keys, texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("raw"), pa.array([len(shingles(w, k)) for w in texts], pa.int64()),
                 pa.array([hashlib.sha256(b" ".join(w)).digest() if w else None for w in texts], pa.binary()),
                 pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "raw", "n_shingles", "digest", "keys"])

    return docs.mapInArrow(run, schema)


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v) of the pairs (a, b) whose full sets are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    rows = pairs.select("a", "b").join(right, "b").join(left, "a")

    def run(batches):
        last, mine = None, set()
        for batch in batches:
            u, v = [], []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
                if last is None or a != last:
                    last, mine = a, shingles(word_list(ta), k)
                other = shingles(word_list(tb), k)
                both = len(mine & other)
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "u long, v long")


def _wider(keys: np.ndarray) -> np.ndarray:
    """Bucket keys of two and of four neighbouring bands."""
    two = mix(keys[:, ::2] ^ mix(keys[:, 1::2]))
    four = mix(two[:, ::2] ^ mix(two[:, 1::2]))
    return np.concatenate([two, four], axis=1)


def _wide_keys(batches):
    for b in batches:
        keys = np.array(b.column("keys").to_pylist(), dtype=np.int64).view(np.uint64)
        wide = _wider(keys).view(np.int64) if len(keys) else []
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(list(wide), pa.list_(pa.int64()))],
                                         names=["node", "keys"])


def _signatures(k: int):
    """The large sketch of each text, eight bits a coordinate."""
    def run(batches):
        for b in batches:
            texts = [word_list(t.as_py()) for t in b.column("text")]
            h, owner = shingle_hashes(texts, k)
            low = (sketch(h, owner, len(texts), LARGE) & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([x.tobytes() for x in low], pa.binary())],
                                             names=["node", "sig"])
    return run


def least_agreement(similarity: float, size: int = LARGE, loss: float = LOSS) -> int:
    """Agreeing coordinates that a pair at ``similarity`` has but for a
    probability of ``loss`` (Chernoff's bound)."""
    for x in range(int(similarity * size), 0, -1):
        q = x / size
        distance = q * math.log(q / similarity) + (1 - q) * math.log((1 - q) / (1 - similarity))
        if size * distance >= -math.log(loss):
            return x
    return 0


def _across(percent: int):
    """Blocks of one bucket (rows sorted by bucket and block): pairs of
    different components that may be linked."""
    least = least_agreement(percent / 100)
    names = ["key", "i", "j", "band", "left", "node", "n", "component", "keys", "sig"]

    def pairs(rows):
        left = [r for r in rows if r[4]]
        right = [r for r in rows if not r[4]]
        if not left or not right:
            return [], []
        band = rows[0][3]
        node, n, comp = (np.array([r[c] for r in right], dtype=np.int64) for c in (5, 6, 7))
        keys = np.array([r[8] for r in right], dtype=np.int64)
        sig = np.frombuffer(b"".join(r[9] for r in right), dtype=np.uint8).reshape(len(right), -1)
        a, b = [], []
        for r in left:
            fit = (comp != r[7]) & (100 * np.minimum(n, r[6]) >= percent * np.maximum(n, r[6]))
            at = np.flatnonzero(fit)
            if not len(at):
                continue
            # of the buckets that both are in, this must be the first
            at = at[(keys[at] == np.array(r[8], dtype=np.int64)).argmax(axis=1) == band]
            at = at[(sig[at] == np.frombuffer(r[9], dtype=np.uint8)).sum(axis=1) >= least]
            for x in node[at].tolist():
                a.append(min(x, r[5]))
                b.append(max(x, r[5]))
        return a, b

    def run(batches):
        rows = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in names)):
                if rows and r[:3] != rows[-1][:3]:
                    a, b = pairs(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                    rows = []
                rows.append(r)
        a, b = pairs(rows) if rows else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _star(rows: DataFrame, name: str) -> DataFrame:
    """(key, a): the buckets of two or more nodes with their least node."""
    return stored(rows.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z"))
                  .where("a < z").select("key", "a"), name)


def _classes(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (its number), raw (its key), n_shingles, component (of its
    node), alone (no other row has it) and again (another row has its key) of
    every row."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = src.withColumn("raw", row_key(F.col("doc_id"), F.col("text")))
    every = stored(features(spread(keyed), k).withColumn("row", F.monotonically_increasing_id()), "features")

    # equal word sequences: one node, the least row
    copies = stored(every.where("digest is not null").groupBy("digest")
                    .agg(F.min("row").alias("node"), F.count("*").alias("n"))
                    .where("n > 1").select("digest", "node"), "copies")
    # only rows that may be copies are joined; the others keep their keys where they are
    copied = sieve(copies.select("digest"))
    names = ["doc_id", "row", "raw", "n_shingles"]
    may, single = copied(every.select(*names, "digest"), "digest")
    rows = stored(may.join(copies, "digest", "left")
                  .select(*names, F.coalesce("node", "row").alias("node"), F.col("node").isNotNull().alias("copied"))
                  .unionByName(single.select(*names, F.col("row").alias("node"), F.lit(False).alias("copied"))), "nodes")
    may, single = copied(every.where("n_shingles > 0"), "digest")
    own = (may.join(copies, "digest", "left").where("node is null or node = row").drop("node").unionByName(single)
           .select(F.col("row").alias("node"), "raw", "n_shingles", "keys"))
    # rows of one id and text are the same several times
    again = stored(rows.where("n_shingles > 0").groupBy("raw").agg(F.count("*").alias("n")).where("n > 1").select("raw"),
                   "repeated-rows")
    label = _linked(keyed, own, small_side(again), k, percent)
    # ids of several nodes
    ids = stored(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("z"))
                 .where("u < z").select("doc_id", "u"), "ids-of-several")
    if ids.limit(1).count():
        tied = rows.join(small_side(ids), "doc_id").select("u", F.col("node").alias("v"))
        label = components(tied.unionByName(label.select(F.col("component").alias("u"), F.col("node").alias("v"))).distinct())
    out = rows.join(label, "node", "left").join(small_side(again.withColumn("again", F.lit(True))), "raw", "left")
    return out.select("doc_id", "row", "raw", "n_shingles", F.coalesce("component", "node").alias("component"),
                      (~F.col("copied") & F.col("component").isNull()).alias("alone"),
                      F.coalesce("again", F.lit(False)).alias("again"))


def _linked(src: DataFrame, own: DataFrame, again: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of the linked nodes; ``own`` has each node's raw,
    n_shingles and keys."""
    banded = own.select("node", F.posexplode("keys").alias("band", "key"))
    bucket = _star(banded, "buckets")
    live = stored(banded.join(bucket, "key"), "bucket-rows")

    # the nodes that share a bucket: their keys, set sizes and texts
    near = stored(live.select("node").distinct(), "near")
    members = stored(sieve(near)(own, "node")[0].join(near, "node", "left_semi")
                     .select("node", "raw", F.col("n_shingles").alias("n"), "keys"), "bucket-nodes")
    wanted = members.select("raw", "node")
    text = sieve(wanted.select("raw"))(src.select("raw", "text"), "raw")[0]
    once = text.join(wanted.join(again, "raw", "left_anti"), "raw").select("node", "text")
    # of a row that is there many times, one text
    more = (text.join(again, "raw", "left_semi").groupBy("raw").agg(F.first("text").alias("text"))
            .join(wanted, "raw").select("node", "text"))
    texts = stored(once.unionByName(more), "bucket-texts")

    # stars in buckets of four, eight and sixteen coordinates
    wide = stored(members.select("node", "keys").mapInArrow(_wide_keys, "node long, keys array<long>")
                  .select("node", F.explode("keys").alias("key")), "wide-rows")
    pairs = live.select("a", F.col("node").alias("b")).unionByName(
        wide.join(_star(wide, "wide-buckets"), "key").select("a", F.col("node").alias("b"))).where("a < b").distinct()
    sizes = members.select(F.col("node").alias("a"), F.col("n").alias("na"))
    pairs = stored(pairs.join(sizes, "a").join(sizes.toDF("b", "nb"), "b").where(
        100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b"), "pairs")
    links = stored(_confirm(pairs, texts, k, percent), "links")
    label = components(links)

    # buckets that still hold several components
    coloured = stored(live.select("key", "band", "node").join(label, "node", "left").select(
        "key", "band", "node", F.coalesce("component", "node").alias("component")), "coloured-rows")
    shares = coloured.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = stored(shares.groupBy("key").agg(
        F.max(F.struct("n", "component"))["component"].alias("largest"), F.sum("n").alias("size"),
        (F.sum("n") - F.max("n")).alias("minor")).where("minor > 0"), "mixed-buckets")
    if mixed.limit(1).count():
        blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
        slot = lambda c: F.pmod(F.xxhash64("node"), blocks(c)).cast("int")
        rest = coloured.join(mixed, "key")
        # rows of the smaller components against all rows, block by block
        all_ = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
        left = rest.where("component != largest").select(
            "key", "band", "node", "component", F.lit(True).alias("left"), slot("minor").alias("i"), all_("size").alias("j"))
        right = rest.select(
            "key", "band", "node", "component", F.lit(False).alias("left"), all_("minor").alias("i"), slot("size").alias("j"))
        both = left.unionByName(right)
        # the few more that the sieve lets through are in no bucket of these
        judged = stored(rest.select("node").distinct(), "judged")
        signed = stored(sieve(judged)(texts.select("node", "text"), "node")[0]
                        .mapInArrow(_signatures(k), "node long, sig binary"), "signatures")
        n = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = (both.join(signed, "node").join(members.drop("raw"), "node")
                 .select("key", "i", "j", "band", "left", "node", "n", "component", "keys", "sig")
                 .repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
                 .mapInArrow(_across(percent), "a long, b long"))
        fresh = stored(found.distinct().join(pairs, ["a", "b"], "left_anti"), "pairs-across")
        more = stored(_confirm(fresh, texts, k, percent), "links-across")
        if more.limit(1).count():
            label = components(links.unionByName(more))

    return label


def groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    c = stored(_classes(docs, k, percent, id_col, text_col), "classes")
    shared = c.where(~F.col("alone"))
    least = stored(shared.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least-ids")
    out = shared.join(least, "component").select("doc_id", "n_shingles", "component_id").unionByName(
        c.where("alone").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component (of the least id, null ids last) and all rows
    without words; all columns of ``docs``."""
    every = stored(_classes(docs, k, percent, "doc_id", "text"), "classes")
    c = every.where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")
    shared = c.where(~F.col("alone"))
    kept = stored(shared.groupBy("component").agg(F.min(order)["raw"].alias("first")), "first-rows")
    gone = stored(shared.join(kept, "component").where("raw <> first").select("raw").distinct(), "dropped")
    again = stored(c.where("again").select("raw").distinct(), "repeated")
    # the key rides along under a name that no column has
    key = next(n for n in ("row_key", *(f"row_key_{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns)
    # documents that surely are neither dropped nor repeated stay where they
    # are; of the others, the keys that stay are worked out first
    odd = sieve(gone.unionByName(again))
    may, left = odd(docs.withColumn(key, row_key(F.col("doc_id").cast("long"), F.col("text"))), key)
    stays = stored(odd(every.select("raw"), "raw")[0].join(gone, "raw", "left_anti").distinct(), "stays")
    may = sieve(stays)(may, key)[0].join(stays.withColumnRenamed("raw", key), key, "left_semi")
    if again.limit(1).count():
        twice = again.withColumnRenamed("raw", key)
        may = may.join(twice, key, "left_anti").unionByName(may.join(twice, key, "left_semi").dropDuplicates([key]))
    return left.unionByName(may).drop(key)
