"""Language-model scoring with deleted interpolation (operator 8).

Tokens are a text's words (A-Z lower-cased) and one end. The model mixes the
maximum-likelihood estimates of the bigram and of the unigram with a uniform
share,

    P(w | u) = l2 c(u,w)/c(u) + l1 c(w)/N + l0 / (V + 1),

with weights (l2, l1, l0) for each bucket of the context's frequency c(u)
(powers of two). Weights are learned by expectation-maximisation on the
counts of a deleted part of the training documents, against counts of the
others; scoring then uses the counts of all training documents.

How the counts travel: the corpus is rewritten once as compressed blocks of
documents (a bounded number of tokens each). A block counts its distinct
n-grams (64-bit hashes) and sends them, sorted, delta-coded and packed, to
hash ranges, so that a frequent n-gram sends one entry a block. Each range
adds them up and answers each block with the totals in the order of its
request; blocks are then scored against their answers. Nothing but sums
reaches the driver: N, V and a histogram of bounded size for the weights.

Defined results: a null or empty text is its end alone; rows with equal ids
are counted and scored one by one; without training text the model is the
uniform share (base: 0.1 / (0.1 * 1)); an empty table gives an empty result;
only the id and text columns are read.
"""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, spread, stored
from .hashing import Hashes, mix

#: Documents whose remainder is HELD_OUT aren't learned from; those of
#: DELETED give the weights.
FOLDS, HELD_OUT, DELETED = 10, 0, 1
#: Tokens in a block (a longer document is a block by itself), and entries
#: that one hash range takes on average.
BLOCK_TOKENS, RANGE_ENTRIES = 1_000_000, 400_000
#: Steps of expectation-maximisation; histogram bins for a factor of two.
STEPS, BINS = 40, 4
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_BI = np.uint64(0x9E3779B97F4A7C15)


# --- packing --------------------------------------------------------------

def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    x = np.ascontiguousarray(x, dtype="<u8")
    if not len(x):
        return b""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + len(x).to_bytes(4, "little") + pa.compress(
        np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes | None) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    width, n = data[0], int.from_bytes(data[1:5], "little")
    planes = np.frombuffer(pa.decompress(data[5:], decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = planes.reshape(width, n).T
    return out.view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes | None) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


# --- blocks ---------------------------------------------------------------

BLOCK = "block string, role int, tokens long, docs long, data binary"


def _fold(r: int) -> int:
    """0: held out, 1: deleted part, 2: the other training documents."""
    return 0 if r == HELD_OUT else 1 if r == DELETED else 2


def _blocks(batches):
    """Documents of one role together, up to BLOCK_TOKENS tokens."""
    open_: dict[int, list] = {}
    sizes = {0: 0, 1: 0, 2: 0}

    def close(role):
        docs, size = open_.pop(role), sizes[role]
        sizes[role] = 0
        raw = json.dumps(docs, ensure_ascii=False).encode("utf-8")
        data = len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), pa.array([role], pa.int32()), pa.array([size], pa.int64()),
             pa.array([len(docs)], pa.int64()), pa.array([data], pa.binary())],
            names=["block", "role", "tokens", "docs", "data"])

    for b in batches:
        for i, r, t in zip(*(b.column(c).to_pylist() for c in ("id", "r", "text"))):
            role, n = _fold(r), len(t.encode("utf-8").split()) + 1 if t else 1
            if sizes[role] and sizes[role] + n > BLOCK_TOKENS:
                yield close(role)
            open_.setdefault(role, []).append((i, t))
            sizes[role] += n
    for role in list(open_):
        yield close(role)


def _documents(data: bytes) -> list:
    size = int.from_bytes(data[:8], "little")
    return json.loads(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True))


class Tokens:
    """The tokens of a block's documents: hashes of tokens and of bigrams,
    and the number of the document of each."""

    def __init__(self, texts: list[str | None]):
        words = [t.encode("utf-8").lower().split() if t else [] for t in texts]
        flat = [w for ws in words for w in ws]
        raw = np.frombuffer(b" ".join([*flat, b""]), dtype=np.uint8)
        stop = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1)
        begin = np.concatenate([[0], stop[:-1]]).astype(np.int64) if len(flat) else stop
        h = mix(Hashes(raw).of(begin, stop)) if len(flat) else np.zeros(0, np.uint64)
        counts = np.array([len(ws) for ws in words], dtype=np.int64)
        ends = np.cumsum(counts + 1) - 1
        self.n = len(texts)
        total = int(counts.sum()) + len(texts)
        self.token = np.full(total, END, dtype=np.uint64)
        inner = np.ones(total, dtype=bool)
        inner[ends] = False
        self.token[inner] = h
        self.context = np.full(total, START, dtype=np.uint64)
        self.context[1:] = self.token[:-1]
        self.context[ends[:-1] + 1] = START
        if total:
            self.context[0] = START
        self.bigram = mix(self.context * _BI + self.token)
        self.doc = np.repeat(np.arange(len(texts)), counts + 1)


# --- counting -------------------------------------------------------------

def _requests(ranges: int):
    """Each block's distinct tokens (kind 0) and bigrams (kind 1) with their
    counts, by hash range."""
    shift = np.uint64(64 - int(math.log2(ranges)))

    def run(batches):
        for b in batches:
            for block, role, data in zip(*(b.column(c).to_pylist() for c in ("block", "role", "data"))):
                t = Tokens([x for _, x in _documents(data)])
                for kind, x in ((0, t.token), (1, t.bigram)):
                    keys, counts = np.unique(x, return_counts=True)
                    part = (keys >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)
                    edge = np.searchsorted(part, np.arange(ranges + 1))
                    got = [k for k in range(ranges) if edge[k] < edge[k + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(got), pa.int32()), pa.array(got, pa.int64()),
                         pa.array([block] * len(got)), pa.array([role] * len(got), pa.int32()),
                         pa.array([pack_sorted(keys[edge[k]:edge[k + 1]]) for k in got], pa.binary()),
                         pa.array([pack(counts[edge[k]:edge[k + 1]]) for k in got], pa.binary())],
                        names=["kind", "range", "block", "role", "keys", "counts"])
    return run


def _answer(group: pa.Table) -> pa.Table:
    """Totals of one hash range: for each request its keys' counts in all
    training documents, and for the deleted part's those without it; and one
    row with the number of distinct keys in training."""
    roles = group.column("role").to_pylist()
    keys = [unpack_sorted(x) for x in group.column("keys").to_pylist()]
    counts = [unpack(x) for x in group.column("counts").to_pylist()]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    main, deleted = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    edge = np.cumsum([0, *map(len, keys)])
    for i, role in enumerate(roles):
        if role:
            np.add.at(main if role == 2 else deleted, place[edge[i]:edge[i + 1]], counts[i].astype(np.int64))
    total = main + deleted
    at = [place[edge[i]:edge[i + 1]] for i in range(len(roles))]
    kind, rng = group.column("kind")[0].as_py(), group.column("range")[0].as_py()
    n = len(roles)
    return pa.table({
        "block": pa.array([*group.column("block").to_pylist(), None], pa.string()),
        "kind": pa.array([kind] * (n + 1), pa.int32()), "range": pa.array([rng] * (n + 1), pa.int64()),
        "total": pa.array([*(pack(total[x]) for x in at), None], pa.binary()),
        "main": pa.array([*(pack(main[x]) if r == 1 else None for x, r in zip(at, roles)), None], pa.binary()),
        "distinct": pa.array([None] * n + [int((total > 0).sum())], pa.int64()),
        "distinct_main": pa.array([None] * n + [int((main > 0).sum())], pa.int64())})


ANSWER = "block string, kind int, range long, total binary, main binary, distinct long, distinct_main long"


def _counts_of(answers: list, field: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a block's distinct tokens and bigrams, in key order."""
    out = []
    for kind in (0, 1):
        parts = [unpack(a[field]) for a in sorted((a for a in answers if a["kind"] == kind), key=lambda a: a["range"])]
        out.append(np.concatenate(parts).astype(np.float64) if parts else np.zeros(0))
    return out[0], out[1]


class Counted:
    """Per token: c(u,w), c(w) and c(u)."""

    def __init__(self, t: Tokens, answers: list, field: str, train_docs: int):
        uni, bi = _counts_of(answers, field)
        keys, at = np.unique(t.token, return_inverse=True)
        _, at2 = np.unique(t.bigram, return_inverse=True)
        if len(keys) != len(uni):
            raise ValueError("a block's answer has another length than its request")
        self.token, self.bigram = uni[at], bi[at2]
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[t.context == START] = train_docs


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2 c)."""
    return np.where(c > 0, 1 + np.floor(np.log2(np.maximum(c, 1))), 0).astype(np.int64)


# --- weights --------------------------------------------------------------

def _bin(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-300)) * BINS), -1).astype(np.int64)


def _histogram(n: int, docs: int):
    def run(batches):
        for b in batches:
            for data, answers in zip(b.column("data").to_pylist(), b.column("answers").to_pylist()):
                t = Tokens([x for _, x in _documents(data)])
                c = Counted(t, answers, "main", docs)
                f2 = c.bigram / np.maximum(c.context, 1)
                cells, counts = np.unique(np.stack(
                    [context_bucket(c.context), _bin(f2), _bin(c.token / max(n, 1))]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in cells), pa.array(counts.astype(np.int64))],
                                                 names=["b", "f2", "f1", "n"])
    return run


DEFAULT = (0.5, 0.4, 0.1)


def learn_weights(cells: list[tuple[int, int, int, int]], vocabulary: int, steps: int = STEPS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) for each context bucket, from
    (bucket, bin of f2, bin of f1, tokens)."""
    out = np.tile(np.array(DEFAULT), (66, 1))
    if cells:
        x = np.array(cells, dtype=np.float64)
        b = x[:, 0].astype(int)
        value = lambda c: np.where(c >= 0, 2.0 ** (-c / BINS), 0.0)
        p = np.stack([value(x[:, 1]), value(x[:, 2]), np.full(len(x), 1 / (vocabulary + 1))], axis=1)
        for _ in range(steps):
            share = out[b] * p
            share /= share.sum(axis=1, keepdims=True)
            gain = np.zeros((66, 3))
            np.add.at(gain, b, share * x[:, 3:4])
            # one token's worth of the default keeps every weight above 0
            out = (gain + np.array(DEFAULT)) / (gain.sum(axis=1, keepdims=True) + 1)
    return out


# --- scoring --------------------------------------------------------------

def _scorer(weights: np.ndarray, n: int, v: int, docs: int, kind):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        for b in batches:
            for role, data, answers in zip(*(b.column(c).to_pylist() for c in ("role", "data", "answers"))):
                rows = _documents(data)
                t = Tokens([x for _, x in rows])
                c = Counted(t, answers, "total", docs)
                w = weights[context_bucket(c.context)]
                p = (w[:, 0] * c.bigram / np.maximum(c.context, 1) + w[:, 1] * c.token / max(n, 1)
                     + w[:, 2] / (v + 1))
                base = np.log10((c.token + 0.1) / (n + 0.1 * (v + 1)))
                add = lambda x: np.bincount(t.doc, weights=x, minlength=t.n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in rows], kind), pa.array([role == 0] * t.n),
                     pa.array(np.bincount(t.doc, minlength=t.n).astype(np.int64)),
                     pa.array(add(c.token > 0).astype(np.int64)), pa.array([n] * t.n, pa.int64()),
                     pa.array(add(base)), pa.array(add(np.log10(p)))], names=names)
    return run


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    of every whole text."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), bucket(F.col(id_col), FOLDS).alias("r"),
                      F.col(text_col).alias("text"))
    blocks = stored(spread(src).mapInArrow(_blocks, BLOCK), "blocks")
    sums = {r.role: r for r in blocks.groupBy("role").agg(F.sum("tokens").alias("n"), F.sum("docs").alias("d")).collect()}
    tokens, texts = (lambda *roles: sum(sums[r].n for r in roles if r in sums)), (
        lambda *roles: sum(sums[r].d for r in roles if r in sums))
    ranges = 1 << max(4, math.ceil(math.log2(max(1, tokens(0, 1, 2) / RANGE_ENTRIES))))

    asked = blocks.select("block", "role", "data").mapInArrow(
        _requests(ranges), "kind int, range long, block string, role int, keys binary, counts binary")
    answers = stored(asked.groupBy("kind", "range").applyInArrow(_answer, ANSWER), "answers")
    sizes = answers.where("kind = 0").agg(F.sum("distinct").alias("v"), F.sum("distinct_main").alias("vm")).first()
    lists = answers.where("block is not null").groupBy("block").agg(
        F.collect_list(F.struct("kind", "range", "total", "main")).alias("answers"))

    part = blocks.where("role = 1").join(lists, "block").select("data", "answers")
    cells = (part.mapInArrow(_histogram(tokens(2), texts(2)), "b long, f2 long, f1 long, n long")
             .groupBy("b", "f2", "f1").agg(F.sum("n").alias("n")).collect())
    weights = learn_weights(sorted((r.b, r.f2, r.f1, r.n) for r in cells), sizes.vm or 0)

    run = _scorer(weights, tokens(1, 2), sizes.v or 0, texts(1, 2), pa.int64())
    return blocks.join(lists, "block").select("role", "data", "answers").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
