"""Language identification with string kernels (operator 5).

The kernel of two texts counts the character n-grams (n = 1, 2, 3, blended)
that both contain, whatever their number (presence), divided by the root of
the two set sizes. Landmarks, a few texts of every language, give the
Nystroem features: z(x) = K(x, L) K(L, L)^(-1/2). One-versus-rest kernel
ridge regression on z learns one weight vector a language. As the kernel is
a product of presence vectors, landmarks, whitening and weights fold into
one matrix over hashed n-grams, and a batch of texts is scored by one matrix
product of its presence rows with that matrix.

The model is fitted on a bounded sample (``fit_rows`` training texts and
``landmarks`` of them, both taken by hash); every whole text is scored.

Defined results: a null text or one without a letter is 'und' with score 0;
texts of null language are never learned from; without any training text all
results are 'und'; ties go to the smaller language name; rows with equal ids
are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket, spread

#: n-grams are hashed into so many bits; code points are packed before that.
BITS = 16
ORDERS = (1, 2, 3)
#: Bounds of the sample: texts learned from, landmarks among them.
FIT_ROWS, LANDMARKS = 1_500, 160
RIDGE = 1e-3
#: Presence rows in one matrix product.
ROWS = 64

LETTER = regex.compile(r"\p{L}")
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def presence(text: str) -> np.ndarray:
    """The sorted hashed n-grams that occur in a lower-cased whole text."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    seen = np.zeros(1 << BITS, dtype=bool)
    for n in ORDERS:
        if len(c) < n:
            break
        h = np.full(len(c) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            h += c[i:len(c) - n + 1 + i] * np.uint64(_MULT[i])
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        seen[h >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(seen)


def _dense(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), 1 << BITS), dtype=np.float32)
    for i, r in enumerate(rows):
        out[i, r] = 1
    return out


class Model:
    """Languages (sorted) and one matrix over hashed n-grams."""

    def __init__(self, langs: list[str], matrix: np.ndarray):
        self.langs, self.matrix = langs, matrix

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        size = np.sqrt(np.maximum([len(r) for r in rows], 1)).astype(np.float32)
        return (_dense(rows) @ self.matrix) / size[:, None]


def learn(rows: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS) -> Model:
    """Nystroem features from evenly drawn landmarks, then ridge regression
    with targets 1 (the language) and 0 (the rest)."""
    names = sorted(set(langs))
    by = [[i for i, x in enumerate(langs) if x == n] for n in names]
    # round robin over the languages, in the sample's order
    order = [own[k] for k in range(max(map(len, by), default=0)) for own in by if k < len(own)]
    chosen = order[:landmarks]
    size = np.sqrt(np.maximum([len(r) for r in rows], 1))
    marks = _dense([rows[i] for i in chosen]) / size[chosen][:, None].astype(np.float32)
    kernel = np.vstack([(_dense(rows[i:i + ROWS]) @ marks.T) / size[i:i + ROWS][:, None]
                        for i in range(0, len(rows), ROWS)]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    strong = values > 1e-8 * max(values.max(), 1e-12)
    white = vectors[:, strong] / np.sqrt(values[strong])
    z = kernel @ white
    targets = np.array([[float(x == n) for n in names] for x in langs])
    # each language weighs the same
    w = np.array([1 / langs.count(x) for x in langs]) * len(langs) / len(names)
    weights = np.linalg.solve(z.T @ (z * w[:, None]) + RIDGE * len(rows) * np.eye(z.shape[1]),
                              z.T @ (targets * w[:, None]))
    return Model(names, (marks.T.astype(np.float64) @ (white @ weights)).astype(np.float32))


def held_out(id_col: Column) -> Column:
    return bucket(id_col, 4) == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """A model from at most ``fit_rows`` texts that are not held out."""
    d = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    pool = d.where(~held_out(F.col("id")) & F.col("lang").isNotNull())
    # ids first: the sort then carries no texts; at most fit_rows of them
    ids = pool.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    picked = pool.where(F.col("text").isNotNull()).join(F.broadcast(ids), "id")

    def run(batches):
        for b in batches:
            grams = [presence(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("lang"), pa.array(grams, pa.list_(pa.int32()))],
                names=["id", "lang", "grams"])

    schema = T.StructType([d.schema["id"], T.StructField("lang", T.StringType()),
                           T.StructField("grams", T.ArrayType(T.IntegerType()))])
    found = (spread(picked).mapInArrow(run, schema).orderBy(F.xxhash64("id"), "id", "lang", "grams")
             .limit(fit_rows).toArrow())
    if not len(found):
        return None
    return learn([np.asarray(g.values) for g in found.column("grams")],
                 found.column("lang").to_pylist(), landmarks)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every whole text."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                      held_out(F.col(id_col)).alias("held_out"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            lang, score = ["und"] * b.num_rows, [0.0] * b.num_rows
            rows, at = [], []

            def flush():
                for i, s in zip(at, model.scores(rows)):
                    k = int(np.argmax(s))
                    lang[i], score[i] = model.langs[k], float(min(1.0, max(0.0, s[k])))
                rows.clear()
                at.clear()

            for i, t in enumerate(b.column("text") if model else ()):
                t = t.as_py()
                if t and LETTER.search(t):
                    rows.append(presence(t))
                    at.append(i)
                    if len(rows) == ROWS:
                        flush()
            if rows:
                flush()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()),
                 pa.array(score, pa.float64())], names=schema.names)

    return src.mapInArrow(run, schema)
