"""BPE (7), language ID (5) and language-model scoring (8)."""

import collections
import hashlib
import math
import random
import zlib

import pytest

from shelfmark.llm import bpe, langid, lm
from shelfmark.llm.queries import tokenizer_path

from .conftest import EDGES, documents

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids


def test_bpe_equals_the_library(llm, library):
    rng = random.Random(5)
    pieces = list("aAbsStlLm'`’!?.,0129 \t\n\x0b\x1c\x1d\x85\xa0ÀéßñİıΣςσ漢字カナ한글🙂٣Ⅻ²-_") + [
        "<|endoftext|>", "<|startoftext|>", "'re", "'ll", " 's", "qzx", "zzq"]
    rows = EDGES + [(100 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    got = bpe.encode(documents(llm, rows), PATH).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got), key=key) == sorted(
        ((i, *expected(library, t)) for i, t in rows), key=key)
    assert bpe.encode(documents(llm, EDGES).limit(0), PATH).count() == 0


def test_cuts_are_certain(library):
    """No token holds a pair that is cut, and cutting changes no id."""
    enc = bpe.Encoder(PATH)
    rng = random.Random(6)
    some = 0
    for _ in range(3000):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 12)))
        parts = enc.cuts(word)
        some += len(parts) > 1
        assert "".join(parts) == word
        assert list(enc.encode_word(word)) == library.encode(word, add_special_tokens=False).ids
    assert some > 100


TONGUES = {"xx": "ban dol mik ras ton", "yy": "uvé øla åre iyo eau", "zz": "sch pfl trz nkh gst"}


def speech(lang, rng, n=60):
    return " ".join("".join(rng.choice(TONGUES[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_of_held_out_texts(llm):
    rng = random.Random(7)
    rows = [(i, speech(x := rng.choice(list(TONGUES)), rng), x) for i in range(600)]
    rows += [(1000 + i, t, None) for i, (_, t) in enumerate(EDGES)] + [(None, speech("xx", rng), "xx"), (5000, "12 34 !!", "xx")]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'q' AS id", "'q' AS score")
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text, lang in rows[:600]:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(by[i].lang_pred, x) for i, _, x in rows[:600] if by[i].held_out]
    assert sum(a == b for a, b in held) >= 0.98 * len(held) > 50
    assert all(0 <= r.score <= 1 for r in got)
    assert by[5000].lang_pred == "und" and by[1000].lang_pred == "und" and by[1001].lang_pred == "und"
    assert langid.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_language_model(llm, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 500)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 20 + i % 250]) for _ in range(rng.randint(0, 60)))) for i in range(500)]
    rows += [(1000 + i, t if t is None or len(t) < 1000 else t[:3000]) for i, (_, t) in enumerate(EDGES)]
    got = {r.doc_id: r for r in lm.scores(documents(llm, rows)).collect()}
    assert len(got) == len(rows)
    c = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    base = score = 0.0
    for i, t in rows:
        w, r = tokens(t), got[i]
        held = zlib.crc32(str(i).encode()) % 10 == 0
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r.score < 0
        if held:
            base, score = base + r.base_score, score + r.score
    assert score >= base * 1.02                       # about as good or better, never far worse
    empty = lm.scores(documents(llm, rows).limit(0))
    assert empty.count() == 0


def test_scores_equal_the_model_written_out(llm, monkeypatch):
    """Counts, histogram and mixture recomputed with plain dictionaries; the
    setting for Arrow batches stays as it was."""
    import numpy as np
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 300)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[:rng.choice([5, 60])]) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(None, "w1 W2 w3"), (7, "w1 w1 w9"), (8, None)]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10

    def counts(keep):
        uni, bi, docs = collections.Counter(), collections.Counter(), 0
        for i, t in rows:
            if keep(fold(i)):
                w = tokens(t)
                uni.update(w)
                bi.update(zip([None, *w], w))
                docs += 1
        return uni, bi, docs
    main, every = counts(lambda f: f > 1), counts(lambda f: f > 0)
    bucket = lambda c: 0 if not c else 1 + int(math.log2(c))
    bin_ = lambda p: round(-math.log2(p) * lm.BINS) if p else -1
    cells = collections.Counter()
    n = sum(main[0].values())
    for i, t in rows:
        if fold(i) == 1:
            w = tokens(t)
            for u, x in zip([None, *w], w):
                c = main[2] if u is None else main[0][u]
                cells[bucket(c), bin_(main[1][u, x] / max(c, 1)), bin_(main[0][x] / n)] += 1
    weights = lm.learn_weights(sorted((*k, m) for k, m in cells.items()), len(main[0]))
    n, v = sum(every[0].values()), len(every[0])

    def score(t):
        w, out = tokens(t), 0.0
        for u, x in zip([None, *w], w):
            c = every[2] if u is None else every[0][u]
            a, b, z = weights[bucket(c)]
            out += math.log10(a * every[1][u, x] / max(c, 1) + b * every[0][x] / n + z / (v + 1))
        return out
    before = llm.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = lm.scores(documents(llm, rows)).collect()
    assert llm.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    key = lambda x: (str(x[0]), x[1])
    for (i, s), (j, want) in zip(sorted(((r.doc_id, r.score) for r in got), key=key),
                                 sorted(((i, score(t)) for i, t in rows), key=key)):
        assert i == j and s == pytest.approx(want, rel=1e-9)
    assert np.allclose(weights.sum(axis=1), 1)


def test_model_sums_to_one():
    """Interpolated probabilities of all words after a context sum to one
    (the uniform share leaves room for one unseen word)."""
    import numpy as np
    text = "a b a c a b b c a"
    words = tokens(text)
    uni = collections.Counter(words)
    bi = collections.Counter(zip(words, words[1:]))
    n, v = sum(uni.values()), len(uni)
    weights = lm.learn_weights([(lm.context_bucket(np.array([4.0]))[0], 4, 8, 30)], v)[lm.context_bucket(np.array([uni[b"a"]]))[0]]
    total = sum(weights[0] * bi[b"a", w] / uni[b"a"] + weights[1] * uni[w] / n + weights[2] / (v + 1) for w in uni)
    assert total + weights[2] / (v + 1) == pytest.approx(1)


def test_expectation_maximisation_prefers_what_predicts():
    cells = [(3, 0, 40, 1000), (5, -1, 8, 1000)]      # bucket 3: the bigram is sure; 5: never seen
    w = lm.learn_weights(cells, 1 << 20)
    assert w[3][0] > 0.95 and w[5][1] > 0.9 and w[5][0] < 0.05
    assert abs(w.sum(axis=1) - 1).max() < 1e-9


def test_packing_round_trip():
    import numpy as np
    for x in ([], [0], [1, 2, 2**63], list(range(1000))):
        x = np.array(x, dtype=np.uint64)
        assert (lm.unpack(lm.pack(x)) == x).all() and (lm.unpack_sorted(lm.pack_sorted(x)) == x).all()
