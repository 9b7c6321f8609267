"""SentencePiece (12), hard negatives (11) and the divergence audit (13)."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from shelfmark.llm import divergence, negatives, sentences
from shelfmark.llm.queries import SQL, op11_hard_negatives, op13_source_divergence, tokenizer_path

from .conftest import CLASHING, EDGES, SF, documents

MODEL = tokenizer_path("piece_bpe_32k.model")


# --- SentencePiece --------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def spelled(library, n, seed):
    rng = random.Random(seed)
    some = list("abcdefghij ▁ \n\t\r\x0b0123 <>.,'éßñ漢字カナ한글🙂\x00​ ²") + [
        "   ", " " * 17, "<s>", "<unk>", "<0x0A>", " the", "tion", "http://", "====", "xxxx"]
    some += [library.id_to_piece(rng.randrange(259, 32000)).replace("▁", " ") for _ in range(2000)]
    return ["".join(rng.choice(some) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_encoding_equals_the_library(library):
    m = sentences.Model(MODEL)
    for text in [*spelled(library, 3000, 1), "x" * 20_000, " " * 3000, "漢字" * 3000, "ab" * 9000]:
        ids = library.encode(text)
        assert m.encode(text) == ids, text
        assert m.decode(ids) == library.decode(ids)


def test_decoding_of_any_ids(library):
    m, rng = sentences.Model(MODEL), random.Random(2)
    for _ in range(2000):
        ids = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(259) for _ in range(rng.randint(0, 8))]
        assert m.decode(ids) == library.decode(ids), ids


def test_backtracking_is_needed_and_neighbours_are_compatible(library):
    """Longest matches alone would differ; every pair re-merges to itself."""
    m, greedy_differs = sentences.Model(MODEL), 0
    for text in spelled(library, 500, 3):
        for chunk in m.parts(text):
            pieces = m.split(chunk)
            assert "".join(pieces) == chunk and m.merged(chunk) == pieces
            assert all(m.merged(a + b) == [a, b] for a, b in zip(pieces, pieces[1:]))
            longest = next(n for n in range(len(chunk), 0, -1) if n == 1 or chunk[:n] in m.ids)
            greedy_differs += len(pieces[0]) != longest
    assert greedy_differs > 20


def test_cuts_are_where_no_piece_spans():
    m = sentences.Model(MODEL)
    assert m.parts("Hi  there, 12\nx") == ["▁Hi", "▁▁there", ",", "▁", "1", "2", "\n", "x"]
    assert sentences.cuts(["a▁b", "▁a"]) is None
    cut = sentences.cuts(["ab", "b.", "▁a"])  # a piece joins a letter to a dot
    assert cut.findall("aab.▁a") == ["aa", "b.", "▁a"] or "".join(cut.findall("aab.▁a")) == "aab.▁a"


def test_chunks_are_bounded(monkeypatch, library):
    monkeypatch.setattr(sentences, "MEMORY", 8)
    m = sentences.Model(MODEL)
    for text in spelled(library, 100, 4):
        ids = library.encode(text)
        assert m.digests(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                   hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert len(m.chunks) <= 8 and len(m.pairs) <= 8


def test_sentencepiece_over_documents(llm, library):
    rows = EDGES + [(100 + i, t) for i, t in enumerate(spelled(library, 100, 5))]

    def want(text):
        ids = library.encode(text or "")
        return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(library.decode(ids).encode()).hexdigest(), ids)
    key = lambda x: tuple(map(str, x))
    got = sentences.encode(documents(llm, rows), MODEL).collect()
    assert sorted(map(tuple, got), key=key) == sorted(((i, *want(t)) for i, t in rows), key=key)
    assert sentences.encode(documents(llm, EDGES).limit(0), MODEL).count() == 0
    assert sentences.encode(documents(llm, EDGES), MODEL, keep_ids=False).columns == [
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


# --- hard negatives -------------------------------------------------------

def mined(rows, positives=5, k=10, low=30, high=90):
    """All scores of all rows, sorted."""
    part = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, v, label in part:
        if i % 100:
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in part]
        near = sorted((s, j) for s, j, other in score if other == label and j != i)[:positives]
        for ps, p in near:
            fit = sorted((s, j) for s, j, other in score if other != label and low * -ps <= 100 * -s <= high * -ps)[:k]
            out += [(i, p, r, j, -ps, -s) for r, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def vectors(spark, rows):
    from pyspark.sql import functions as F
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns(
        {c: F.lit(c) for c in [*CLASHING, "slab", "v", "c1", "anchor", "slot"]})


def run_negatives(df):
    from pyspark.sql import functions as F
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, label=label).collect()))


@pytest.mark.parametrize("width, rows", [(3, 1500), (8, 900)])
def test_negatives_equal_all_scores(llm, monkeypatch, width, rows):
    """Small tiles, leaves, blocks and waves; few values, so many ties."""
    for name, size in (("TILE", 128), ("LEAF", 8), ("FANOUT", 3), ("BLOCK", 3), ("WAVE", 5)):
        monkeypatch.setattr(negatives, name, size)
    rng = random.Random(width)
    data = [(i, [rng.choice([-0.5, 0.25, 0.1, 0.9, rng.random()]) for _ in range(width)], rng.randrange(10))
            for i in range(rows)]
    # a third of all rows are one vector
    data += [(rows + i, [0.5] * width, i % 10) for i in range(rows // 2)]
    data += [(100, [0.7] * width, 3), (5, None, 1), (None, [1.0] * width, 1), (9001, [math.nan] + [0.0] * (width - 1), 2),
             (9002, [None] * width, 2), (9003, [math.inf] * width, 2), (9004, [0.3] * width, None), (9100, [], 4),
             (9101, [0.4], 4), (9200, [-1.0] * width, 5)]
    rng.shuffle(data)
    got, want = run_negatives(vectors(llm, data)), mined([(i, v, k) for i, v, k in data])
    # an id that repeats is two anchors with windows of their own
    assert got == want and len(got) > 300


def test_negatives_prune_boxes():
    """The queue visits the leaves that can matter and no others."""
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.random((4096, 2)))
    order = np.concatenate([p[np.argsort(v[p, 1])] for p in np.array_split(np.argsort(v[:, 0]), 4)])
    row = {"ids": np.arange(4096, dtype="<i8").tobytes(), "labels": np.zeros(4096, "<i8").tobytes(),
           "vectors": v[order].astype("<i8").tobytes()}
    tile = negatives.Packed(row, 2, "<i8", True)
    tree = negatives.Tree(tile)
    visited = []

    def fits(i, rows):
        visited.append(rows.start // negatives.LEAF)
        return np.ones(len(tile.ids[rows]), dtype=bool)
    best, window = negatives.Best(10), negatives.Best(10, 100, 900)
    anchor = np.array([[3.0, 1.0]])
    negatives.search(tree, anchor, [[best]], fits)
    assert len(set(visited)) <= tree.leaves // 2
    scores = (tile.v @ anchor[0])
    assert list(best.scores) == sorted(scores, reverse=True)[:10]
    negatives.search(tree, anchor, [[window]], fits)
    assert list(window.scores) == sorted(scores[(scores >= 100) & (scores <= 900)], reverse=True)[:10]


def test_negatives_of_huge_numbers_and_empty_tables(llm):
    big = [(i, [float(i % 13 - 6) * 1e6, 1e6, 3.0], i % 3) for i in range(300)]
    assert run_negatives(vectors(llm, big)) == mined(big)
    assert run_negatives(vectors(llm, big).limit(0)) == []
    assert run_negatives(vectors(llm, [(1, [0.1], 2), (2, [0.2], 3)])) == []


def test_negatives_query_equals_its_sql(llm):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(SQL["op11_hard_negatives"]).fetchall())
    cols = [d[0] for d in con.description]
    got = op11_hard_negatives(llm, SF)
    assert sorted(map(tuple, got.select(*cols).collect())) == want and want


# --- divergence -----------------------------------------------------------

def audited(rows, min_docs=3, top=200):
    lang_docs, group, langs = collections.Counter(), {}, collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        group.setdefault((lang, source), collections.Counter()).update(found)
        langs[lang].update(found)
        lang_docs.update((lang, t) for t in set(found))
    out = []
    for (lang, source), n in group.items():
        kept = [t for t in langs[lang] if lang_docs[lang, t] >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = share(n), share(langs[lang])
        pairs = []
        for (other_lang, other), m in group.items():
            if other_lang == lang and other != source:
                r = share(m)
                pairs.append((-sum((p[t] - r[t]) ** 2 // r[t] for t in kept), other.encode(), other))
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if n[t] and p[t] > q[t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item, -v, r) for r, (v, _, item) in enumerate(items, 1)]
    return sorted(out)


def audit_rows(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "näh", "NÄH", "漢字", "x1y", "a_b", "don't", "🙂", "zz top", "\x7f", "İ", "éa", "ea", ""] + [
        "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 3))) for _ in range(150)]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, "xx"])
        source = rng.choice(["s1", "s1", "s1", "s2", "ß", "Z", None, ""])
        text = rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))])
        rows.append((lang, source, text))
    return rows + [("lone", "s1", "rare words alone"), ("lone", "s2", None), ("one", "s1", "a a a a"), rows[0], rows[0]]


def test_audit_equals_brute_force(llm, monkeypatch):
    from pyspark.sql import functions as F
    for name, size in (("TABLE", 50), ("SLICE_TERMS", 7), ("SLICE_COUNTS", 40), ("WALK", 16)):
        monkeypatch.setattr(divergence, name, size)
    rows = audit_rows(1, 250)
    df = llm.createDataFrame(rows, "lang string, source string, text string").withColumns(
        {c: F.lit(c) for c in [*CLASHING, "term", "docs", "by", "total", "v", "item", "value", "rank", "part"]})
    got = divergence.audit(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audited(rows)
    assert sorted(map(tuple, divergence.audit(df, top=3).collect())) == audited(rows, top=3)
    assert divergence.audit(df.limit(0)).count() == 0


def test_trees_share_equal_subtrees():
    """Equal subtrees are one node, and equal node pairs are priced once."""
    counts = np.zeros((3, 1024), dtype=np.int64)
    counts[0, 5] = counts[1, 5 + 512] = 4
    roots, levels, values = divergence.tree(counts)
    assert sum(len(lo) for lo, _ in levels) <= 3 * 10  # of 3 * 1023
    k, a, b, m = divergence.walk(roots, levels, np.array([0, 0]), np.array([1, 2]))
    assert sorted(zip(k, values[a], values[b], m)) == [
        (0, 0, 0, 1022), (0, 0, 4, 1), (0, 4, 0, 1), (1, 0, 0, 1023), (1, 4, 0, 1)]


def test_prices_of_large_counts_and_a_slice_of_any_width():
    rng = random.Random(7)
    for width in (1, 2, 3, 13):
        counts = np.array([[rng.choice([0, 1, 7, 10**11]) for _ in range(width)] for _ in range(4)], dtype=np.int64)
        totals = counts.sum(axis=1) + width
        got = {}
        for i, j, value in divergence.prices(counts, totals, np.arange(4)):
            got |= {(x, y): v for x, y, v in zip(i.tolist(), j.tolist(), value.tolist())}
        p = [[1 + 10**9 * (int(c) + 1) // int(t) for c in row] for row, t in zip(counts, totals)]
        assert got == {(i, j): sum((x - y) ** 2 // y for x, y in zip(p[i], p[j]))
                       for i in range(4) for j in range(4) if i != j}


def test_audit_query_equals_its_sql(llm):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(SQL["op13_source_divergence"]).fetchall())
    cols = [d[0] for d in con.description]
    assert sorted(map(tuple, op13_source_divergence(llm, SF).select(*cols).collect())) == want and want
