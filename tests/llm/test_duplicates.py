"""Near duplicates (2), repeated strings (9) and decontamination (1) against
brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from shelfmark.llm import decontaminate as D
from shelfmark.llm import neardup as N
from shelfmark.llm import suffixes as X

from .conftest import EDGES, documents


def shingles(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    """The component's number of every row."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            a, b = sets[i], sets[j]
            if (a and b and 100 * len(a & b) >= percent * len(a | b)) or rows[i][0] == rows[j][0] is not None:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def brute_groups(rows, k, percent):
    comp, least = brute_components(rows, k, percent), {}
    for c, (i, _) in zip(comp, rows):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [(i, len(shingles(t, k)), least.get(c), i == least.get(c)) for c, (i, t) in zip(comp, rows)]


def families(rng, n, edits):
    vocabulary = [f"v{i}" for i in range(4000)]
    for f in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 60, 150]))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            yield " ".join(w)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_groups(llm, k, percent, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)            # buckets over several blocks
    rng = random.Random(k)
    rows = [(100 + i, t) for i, t in enumerate(families(rng, 40, 4))]
    # a chain: neighbours are alike, its ends are not
    chain = [f"c{i}" for i in range(200)]
    rows += [(1000 + i, " ".join(chain[i * 3:i * 3 + 120])) for i in range(20)]
    rng.shuffle(rows)
    rows += EDGES
    docs = documents(llm, rows)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.groups(docs, k, percent).collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(brute_groups(rows, k, percent), key=key)


def test_one_of_each_group_stays(llm):
    rows = [(1, "a b c d e f g"), (2, "A B c d e f g"), (3, "other words than these here"), (None, "a b c d e f g"), (4, None)]
    docs = documents(llm, rows)
    left = N.deduplicated(docs)
    assert left.columns == docs.columns
    # the copy without an id goes too, the row without words stays
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4]
    assert N.groups(docs.limit(0)).count() == 0


def test_sketch_fills_and_estimates():
    rng = random.Random(4)
    words = [f"x{i}" .encode() for i in range(3000)]
    a = words[:1000]
    b = words[200:1200]                           # similarity 2/3 on single words
    one = [b"alone"]
    h, o = N.shingle_hashes([a, b, one, []], 1)
    s = N.sketch(h, o, 4)
    assert (s[:3] != np.uint64(2**64 - 1)).all() and (s[3] == np.uint64(2**64 - 1)).all()
    large = N.sketch(h, o, 4, 1024)
    assert abs((large[0] == large[1]).mean() - 2 / 3) < 0.06
    again = N.sketch(*N.shingle_hashes([list(reversed(a))], 1), 1)
    assert (again[0] == s[0]).all()
    del rng


def brute_repeats(texts):
    count = collections.Counter()
    raws = [(t or "").encode() for t in texts]
    for b in raws:
        for i in range(len(b) - 199):
            count[b[i:i + 200]] += 1
    for b in raws:
        mask = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i:i + 200]] > 1:
                mask[i:i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(b)) if mask[i] and (i == 0 or not mask[i - 1]))
        yield len(b), sum(mask), runs, hashlib.sha256(bytes(x for x, m in zip(b, mask) if not m)).hexdigest()


@pytest.mark.parametrize("hot", [X.HOT, 3])
def test_repeated_strings(llm, hot, monkeypatch):
    monkeypatch.setattr(X, "PIECE", 1500)         # long texts over several pieces
    rng = random.Random(9)
    noise = lambda n, s="fghij é": "".join(rng.choice(s) for _ in range(n))
    p = noise(700, "abcde ")
    line = "A line that stands in very many documents, é and all."
    texts = ["x" * 199, "y" * 200, "z" * 201, "ab" * 150, p, p[:350] + "#" + p[351:], p[100:450], "pre" + p[50:260], p, noise(5000)]
    texts += [noise(rng.randint(50, 300)) + line * rng.choice([1, 1, 2]) + noise(rng.randint(0, 300)) for _ in range(40)]
    texts += [noise(rng.randint(0, 99)) + p[a:a + rng.randint(150, 400)] + noise(99) for a in rng.sample(range(500), 30)]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(i, t if t is None else t[:4000]) for i, t in EDGES]
    got = X.repeated(documents(llm, rows), hot=hot).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == sorted(
        ((i, *e) for (i, _), e in zip(rows, brute_repeats([t for _, t in rows]))), key=key)
    assert X.repeated(documents(llm, rows).limit(0)).count() == 0


def test_suffix_order_and_collisions():
    rng = random.Random(10)
    for _ in range(60):
        data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(200)), dtype=np.uint8)
        start = np.array([rng.randrange(200) for _ in range(rng.randint(1, 30))])
        size = np.array([rng.randint(0, 200 - s) for s in start])
        order = X.suffix_order(X.Hashes(data), data, start, size)
        got = [bytes(data[start[i]:start[i] + size[i]]) for i in order]
        assert got == sorted(got)
    # base 1 makes permuted windows collide: the byte comparison notices
    a, b = b"ab" * 50 + b"c" * 100, b"ba" * 50 + b"c" * 100
    assert X.equal_windows([a, b], np.array([0, 0]), np.array([0, 0]), base=1) is None
    assert not X.equal_windows([a, b], np.array([0, 0]), np.array([0, 0])).any()


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_repeated_and_null_ids(llm, k, percent):
    """Ids with several texts, copies under null ids, rows that repeat: links
    are those of all texts, and one row of each component stays."""
    rng = random.Random(21)
    texts = list(families(rng, 25, 2))
    long_, longer = " ".join(f"q{i}" for i in range(60)), " ".join(f"q{i}" for i in range(61))
    rows = [(1, "one two three four five"), (1, long_), (2, longer)]
    rows += [(rng.choice([None, None, *range(100, 130)]), rng.choice(texts)) for _ in range(150)]
    rows += [(None, "copies without an id " * 3)] * 4 + [(500, texts[0])] * 3 + [(501, None), (501, texts[1]), (None, ""), (502, "")]
    docs = documents(llm, rows)
    want = brute_groups(rows, k, percent)
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, N.groups(docs, k, percent).collect()), key=key) == sorted(want, key=key)
    by = {i: c for i, _, c, _ in want if i is not None}
    assert by[1] == by[2] == 1
    left = N.deduplicated(docs, k, percent)
    assert left.columns == docs.columns
    comp = brute_components(rows, k, percent)
    got = [(r.doc_id, r.text) for r in left.collect()]
    place = collections.defaultdict(set)
    for c, row in zip(comp, rows):
        place[row].add(c)
    with_words = [c for c, (_, t) in zip(comp, rows) if shingles(t, k)]
    kept = [min(place[r]) for r in got if shingles(r[1], k)]
    assert sorted(kept) == sorted(set(with_words))       # one row of each
    assert sorted(got.count(r) for r in [(501, None), (None, ""), (502, "")]) == [1, 1, 1]
    for c, (i, _) in zip(comp, rows):                    # the least id's row
        ids = [j for d, (j, t) in zip(comp, rows) if d == c and j is not None and shingles(t, k)]
        stays = [j for j, t in got if shingles(t, k) and min(place[j, t]) == c]
        assert not ids or not stays or stays == [min(ids)]


def test_open_sketch_is_the_sketch():
    """A document's coordinates don't depend on those beside it, and agree
    with the rounds written out."""
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 3, 40, 500, 0, 7)]
    h, owner = np.concatenate(sets), np.repeat(np.arange(6), [len(x) for x in sets])
    got = N.sketch(h, owner, 6, 64)
    for i, x in enumerate(sets):
        alone = N.sketch(x, np.zeros(len(x), dtype=np.int64), 1, 64)[0]
        assert (got[i] == alone).all() and ((alone != N._NONE).all() or not len(x))
        want = {}
        for r in range(128):
            thrown = {}
            for v in (N.mix(x ^ N.times(r + 1, N._M1)) if len(x) else ()):
                b = int(v % np.uint64(64)) if r < 64 else r - 64
                thrown[b] = min(thrown.get(b, 1 << 64), int(v) >> 8)
            for b, v in thrown.items():
                want.setdefault(b, int(N.mix(np.array([v], dtype=np.uint64) + N.times(r, N._M2))[0]))
        assert [want.get(b, int(N._NONE)) for b in range(64)] == got[i].tolist()


def test_recall_of_near_copies(llm):
    """Every pair at or above the bound is linked (links are exact, so only
    missed ones can be wrong)."""
    rng = random.Random(22)
    rows = list(enumerate(families(rng, 120, 12)))
    comp = brute_components(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in N.groups(documents(llm, rows), 3, 85).collect()}
    assert [got[i] for i, _ in rows] == comp and len(set(comp)) < len(rows)


def moved_rows(df):
    """Rows that the plan of ``df`` sends through shuffles, once it ran."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            rows += node.metrics().get("shuffleRecordsWritten").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_only_documents_with_a_partner_move(llm, monkeypatch):
    """Where no side is broadcast for its size, documents that share no
    bucket, and those that surely stay, are not shuffled."""
    rng = random.Random(31)
    rows = [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))) for i in range(400)]
    rows += [(1000, rows[0][1]), (1001, rows[1][1] + " and"), (2, rows[2][1]), (2000, None)]
    stored, moved = N.stored, {}

    def spy(df, name):
        moved[name] = moved_rows(df)
        return stored(df, name)
    monkeypatch.setattr(N, "stored", spy)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {c: llm.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            llm.conf.set(c, v)
        left = N.deduplicated(documents(llm, rows))
        assert moved_rows(left) < 100 and moved["bucket-texts"] < 100 and moved["nodes"] < 100
    finally:
        for c, v in before.items():
            llm.conf.set(c, v)
    assert sorted(r.doc_id for r in left.collect()) == [*range(400), 2000]


def test_sieve(llm, monkeypatch):
    """No key is lost, few others pass; beyond its size, more pass."""
    from shelfmark.llm import common as C
    rows = llm.range(20_000).selectExpr("if(id % 100 = 1, null, id) as `an id`", "cast(id as string) as word_")
    keys = llm.range(0, 20_000, 10).selectExpr("if(id % 1000 = 10, null, id) as k")
    want = {i for i in range(0, 20_000, 10) if i % 1000 != 10}
    for words, most in ((C.SIEVE_WORDS, 900), (1, 20_000)):
        monkeypatch.setattr(C, "SIEVE_WORDS", words)
        may, other = C.sieve(keys)(rows, "an id")
        assert may.columns == other.columns == rows.columns
        may, other = ([r[0] for r in x.collect()] for x in (may, other))
        assert want <= set(may) and None not in may and len(may) - len(want) < most
        assert len(may) + len(other) == 20_000 and not want & set(other)
    assert C.sieve(keys.limit(0))(rows, "an id")[0].count() == 0


def test_one_of_each_group_stays_beyond_the_sieve(llm, monkeypatch):
    """With a filter that everything passes, the exact joins decide."""
    from shelfmark.llm import common as C
    monkeypatch.setattr(C, "SIEVE_WORDS", 1)
    test_repeated_and_null_ids(llm, 3, 85)
    test_one_of_each_group_stays(llm)


def test_decontamination(llm):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(25).capitalize() + ".") for i in range(20)] + [(100, None), (101, "tiny"), (7, None)]
    rows, want = [], set()
    for i in range(120):
        text = [prose(60), prose(60)]
        if i % 3 == 0:
            ident, item = items[i % 20]
            chars = list(item)
            for _ in range(i % 7):                # a few edits, within the budget
                at = rng.randrange(len(chars))
                chars[at:at + 1] = rng.choice([[], ["q"], [chars[at], "z"]])
            changed = "".join(chars)
            changed = changed.upper() if i % 2 else changed.replace(" ", "\n  ")
            text.insert(1, changed)
            want.add((i, ident))
        rows.append((i, " ".join(text)))
    rows += [(1000 + (i or 0), t) for i, t in EDGES]
    docs = documents(llm, rows)
    bench = llm.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS s", "'x' AS chars2")
    got = D.matches(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    texts, by = dict(rows), dict(items)
    for r in got:
        if r.edits == 0:
            flat = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
            assert flat(texts[r.doc_id][r.start:r.stop]) == flat(by[r.item_id])
    # many small slices of the benchmark find the same
    sliced = D.matches(docs, bench, slice_chars=400).collect()
    assert {(r.doc_id, r.item_id) for r in sliced} == want
    left = D.remove_contaminated(docs, bench)
    assert left.columns == docs.columns
    gone = {i for i, _ in want}
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in rows if i not in gone)
    assert D.matches(docs, bench.limit(0)).count() == 0 and D.matches(docs.limit(0), bench).count() == 0


def flat(s):
    return " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())


@pytest.mark.parametrize("chars", [1, 2, 5, 7, 8, 11, 17, 23])
def test_short_items_count_exactly_as_whole_words(chars):
    rng = random.Random(chars)
    for _ in range(40):
        item = "".join(rng.choice("ab c") for _ in range(chars - 1)).strip() + "a"
        words = flat(item).split()
        text = " ".join(rng.choice(["a", "b", "ca", "aa", "c", flat(item), item.upper() + "!"]) for _ in range(12))
        index = D.Index([(5, item)], D.RATE, D.MIN_CHARS)
        got = D.scan(index, index.bitmap(), [text, "", text + "x"])
        for d, t in enumerate([text, "", text + "x"]):
            at = flat(t).split()
            there = any(at[i:i + len(words)] == words for i in range(len(at)))
            mine = [g for g in got if g[0] == d]
            assert bool(mine) == there, (item, t)
            for _, _, a, z, edits, _ in mine:
                assert edits == 0 and flat(t[a:z]) == " ".join(words)


def test_half_of_a_long_item_is_found(llm):
    rng = random.Random(31)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [(i, prose(80)) for i in range(6)] + [(9, prose(20))]
    words = [items[i][1].split() for i in range(7)]
    rows = [(i, " ".join([prose(50), *words[i][20:60], prose(50)])) for i in range(6)]
    rows += [(10, " ".join([prose(50), *words[0][:12], prose(50)])),        # too little of it
             (11, " ".join([prose(50), *words[6][:10], prose(50)])),        # half of a short item
             (12, " ".join([prose(50), *words[1], prose(50), *words[1][:40]]))]
    bench = llm.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.matches(documents(llm, rows), bench).collect()}
    assert set(got) == {(i, i) for i in range(6)} | {(12, 1)}
    assert got[12, 1].matched == len(items[1][1]) and got[12, 1].edits == 0
    texts = dict(rows)
    assert all(texts[i][got[i, i].start:got[i, i].stop] in items[i][1] for i in range(6))


@pytest.mark.parametrize("rate, min_chars", [(0, 24), (0.08, 8), (0, 8)])
def test_no_budget(llm, rate, min_chars):
    items = [(1, "hello there you"), (2, "elevenchars"), (3, "some words that are longer than the bound")]
    rows = [(1, "well, Hello there; you - some words that are longer than the bound"), (2, "elevenchars"),
            (3, "some words that are longer then the bound"), (4, "elevenchar hello there, yo"), (5, None)]
    bench = llm.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.matches(documents(llm, rows), bench, rate=rate, min_chars=min_chars).collect()}
    close = {(3, 3)} if rate else set()
    assert got == {(1, 1), (1, 3), (2, 2)} | close


def test_a_template_shared_by_many_items(monkeypatch):
    """Ten thousand items begin with one sentence: the text that repeats it
    matches none but the item that it holds, and few pairs are held at once."""
    monkeypatch.setattr(D, "PORTION", 50_000)
    rng = random.Random(41)
    tail = lambda: "".join(rng.choice("abcdefgh ") for _ in range(130))
    # its q-grams alone are fewer than an item's bound asks for
    template = "please answer the following question with a single word "
    items = [(i, template + tail()) for i in range(10_000)]
    index = D.Index(items, D.RATE, D.MIN_CHARS)
    text = (template + "and no more. ") * 5 + items[4321][1] + " " + template * 3
    got = D.scan(index, index.bitmap(), [text, "other " * 30, items[7][1]])
    assert {(d, index.ids[i]) for d, i, *_ in got} == {(0, 4321), (2, 7)}


def test_align_is_the_edit_distance():
    rng = random.Random(12)
    for _ in range(100):
        a = [rng.choice(b"abc") for _ in range(rng.randint(1, 12))]
        b = [rng.choice(b"abc") for _ in range(rng.randint(0, 25))]
        rows = [list(range(len(a) + 1))]
        best = len(a)
        for c in b:
            new = [0]
            for i, x in enumerate(a):
                new.append(min(rows[-1][i] + (x != c), rows[-1][i + 1] + 1, new[i] + 1))
            rows.append(new)
            best = min(best, new[-1])
        got, stop = D.align(np.array(a, np.uint32), np.array(b, np.uint32), -len(a), len(b))
        assert got == best and rows[stop][-1] == best
