"""Quality rules (6) and URL rules (4) against plain Python."""

import collections
import random
import re

from shelfmark.llm import quality_rules as Q
from shelfmark.llm import url_rules as U

from .conftest import EDGES, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    ws = WORD.findall(text or "")
    threes = collections.Counter(zip(ws, ws[1:], ws[2:]))
    covered = {i + k for i, w in enumerate(zip(ws, ws[1:], ws[2:])) if threes[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_statistics(llm):
    rng = random.Random(1)
    rows = EDGES + [(100 + i, "".join(rng.choice(["a ", "b ", "c", "#", "|", "\n", "d e f ", "\t", "É"]) for _ in range(rng.randint(0, 60))))
                    for i in range(150)]
    got = Q.judge(documents(llm, rows), []).collect()
    show = lambda i, t: (i if i is not None else -1, *t)
    assert sorted(show(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == sorted(
        show(i, counted(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert r.kept == (not r.base_failed)


def labelled(n=1500):
    rng = random.Random(2)
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice("the of a stone river quiet morning walks over".split()) + str(rng.randint(0, 400)) for _ in range(80)]
        yield i, " ".join(w + "###" for w in words) if bad else " ".join(words), 0 if bad else 1


def test_learned_list_rejects_and_keeps(llm):
    rows = list(labelled())
    docs = documents(llm, [(i, t) for i, t, _ in rows])
    labels = llm.createDataFrame([(i, q) for i, _, q in rows if i < 1000] + [(None, 0), (3, None), (5, 1), (5, 1)],
                                 "doc_id long, quality int")
    rules = Q.fit(docs, labels)
    assert rules and all(len(r) <= Q.MAX_TESTS for r in rules)
    kept = {r.doc_id: r.kept for r in Q.judge(docs, rules).collect()}
    assert kept == {i: q == 1 for i, _, q in rows}           # the held-out ids from 1000 on, too
    left = Q.filter_documents(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(q for *_, q in rows)


def stats(rng, **given):
    return {n: rng.random() / 10 for n in Q.RATIOS} | given


def test_an_imprecise_rule_hides_no_other():
    """Many rows that only one in five labels call good, and few of another
    kind that all call bad."""
    rng = random.Random(4)
    rows = [(stats(rng, symbol_share=0.9), rng.random() < 0.8) for _ in range(900)]
    rows += [(stats(rng, exclaim_share=0.9), True) for _ in range(150)] + [(stats(rng), False) for _ in range(3000)]
    rng.shuffle(rows)
    rules = Q.learn(rows)
    fires = lambda **given: any(all(t.holds(stats(rng, **given)) for t in r) for r in rules)
    assert fires(exclaim_share=0.9) and not fires() and not fires(symbol_share=0.9)


def test_wrong_labels_leave_rules():
    """Six in a hundred labels are wrong: most bad rows are still told apart."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        bad = i % 4 == 0
        rows.append((stats(rng, symbol_share=0.9) if bad else stats(rng), bad != (rng.random() < 0.06)))
    rules = Q.learn(rows)
    fires = lambda **given: any(all(t.holds(stats(rng, **given)) for t in r) for r in rules)
    assert sum(fires(symbol_share=0.9) for _ in range(500)) > 250 and sum(fires() for _ in range(500)) < 10


def test_what_the_base_rejects_hides_no_rule(llm):
    """Most bad texts are short and fail the base; the others have symbols.
    The few labels still give a rule for these, and it costs no good text."""
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) + str(rng.randrange(999)) for _ in range(n))
    rows = [(i, words(12) + " ###", 0) for i in range(40)]
    rows += [(100 + i, words(80) + " " + "### " * 30, 0) for i in range(30)] + [(200 + i, words(90), 1) for i in range(300)]
    docs = documents(llm, [(i, t) for i, t, _ in rows])
    labels = llm.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    rules = Q.fit(docs, labels)
    assert rules
    kept = {r.doc_id: r.kept for r in Q.judge(docs, rules).collect()}
    assert kept == {i: q == 1 for i, _, q in rows}


def test_rules_on_the_small_table(llm):
    """The labelled bad texts that the base keeps are caught, no good one is
    lost."""
    from shelfmark.llm.common import table
    docs, labels = (table(llm, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rules = Q.fit(docs, labels)
    got = Q.judge(docs, rules).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    assert rules and {(r.quality, r.kept) for r in got} == {(0, False), (1, True)}


def test_without_labels_the_base_decides(llm):
    docs = documents(llm, EDGES)
    empty = llm.createDataFrame([], "doc_id long, quality int")
    assert Q.fit(docs, empty) == []
    assert Q.fit(docs.limit(0), empty) == [] and Q.judge(docs.limit(0), []).count() == 0
    plan = Q.judge(docs, [])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h, p, v) for h, p, v in rules
            if (h in ("", host) or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best and best[1] + best[2], best[3] if best else default)


def test_url_rules(llm):
    rules = U.RULES + [("thre.example.net", "", "block"), ("com", "/fr", "block"), ("", "/zz", "block"),
                       ("example.com", "/en/5", "block")]
    rng = random.Random(3)
    hosts = ["com", "Example.com", "www.example.com", "a.www.example.com", "myexample.com", "x.net", "net", "",
             "thre.example.net", "b.thre.example.net", "other.org", "a..com", "com.", "bücher.com"]
    paths = ["", "/", "/en/", "/en/5?x#y", "/es/1", "/fr", "/fr/2/", "?q=/en/", "#://net/es/", "/zz9"]
    rows = [(i, rng.choice(["http://", "https://", "", "x"]) + rng.choice(hosts) + rng.choice(paths)) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (None, "http://com/en/"), (2002, "http://com/"), (2002, "http://com/"),
             (2003, "http://x.net/es/" + "y" * 50_000)]
    pages = llm.createDataFrame(rows, "page_id long, url string").selectExpr(
        "*", "'x' AS key", "'x' AS range", "'x' AS host", "'x' AS rule", "'x' AS `end`")
    got = U.judge(pages, U.rule_frame(llm, rules)).collect()
    order = lambda x: tuple(map(str, x))
    assert sorted((tuple(r) for r in got), key=order) == sorted(((i, *brute(u, rules)) for i, u in rows), key=order)
    assert U.judge(pages.limit(0), U.rule_frame(llm, rules)).count() == 0
    none = U.judge(pages, U.rule_frame(llm, rules).limit(0)).collect()
    assert len(none) == len(rows) and {r.verdict for r in none} == {"allow"}
