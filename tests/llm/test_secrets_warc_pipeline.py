"""Secret scans (3), WARC (10) and the pipeline."""

import hashlib
import os
import random
import re

import pytest

from shelfmark.llm import secrets as S
from shelfmark.llm import warc as W

from .conftest import EDGES, SF, documents


@pytest.fixture(scope="module")
def trees(llm):
    return S.train(S.labelled_findings(llm, 3000))


def test_forest_on_held_out_findings(llm, trees):
    """Findings with other random parts than those learned from."""
    held = S.labelled_findings(llm, 5000).subtract(S.labelled_findings(llm, 3000))
    rows = held.select("candidate", "left", "right", "path", "label").collect()
    docs = [(i, f"start {r.left}{r.candidate}{r.right} end") for i, r in enumerate(rows)]
    d = llm.createDataFrame([(i, t, rows[i].path) for i, t in docs], "doc_id long, text string, source string")
    found = {(r.doc_id, r.candidate): r.is_secret for r in S.scan(d, trees).collect()}
    right = [found.get((i, r.candidate)) == bool(r.label) for i, r in enumerate(rows) if (i, r.candidate) in found]
    assert len(right) > 1200 and sum(right) >= 0.95 * len(right)


HEX = hashlib.sha1(b"some key").hexdigest()


def test_scan_and_redact(llm, trees):
    text = f'the stone token = "{HEX}" walks\nand commit {HEX} or 9807915762804490, token = "{HEX}".'
    rows = [*EDGES, (50, text), (51, text), (51, text)]
    docs = documents(llm, rows)
    got = S.scan(docs, trees).collect()
    by = {}
    for r in got:
        assert r.doc_id in (50, 51, 7, 8, 9, 10) or r.doc_id is None
        if r.doc_id == 50:
            assert text[r.start:r.start + len(r.candidate)] == r.candidate
            by[r.ordinal] = r.is_secret
    assert by == {0: True, 1: False, 2: False, 3: True}
    assert sum(r.doc_id == 51 for r in got) == 8
    out = S.redacted(docs, trees)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.where("doc_id is not null").collect()}
    clean = f'the stone token = "[SECRET]" walks\nand commit {HEX} or 9807915762804490, token = "[SECRET]".'
    assert texts[50] == (clean, len(clean)) and texts[1] == (None, None) and texts[2] == ("", 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert S.scan(docs.limit(0), trees).count() == 0
    assert S.train(S.labelled_findings(llm, 0)) == []


def test_warc_round_trip(llm):
    rng = random.Random(13)
    big = "<p>" + "long é " * 40 + "</p>"
    rows = [(i, f"https://h{rng.randint(0, 9)}.example.com/p{rng.randint(0, 99)}",
             rng.choice([big, big + str(i % 5), "short", "", None, f"<html>{i}" + "\r\n\r\nWARC/1.1\r\n" * 9])) for i in range(300)]
    rows += [(500, None, big), (501, "no scheme\r\nWARC-Type: evil", big), (502, "http://z/", "é" * 60_000), (None, "http://n/", "x" * 200),
             (7, "http://again/", "short")]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' AS digest", "'x' AS first", "'x' AS record_type", "'x' AS n")
    got = W.round_trip(pages).collect()
    raw = lambda h: (h or "").encode()
    first = {}
    for i, _, h in rows:
        if len(raw(h)) >= 100 and i is not None:
            first[raw(h)] = min(i, first.get(raw(h), i))

    def want(i, h):
        f = first.get(raw(h))
        revisit = f is not None and f != i
        return (i, len(raw(h)), hashlib.sha256(raw(h)).hexdigest(), "revisit" if revisit else "response", f if revisit else None)
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(
        (want(i, h) for i, _, h in rows), key=key)
    index = [(r.url_key, r.timestamp, r.page_id if r.page_id is not None else -1) for r in got]
    assert index == sorted(index)
    assert W.round_trip(pages.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(14)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(W.loser_tree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_a_damaged_archive_is_noticed():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: d\r\nWARC-Target-URI: u\r\n" \
             b"WARC-Payload-Digest: sha256:" + hashlib.sha256(b"abc").hexdigest().encode() + \
             b"\r\nX-Payload-Length: 3\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [c[2] for c in W.parse(record * 2, "x")] == [1, 1]
    with pytest.raises(ValueError):
        list(W.parse(record.replace(b"abc\r\n", b"abd\r\n"), "x"))
    with pytest.raises(ValueError):
        list(W.parse(record[:-1], "x"))


def test_pipeline_stages(llm, tmp_path):
    """Each stage on its predecessor's output against plain expectations."""
    import corpus_pipeline as P
    from .test_quality_and_urls import labelled

    rows = [(i, t) for i, t, _ in labelled(400)]
    good = [i for i, _, q in labelled(400) if q]
    copy = dict(rows)[good[0]]
    rows += [(900, copy), (901, copy.upper())]                          # copies of an earlier document
    item = "An item of the benchmark, with rather many letters in it, that nobody should have read before."
    rows += [(902, dict(rows)[good[1]][::-1] + " " + item), (903, dict(rows)[good[2]][::-1] + f' token = "{HEX}" end'),
             (904, None), (905, "too short")]
    docs = documents(llm, rows)
    folder = str(tmp_path)
    docs.write.parquet(os.path.join(folder, "documents.parquet"))
    llm.createDataFrame([(i, q) for i, _, q in labelled(400)], "doc_id long, quality int").write.parquet(
        os.path.join(folder, "labels.parquet"))
    llm.createDataFrame([(1, item)], "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
    kept = {*good, 900, 901, 902, 903}
    want = [kept, kept - {900, 901}, kept - {900, 901, 902}, kept - {900, 901, 902}]
    out = llm.read.parquet(os.path.join(folder, "documents.parquet"))
    for i, ((name, stage), ids) in enumerate(zip(P.STAGES, want)):
        path = os.path.join(folder, f"stage-{i}")
        stage(llm, out, folder).write.parquet(path)
        out = llm.read.parquet(path)
        assert sorted(out.columns) == sorted(docs.columns), name
        assert {r.doc_id for r in out.select("doc_id").collect()} == ids, name
    assert "[SECRET]" in out.where("doc_id = 903").first().text
    final = P.run(llm, folder)
    assert {r.doc_id for r in final.collect()} == want[-1]
    # an empty table goes through
    empty = os.path.join(folder, "empty")
    docs.limit(0).write.parquet(os.path.join(empty, "documents.parquet"))
    for t in ("labels", "benchmark"):
        llm.read.parquet(os.path.join(folder, f"{t}.parquet")).write.parquet(os.path.join(empty, f"{t}.parquet"))
    assert P.run(llm, empty).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__ as E
    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1
    assert os.path.isdir(SF)


NAMED = [("password = \"Tr0ub4dor&3\"", "Tr0ub4dor&3"), ("password: 'S3cr3t!Pass.word#2024'", "S3cr3t!Pass.word#2024"),
         ("connect postgres://u:p4ssw0rd12@host/db", "p4ssw0rd12"), ("DB_PASSWORD=hunter2!x end", "hunter2!x"),
         ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzkeyzzkey", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzkeyzzkey"),
         ("auth_token = qXvBnMzKpLwRtYsDfGhJ", "qXvBnMzKpLwRtYsDfGhJ"), ("the password is Zk9!pq7x now", "Zk9!pq7x")]


def test_values_that_a_name_stands_before(llm, trees):
    """Short values, marks inside, letters alone and names joined by = are
    found as such, judged and replaced; plain words stay."""
    plain = "the password is wrong, author: Jane, auth_token = get_token() and a neighbourhood in wintertime"
    rows = [(i, f"walks {t}") for i, (t, _) in enumerate(NAMED)] + [(100, plain), (101, 'password = "" and token =')]
    docs = documents(llm, rows)
    got = {(r.doc_id, r.candidate): r for r in S.scan(docs, trees).collect()}
    for i, (t, value) in enumerate(NAMED):
        assert got[i, value].is_secret, t
        assert f"walks {t}"[got[i, value].start:][:len(value)] == value
    clean = {r.doc_id: r.text for r in S.redacted(docs, trees).collect()}
    for i, (t, value) in enumerate(NAMED):
        assert clean[i] == f"walks {t}".replace(value, "[SECRET]")
    assert clean[100] == plain and clean[101] == 'password = "" and token ='


def test_findings_not_found_are_misses(llm, trees):
    """Recall and precision with every labelled finding in the sum."""
    held = S.labelled_findings(llm, 9000).subtract(S.labelled_findings(llm, 6000))
    rows = held.select("candidate", "left", "right", "path", "label").collect()
    d = llm.createDataFrame([(i, f"{r.left}{r.candidate}{r.right}", r.path) for i, r in enumerate(rows)],
                            "doc_id long, text string, source string")
    hit = {}
    for r in S.scan(d, trees).where("is_secret").collect():
        at = len(rows[r.doc_id].left)
        if r.start < at + len(rows[r.doc_id].candidate) and r.start + len(r.candidate) > at:
            hit[r.doc_id] = True
    good = sum(bool(r.label) for r in rows)
    true = sum(bool(rows[i].label) for i in hit)
    assert true >= 0.9 * good and true >= 0.9 * len(hit)


def test_forest_on_contexts_not_learned_from(llm):
    """Whole templates are held out: every third."""
    seen, unseen = ([t for i, t in enumerate(S.TEMPLATES) if (i % 3 == 2) == held] for held in (False, True))
    assert not {t[1:3] for t in seen} & {t[1:3] for t in unseen}
    forest = S.train(S.labelled_findings(llm, 3000, seen))
    rows = S.labelled_findings(llm, 3000, unseen).collect()
    d = llm.createDataFrame([(i, f"{r.left}{r.candidate}{r.right}", r.path) for i, r in enumerate(rows)],
                            "doc_id long, text string, source string")
    hit = {r.doc_id for r in S.scan(d, forest).where("is_secret").collect()
           if r.start < len(rows[r.doc_id].left + rows[r.doc_id].candidate)
           and r.start + len(r.candidate) > len(rows[r.doc_id].left)}
    true, good = sum(rows[i].label for i in hit), sum(r.label for r in rows)
    print(f"precision {true / len(hit):.3f}, recall {true / good:.3f} of {good} secrets in {len(rows)} findings")
    assert true >= 0.85 * good and true >= 0.7 * len(hit)
