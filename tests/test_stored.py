"""Lookups, pages, kept tables and commit checks of the stored registry."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shelfmark import schemas as S
from shelfmark.operators import listing, lookup, quality, stored
from shelfmark.plans import catalog
from shelfmark.sources import registry as R
from shelfmark.sources.derived import grams
from shelfmark.streaming import stream

from test_store import NOW, T0, configs, message, new_root, registry, upserts


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


def test_latest_is_kept_up_to_date(spark):
    """Equal to the recomputed one after random batches, deletions of the
    latest among them."""
    rng, root = random.Random(5), new_root("latest")
    stream.init_registry(registry(spark, 4, 12), root, buckets=3, derived=True)
    kinds = ["upsert", "drop", "drop", "event", "drop_dataset", "register", "event"]
    for step, kind in enumerate(rng.sample(kinds, len(kinds))):
        if kind == "upsert":
            stream.upsert_and_commit(spark, root, upserts(spark, [(rng.randint(1, 4), f"p{rng.randint(0, 14)}") for _ in range(3)]),
                                     f"2024-03-{step + 1:02d} 00:00:00")
        elif kind == "drop":
            latest = rows(stored.latest_partitions(spark, root), "dataset_id", "partition_name")
            keys = rng.sample(latest, min(2, len(latest))) + [(1, "p1")]
            stream.delete_partitions_and_commit(spark, root, spark.createDataFrame(keys, "dataset_id long, partition_name string"))
        elif kind == "event":
            d, name = rng.randint(1, 4), f"p{rng.randint(0, 5)}"
            batch = message(spark, step, f"d{d}", name, S.EVENT_DELETE).unionByName(message(spark, 100 + step, f"d{d}", name))
            stream.apply_decoded(spark, batch, root)
        elif kind == "drop_dataset":
            stream.delete_datasets_and_commit(spark, root, spark.createDataFrame([(f"d{rng.randint(1, 4)}",)], "dataset_name string"))
        else:
            stream.register_and_commit(spark, root, configs(spark, [f"d{rng.randint(1, 4)}"]), NOW)
        reg = R.load_registry(spark, root)
        assert rows(stored.latest_partitions(spark, root)) == rows(
            listing.latest_partitions(reg.partitions).select(*S.PARTITION_COLUMNS)), (step, kind)
        names = rows(reg.datasets, "dataset_name", "dataset_id")
        grams = R.load_table(spark, root, R.manifest(spark, root), "grams")
        assert sorted({(r.dataset_name, r.dataset_id) for r in grams.collect()}) == names


def test_find_opens_few_buckets(spark, monkeypatch):
    root = new_root("find")
    stream.init_registry(registry(spark, 300, 900), root, derived=True)
    asked = [(f"d{i}", n) for i in (3, 77, 150) for n in ("latest", f"p{i - 1}", "none")] + [("missing", "latest"), ("d9", None)]
    req = spark.createDataFrame(asked, "dataset_name string, partition_name string")
    want = lookup.find_partitions(R.load_registry(spark, root), req)
    read, real = [], R.load_table

    def seen(spark, root, m, table, only_buckets=None):
        read.append((table, only_buckets))
        return real(spark, root, m, table, only_buckets)
    monkeypatch.setattr(R, "load_table", seen)
    got = stored.find_partitions(spark, root, req)
    assert rows(got) == rows(want, *got.columns) and got.where("found").count() == 6
    assert {t for t, b in read if b is None} <= {"managers"}
    assert all(len(b) <= 5 for _, b in read if b is not None)
    assert rows(stored.find_datasets(spark, root, req), "dataset_name", "dataset_id") == rows(
        lookup.find_datasets(R.load_registry(spark, root), req), "dataset_name", "dataset_id")


def test_search_reads_the_grams_of_the_terms(spark):
    root = new_root("search")
    stream.init_registry(registry(spark, 40), root, derived=True)
    stream.register_and_commit(spark, root, configs(spark, ["abc%x", "zzab\\c", "north_sea", "Ärger"]), NOW)
    stream.delete_datasets_and_commit(spark, root, spark.createDataFrame([("d17",), ("d18",)], "dataset_name string"))
    terms = spark.createDataFrame([(t,) for t in ["d1", "d17", "abc\\%", "b", "north%sea", "_", "____", "", "Är", "zzz", "h\\_s", "ab\\\\c"]], "term string")
    want = rows(lookup.search_datasets(R.load_registry(spark, root), terms), "term", "dataset_name")
    got = rows(stored.search_datasets(spark, root, terms), "term", "dataset_name")
    assert got == want and ("d1", "d12") in got and ("d17", "d17") not in got
    m, t = R.manifest(spark, root), spark.createDataFrame([("d3",)], "term string")
    buckets = R.buckets_of(spark.createDataFrame([("d3",)], "gram string"), "gram", m)
    files = R.load_table(spark, root, m, "grams", buckets).inputFiles()
    assert len(buckets) == 1 and len(files) <= 3
    assert len(rows(stored.search_datasets(spark, root, t), "dataset_name")) == 11      # d3, d30 to d39


def test_pages_read_the_ranges_that_hold_them(spark):
    root = new_root("pages")
    stream.init_registry(registry(spark, 5, 4000), root)
    parts = R.load_registry(spark, root).partitions
    for d, count, offset in ((1, 10, 0), (2, 25, 700), (5, 100, 750), (3, 10, 900), (99, 10, 0)):
        want = [tuple(r) for r in parts.where(F.col("dataset_id") == d).orderBy(*listing.partition_order())
                .select("partition_id").collect()][offset:offset + count]
        page = stored.page_partitions(spark, root, d, count, offset)
        got = page.collect()
        assert [(r.partition_id,) for r in got] == want
        assert [r.position for r in got] == list(range(offset + 1, offset + 1 + len(want)))
    everything = {r["_range"] for r in stored._ranges(spark, root, 0, "partitions")}
    page = stored.page_partitions(spark, root, 2, 25, 700)
    assert len({f.split("_range=")[1].split("/")[0] for f in page.inputFiles()}) <= 2 < len(everything)
    view = listing.dataset_view(R.load_registry(spark, root))
    want = [r.dataset_id for r in view.orderBy(*listing.dataset_order()).collect()]
    got = stored.page_datasets(spark, root, 2, 2).collect()
    assert [(r.position, r.dataset_id) for r in got] == [(3, want[2]), (4, want[3])]
    assert stored.page_datasets(spark, root, 5, 50).count() == 0
    # a new version has its own order, and vacuum removes the old one
    stream.upsert_and_commit(spark, root, upserts(spark, [(4, "new")]), NOW)
    assert stored.page_datasets(spark, root, 1).first().dataset_id == 4
    assert any(x.startswith("_ordered/0-") for x in R.vacuum(spark, root, keep=1))


def test_commit_report_is_the_full_report_of_its_rows(spark):
    root = new_root("report")
    stream.init_registry(registry(spark, 30, 60), root)
    t = dt.datetime(2024, 5, 1)
    bad = spark.createDataFrame([
        (900, "x" * 300, "u", 1, 3, t, t), (901, "fine", "u", 1, 4, t, t), (902, "lost", "u" * 256, 1, 777, t, t)], S.PARTITIONS)
    datasets = spark.createDataFrame([
        (50, "d7", "d", "csv", "zip", "public", {}, 1, t, t), (51, "own", "d", "word", "zip", "public", {}, 99, t, t)], S.DATASETS)
    managers = spark.createDataFrame([(2, "m@x.org", "k2", False, T0, T0)], S.MANAGERS)
    stream.transact(spark, root, lambda m: (stream.Changes(
        {"partitions": bad, "datasets": datasets, "managers": managers}), None))
    got = rows(quality.commit_violations(spark, root))
    reg = R.load_registry(spark, root)
    full = rows(quality.row_violations(reg).unionByName(quality.unique_violations(reg)).unionByName(lookup.orphans(reg)))
    assert got == full and {r for r, _, _ in got} == {
        "partitions.partition_name length <= 255", "partitions.partition_url length <= 255", "partitions.dataset_id",
        "datasets unique(dataset_name)", "datasets.dataset_format in domain", "datasets.manager_id",
        "managers unique(manager_email)"}
    # a clean commit has none
    stream.upsert_and_commit(spark, root, upserts(spark, [(1, "ok")]), NOW)
    assert rows(quality.commit_violations(spark, root)) == []


def test_search_deals_no_names_out_by_length_or_gram(spark):
    names = spark.createDataFrame([(i, f"data-{i:04d}") for i in range(300)], "dataset_id long, dataset_name string")
    terms = spark.createDataFrame([(t,) for t in ("a", "-00", "%", "%__", "_" * 9, "_" * 10, "zz")], "term string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only what is proven small is broadcast
    try:
        found = lookup.search_by_grams(names, lambda wanted: grams(names), lookup.search_terms(terms))
        plan = found._jdf.queryExecution().executedPlan().toString()
        hits = {r["term"]: r["count"] for r in found.groupBy("term").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(_length" not in plan and "hashpartitioning(gram" not in plan
    assert hits == {"a": 300, "-00": 100, "%": 300, "%__": 300, "_" * 9: 300}


def test_the_log_is_decoded_once(spark, monkeypatch):
    fields = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in S.DECODED.fields}
    log = spark.range(7).select(*[F.explode(F.array(F.col("id").cast("string"))).alias("message_id") if n == "message_id" else c
                                  for n, c in fields.items()])
    seen, parts_of = [], stream.parts_of
    monkeypatch.setattr(catalog, "_decoded", lambda *_: log)
    monkeypatch.setattr(catalog.fixtures, "event_registry", lambda *_: R.empty_registry(spark))
    monkeypatch.setattr(stream, "init_registry", lambda *_, **__: None)
    monkeypatch.setattr(stream, "parts_of", lambda d, n: seen.append(d) or parts_of(d, n))
    monkeypatch.setattr(stream, "apply_decoded", lambda _, part, *__: seen.append(part))
    catalog._streamed(spark, "")
    assert "Generate" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert [sorted(r.message_id for r in p.collect()) for p in seen[1:]] == [["0", "1", "2"], ["3", "4", "5"], ["6"]]
