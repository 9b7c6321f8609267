"""The stored registry: deltas, concurrent writers, maintenance."""

import datetime as dt
import os
import random
import tempfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas as S
from shelfmark.sources import registry as R
from shelfmark.streaming import stream

T0 = dt.datetime(2024, 1, 1)
NOW = "2024-02-01 00:00:00"
ROWS = "request_id long, dataset_id long, partition_name string, partition_url string, partition_size long"
CONFIG = ("request_id long, manager_id long, name string, format string, compression string, "
          "classification string, description string, schema map<string,string>")


def registry(spark, n_datasets=4, n_parts=0):
    managers = spark.createDataFrame([(1, "m@x.org", "k", False, T0, T0)], S.MANAGERS)
    datasets = spark.createDataFrame([(i, f"d{i}", "d", "csv", "zip", "public", {"a": "b"}, 1, T0, T0)
                                      for i in range(1, n_datasets + 1)], S.DATASETS)
    parts = spark.range(n_parts).select(
        (F.col("id") + 1).alias("partition_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("partition_name"),
        F.lit("u").alias("partition_url"), F.lit(1).cast("long").alias("partition_size"),
        (F.col("id") % n_datasets + 1).alias("dataset_id"),
        F.lit(T0).cast(S.TS).alias("created_at"), F.lit(T0).cast(S.TS).alias("updated_at"))
    return R.Registry(managers, datasets, parts)


def new_root(name):
    return os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), "registry")


def upserts(spark, rows):
    return spark.createDataFrame([(i, d, n, f"u{i}", i) for i, (d, n) in enumerate(rows)], ROWS)


def configs(spark, names):
    return spark.createDataFrame([(i, 1, n, "csv", "zip", "public", "d", {"a": "b"}) for i, n in enumerate(names)], CONFIG)


def message(spark, i, dataset, name, event=S.EVENT_FINALIZE):
    return spark.createDataFrame([(f"a{i}", f"m{i}", T0, event, T0 + dt.timedelta(minutes=i), None,
                                   f"{dataset}/{name}" if name else dataset, f"u://{name}", i, dataset, name, None)], S.DECODED)


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def contents(spark, root, version=None):
    reg = R.load_registry(spark, root, version)
    return ({(r.dataset_id, r.partition_name): (r.partition_id, r.partition_url) for r in reg.partitions.collect()},
            {r.dataset_name: (r.dataset_id, r.updated_at) for r in reg.datasets.collect()})


def test_a_commit_writes_what_it_changes(spark):
    root = new_root("delta")
    stream.init_registry(registry(spark, 20, 20_000), root)
    before = R.manifest(spark, root)
    size, files = folder_bytes(root), {w for f in before.tables.values() for w in f.writes()}
    stream.upsert_and_commit(spark, root, upserts(spark, [(i % 20 + 1, f"p{i}") for i in range(5)]
                                                  + [(i, "new") for i in range(1, 6)]), NOW)
    m = R.manifest(spark, root)
    assert folder_bytes(root) - size < 64_000 and size > 200_000
    assert {t: len(f.deltas) for t, f in m.tables.items() if f.deltas} == {"partitions": 1, "datasets": 1}
    assert files <= {w for f in m.tables.values() for w in f.writes()}    # the base stays where it is
    assert sum(m.tables["partitions"].deltas[0]["rows"].values()) == 10
    parts, ds = contents(spark, root)
    assert len(parts) == 20_005 and parts[1, "p0"] == (1, "u0") and parts[3, "new"][0] == 20_003
    assert ds["d1"][1] == dt.datetime(2024, 2, 1) and ds["d6"][1] == T0
    # the version before is as it was
    assert contents(spark, root, 0)[0][1, "p0"] == (1, "u")
    assert len(contents(spark, root, 0)[0]) == 20_000


def test_two_interleaved_writers_lose_nothing(spark, monkeypatch):
    """Another writer commits between a writer's read and its commit."""
    root = new_root("writers")
    stream.init_registry(registry(spark, 4, 8), root)
    real, others = R.try_commit, []

    def first_the_other(spark, root, before, changes, buckets=R.BUCKETS):
        if others:
            others.pop()()
        return real(spark, root, before, changes, buckets)
    monkeypatch.setattr(R, "try_commit", first_the_other)

    others.append(lambda: stream.upsert_and_commit(spark, root, upserts(spark, [(1, "theirs"), (1, "both")]), NOW))
    v, _ = stream.upsert_and_commit(spark, root, upserts(spark, [(1, "mine"), (1, "both"), (2, "mine")]), NOW)
    assert v == 2
    parts, _ = contents(spark, root)
    assert {n for d, n in parts if d == 1} == {"p0", "p4", "theirs", "both", "mine"}
    ids = [i for i, _ in parts.values()]
    assert len(set(ids)) == len(ids) == 8 + 4 and parts[1, "both"][1] == "u1"
    # two registrations of one name: one is refused
    others.append(lambda: stream.register_and_commit(spark, root, configs(spark, ["n1", "n2"]), NOW))
    _, rejected = stream.register_and_commit(spark, root, configs(spark, ["n2", "n3"]), NOW)
    assert [(r.name, r.reason) for r in rejected.collect()] == [("n2", "dataset_name already registered")]
    _, ds = contents(spark, root)
    assert len({i for i, _ in ds.values()}) == len(ds) == 4 + 3
    # a batch meets the deletion of its dataset: the message waits
    others.append(lambda: stream.delete_datasets_and_commit(spark, root, spark.createDataFrame([("d3",)], "dataset_name string")))
    stream.apply_decoded(spark, message(spark, 1, "d3", "late"), root, 0, "s")
    assert [r.message_id for r in stream.current(spark, root)[1].collect()] == ["m1"]
    assert not [k for k in contents(spark, root)[0] if k[0] == 3]
    # the losers left no files behind
    named = {w for v in R.committed_versions(spark, root) for f in R.manifest(spark, root, v).tables.values() for w in f.writes()}
    there = {w for t in R.SPECS for w in os.listdir(os.path.join(root, t)) if os.path.isdir(os.path.join(root, t))} \
        if all(os.path.isdir(os.path.join(root, t)) for t in R.SPECS) else \
        {w for t in R.SPECS if os.path.isdir(os.path.join(root, t)) for w in os.listdir(os.path.join(root, t))}
    assert there <= named


def test_writers_side_by_side(spark):
    root = new_root("threads")
    stream.init_registry(registry(spark, 4), root)

    def write(k):
        for i in range(3):
            stream.upsert_and_commit(spark, root, upserts(spark, [(k, f"w{k}-{i}"), (k, "shared")]), NOW)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, (1, 2, 3)))
    parts, _ = contents(spark, root)
    assert set(parts) == {(k, n) for k in (1, 2, 3) for n in ("shared", f"w{k}-0", f"w{k}-1", f"w{k}-2")}
    ids = sorted(i for i, _ in parts.values())
    assert len(set(ids)) == 12
    assert R.committed_versions(spark, root) == list(range(10))


def test_a_marker_is_made_only_once(spark):
    root = new_root("marker")
    path = os.path.join(root, "_commits", "7")
    assert R._put_if_absent(spark, path, "one") and not R._put_if_absent(spark, path, "two")
    assert R._read_text(spark, path) == "one"
    assert [f for f in os.listdir(os.path.dirname(path)) if not f.endswith(".crc")] == ["7"]


@pytest.mark.parametrize("seed", [1])
def test_random_commits_equal_a_model(spark, monkeypatch, seed):
    """Puts and drops with merges, another bucket count and vacuums between."""
    monkeypatch.setattr(R, "MAX_DELTAS", 3)
    rng, root = random.Random(seed), new_root("model")
    stream.init_registry(registry(spark, 3, 6), root, buckets=4)
    parts, ds = contents(spark, root)
    next_id, next_ds = 6, 3
    for step in range(9):
        kind = rng.choice(["upsert", "upsert", "drop", "drop_dataset", "register", "care"])
        if kind == "upsert":
            asked = list({(rng.randint(1, 4), f"p{rng.randint(0, 8)}") for _ in range(4)})
            known = {i for i, _ in ds.values()}
            stream.upsert_and_commit(spark, root, upserts(spark, asked), NOW)
            fresh = sorted(k for k in asked if k[0] in known and k not in parts)
            for i, k in enumerate(asked):
                if k[0] in known:
                    parts[k] = (parts[k][0] if k in parts else next_id + fresh.index(k) + 1, f"u{i}")
            next_id += len(fresh)
            ds = {n: (i, dt.datetime(2024, 2, 1) if any(k[0] == i for k in fresh) else t) for n, (i, t) in ds.items()}
        elif kind == "drop":
            keys = [(rng.randint(1, 4), f"p{rng.randint(0, 8)}") for _ in range(3)]
            stream.delete_partitions_and_commit(spark, root, spark.createDataFrame(
                keys + [(1, None)], "dataset_id long, partition_name string"))
            parts = {k: v for k, v in parts.items() if k not in keys}
        elif kind == "drop_dataset":
            name = f"d{rng.randint(1, 5)}"
            stream.delete_datasets_and_commit(spark, root, spark.createDataFrame([(name,)], "dataset_name string"))
            gone = ds.pop(name, (None, None))[0]
            parts = {k: v for k, v in parts.items() if k[0] != gone}
        elif kind == "register":
            name = f"d{rng.randint(1, 5)}"
            stream.register_and_commit(spark, root, configs(spark, [name]), NOW)
            if name not in ds:
                next_ds += 1
                ds[name] = (next_ds, dt.datetime(2024, 2, 1))
        else:
            what = rng.choice(["compact", "rebucket", "vacuum"])
            if what == "compact":
                stream.compact(spark, root)
            elif what == "rebucket":
                R.rebucket(spark, root, rng.choice([1, 3, 7]))
            else:
                R.vacuum(spark, root, keep=1, grace_seconds=0)
        monkeypatch.setattr(R, "COMPACT_BYTES", rng.choice([1, 32 << 20]))
        R.maintain(spark, root)
        m = R.manifest(spark, root)
        assert all(len(f.deltas) <= 4 for f in m.tables.values())
        assert contents(spark, root) == (parts, ds), (step, kind)
        names = {r.dataset_name: r.dataset_id for r in R.load_table(spark, root, m, "names").collect()}
        assert names == {n: i for n, (i, _) in ds.items()}


def test_merges_follow_the_bytes_of_a_bucket():
    """Only buckets whose deltas outgrew the bound and a share of the base."""
    mb = 1 << 20
    files = R.Files({0: ["w", 10, 400 * mb], 1: ["w", 10, 60 * mb], 2: ["w", 10, mb]},
                    [{"write": "d", "rows": {0: 4, 1: 4, 2: 1}, "buckets": 3, "bytes": 90 * mb}])
    assert R._due(files) == [1]      # 40 of 400, 40 of 60, 10 of 1 (under 32)


def test_bucket_count_is_stored_and_changeable(spark):
    root = new_root("buckets")
    stream.init_registry(registry(spark, 6, 60), root, buckets=5)
    before = contents(spark, root)
    assert R.manifest(spark, root).buckets == 5 and set(R.manifest(spark, root).tables["partitions"].base) <= set(range(5))
    assert R.rebucket(spark, root, 17) == 1
    m = R.manifest(spark, root)
    assert m.buckets == 17 and contents(spark, root) == before
    ids = spark.createDataFrame([(2,), (None,)], "dataset_id long")
    (b,) = R.buckets_of(ids, "dataset_id", m)
    some = R.load_registry(spark, root, only_buckets=[b]).partitions
    assert {r.dataset_id for r in some.collect()} >= {2}
    assert all("bucket=" + str(b) + "/" in f for f in some.inputFiles())
    stream.upsert_and_commit(spark, root, upserts(spark, [(2, "n")]), NOW)
    assert contents(spark, root)[0][2, "n"][0] == 61


def test_vacuum_keeps_the_last_versions_and_commits_under_way(spark):
    root = new_root("vacuum")
    stream.init_registry(registry(spark, 3, 30), root)
    dead = message(spark, 5, "d1", "x").withColumn("reason", F.lit("undecodable payload"))
    stream.apply_decoded(spark, dead, root)
    stream.compact(spark, root)
    stream.upsert_and_commit(spark, root, upserts(spark, [(1, "n")]), NOW)
    before = contents(spark, root)
    os.makedirs(os.path.join(root, "partitions", "underway"))
    assert R.vacuum(spark, root, keep=2) == []               # all too young
    assert R.committed_versions(spark, root) == [2, 3]
    removed = R.vacuum(spark, root, keep=2, grace_seconds=-5)
    assert "partitions/underway" in removed and len(removed) > 3
    assert contents(spark, root) == before and len(contents(spark, root, 2)[0]) == 30
    assert [(r.message_id, r.version) for r in stream.all_dead_letters(spark, root).collect()] == [("m5", 1)]


def test_pending_is_only_added_to(spark, monkeypatch):
    """A batch reads pending messages of newly registered names alone."""
    root = new_root("waiting")
    stream.init_registry(registry(spark, 1), root)
    for i in range(3):
        stream.apply_decoded(spark, message(spark, i, f"x{i}", "f"), root, i, "s")
    m = R.manifest(spark, root)
    assert [sum(d["rows"].values()) for d in m.tables["pending"].deltas] == [1, 1, 1]
    read, real = [], stream.load_table

    def seen(spark, root, m, table, only_buckets=None):
        read.append((table, only_buckets))
        return real(spark, root, m, table, only_buckets)
    monkeypatch.setattr(stream, "load_table", seen)
    stream.apply_decoded(spark, message(spark, 3, "d1", "f"), root, 3, "s")
    assert not [t for t, _ in read if t in ("pending", "fresh")]
    stream.register_and_commit(spark, root, configs(spark, ["x1"]), NOW)
    read.clear()
    stream.apply_decoded(spark, message(spark, 4, "d1", "g"), root, 4, "s")
    (buckets,) = [b for t, b in read if t == "pending"]
    assert len(buckets) == 1
    parts, ds = contents(spark, root)
    assert parts[ds["x1"][0], "f"][1] == "u://f" and len(parts) == 3
    assert sorted(r.message_id for r in stream.current(spark, root)[1].collect()) == ["m0", "m2"]
    # deleted, and a message waits again; registered again, it is taken up
    stream.delete_datasets_and_commit(spark, root, spark.createDataFrame([("x1",)], "dataset_name string"))
    stream.apply_decoded(spark, message(spark, 5, "x1", "h"), root, 5, "s")
    stream.register_and_commit(spark, root, configs(spark, ["x1"]), NOW)
    stream.retry_pending(spark, root)
    parts, ds = contents(spark, root)
    assert (ds["x1"][0], "h") in parts and (ds["x1"][0], "f") not in parts
    stream.compact(spark, root)
    assert sorted(r.message_id for r in stream.current(spark, root)[1].collect()) == ["m0", "m2"]


def test_registration_writes_the_config_file(spark, tmp_path):
    from shelfmark.functions import paths
    from shelfmark.sources.configs import read_dataset_configs, storage_name
    root, out = new_root("config"), str(tmp_path / "buckets")
    stream.init_registry(registry(spark, 1), root)
    names = ["plain", "a b/c", "t:1", "..", "d1"]
    stream.register_and_commit(spark, root, configs(spark, names), NOW, config_root=out)
    assert sorted(r.name for r in read_dataset_configs(spark, out).collect()) == sorted(names[:4])
    assert os.path.isfile(os.path.join(out, "public", "plain", "dd.json"))
    assert not [f for _, _, fs in os.walk(out) for f in fs if f.startswith(".dd.json.") and not f.endswith(".crc")]
    assert storage_name("a:b%\\..") == "a%3Ab%25%5C.." and storage_name("../x//y") == "%2E%2E/x/%00/y"
    # the library's own router knows the object
    obj = spark.createDataFrame([("plain/dd.json",)], "o string")
    row = obj.select(paths.dataset_of("o").alias("d"), paths.is_config_object("o").alias("c")).first()
    assert (row.d, row.c) == ("plain", True)
