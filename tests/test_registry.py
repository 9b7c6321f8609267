"""Registry behaviour, modelled on the reference's integration tests
(search, range queries, latest partition, registration, managers)."""

import datetime as dt
import gzip
import json
import os

from pyspark.sql import functions as F

from shelfmark import schemas as S
from shelfmark.operators import listing, lookup, mutations
from shelfmark.sources import configs
from shelfmark.sources.registry import Registry, conform

T0 = dt.datetime(2021, 1, 1)
NOW = "2021-06-01 00:00:00"


def registry(spark, names=("ds",), n_parts=0, part_step_ms=100):
    managers = spark.createDataFrame(
        [(1, "owner@registry.test", "key-1", False, T0, T0)], S.MANAGERS)
    ds = [(i + 1, n, "desc", "csv", "gzip", "public", {"id": "integer"}, 1,
           T0 + dt.timedelta(seconds=i), T0 + dt.timedelta(seconds=i)) for i, n in enumerate(names)]
    parts = [(i + 1, f"p{i:02d}.csv.tar.gz", f"cloud://x/p{i}", 1000 + i, 1,
              T0 + dt.timedelta(milliseconds=part_step_ms * i),
              T0 + dt.timedelta(milliseconds=part_step_ms * i)) for i in range(n_parts)]
    return Registry(managers, spark.createDataFrame(ds, S.DATASETS),
                    spark.createDataFrame(parts, S.PARTITIONS))


def terms(spark, *ts):
    return spark.createDataFrame([(t,) for t in ts], "term string")


def test_search(spark):
    reg = registry(spark, ["dataset_1_teamA", "dataset_2_teamA", "dataset_1_teamB", "datasetX1"])
    t = terms(spark, "team", "teamA", "teamB", "no_results", "dataset_1", "", "TEAM", "\\_1\\_", "a\\m")
    for max_b in (None, 1):  # broadcast path and trigram path
        hits = {r.term: r.hits for r in lookup.search_counts(reg, t).collect()} if max_b is None else \
            {r.term: r.n for r in lookup.search_datasets(reg, t, max_broadcast=max_b)
             .groupBy("term").agg(F.count("*").alias("n")).collect()}
        assert hits.get("team", 0) == 3
        assert hits.get("teamA", 0) == 2
        assert hits.get("teamB", 0) == 1
        assert hits.get("no_results", 0) == 0
        assert hits.get("dataset_1", 0) == 3      # '_' is a wildcard: datasetX1 matches
        assert hits.get("", 0) == 4               # empty term matches every name
        assert hits.get("TEAM", 0) == 0           # case-sensitive
        assert hits.get("\\_1\\_", 0) == 2        # escaped underscores are literal
        assert hits.get("a\\m", 0) == 3           # backslash before 'm' matches 'm'


def test_range_partitions(spark):
    reg = registry(spark, n_parts=30)
    lp = lambda **kw: listing.list_partitions(reg, **kw)
    assert lp().count() == 30
    for n in list(range(1, 30)) + [31]:
        assert lp(count=n).count() == min(n, 30)
    assert lp(offset=20).count() == 10
    assert lp(offset=60).count() == 0
    rows = lp().collect()
    times = [r.created_at for r in rows]
    assert times == sorted(times, reverse=True) and len(set(times)) == 30  # strict created_at DESC
    mid = times[15]
    assert all(r.created_at >= mid for r in lp(start=mid).collect())
    assert all(r.created_at <= mid for r in lp(end=mid).collect())
    assert lp(start=times[-1], end=times[0], count=3).count() == 3
    first = lp(start=times[-1], end=times[0], count=3).orderBy("position").first()
    moved = lp(start=times[-1], end=times[0], count=3, offset=1).orderBy("position").first()
    assert moved.created_at < first.created_at


def test_range_datasets(spark):
    reg = registry(spark, [f"ds{i}" for i in range(30)])
    assert listing.list_datasets(reg).count() == 30
    assert listing.list_datasets(reg, count=5).count() == 5
    page1 = listing.list_datasets(reg, count=5).collect()
    page2 = listing.list_datasets(reg, count=5, offset=5).collect()
    assert min(r.updated_at for r in page1) > max(r.updated_at for r in page2)
    assert [r.position for r in listing.page_datasets(reg, 2, count=5).orderBy("position").collect()] \
        == [11, 12, 13, 14, 15]
    assert listing.list_datasets(reg, offset=28).count() == 2


def _latest(reg):
    return [(r.partition_name, r.created_at) for r in listing.latest_partitions(reg.partitions).collect()]


def test_latest_partition(spark):
    reg = registry(spark)
    assert _latest(reg) == []
    rows = spark.createDataFrame([(1, 1, "A", "u://a", 10)],
                                 "request_id long, dataset_id long, partition_name string, "
                                 "partition_url string, partition_size long")
    reg, _ = mutations.upsert_partitions(reg, rows, "2021-02-01 00:00:00")
    assert _latest(reg) == [("A", dt.datetime(2021, 2, 1))]
    rows = rows.withColumn("partition_name", F.lit("B"))
    reg, _ = mutations.upsert_partitions(reg, rows, "2021-02-02 00:00:00")
    assert _latest(reg) == [("B", dt.datetime(2021, 2, 2))]
    reg = mutations.delete_partitions(reg, spark.createDataFrame([(1, "B")], "dataset_id long, partition_name string"))
    assert _latest(reg) == [("A", dt.datetime(2021, 2, 1))]
    # latest via the alias in find_partitions
    req = spark.createDataFrame([("ds", "latest"), ("ds", "A"), ("ds", "nope"), ("zz", "latest")],
                                "dataset_name string, partition_name string")
    got = {(r.dataset_name, r.partition_name): (r.found, r.resolved_name)
           for r in lookup.find_partitions(reg, req).collect()}
    assert got == {("ds", "latest"): (True, "A"), ("ds", "A"): (True, "A"),
                   ("ds", "nope"): (False, None), ("zz", "latest"): (False, None)}


def test_upsert_keeps_identity(spark):
    reg = registry(spark, n_parts=2)
    rows = spark.createDataFrame([(1, 1, "p00.csv.tar.gz", "u://new", 5), (2, 1, "latest", "u://l", 1),
                                  (3, 1, "fresh", "u://f1", 6), (4, 1, "fresh", "u://f2", 7)],
                                 "request_id long, dataset_id long, partition_name string, "
                                 "partition_url string, partition_size long")
    new, rejected = mutations.upsert_partitions(reg, rows, NOW)
    p = {r.partition_name: r for r in new.partitions.collect()}
    assert p["p00.csv.tar.gz"].partition_id == 1 and p["p00.csv.tar.gz"].created_at == T0
    assert p["p00.csv.tar.gz"].partition_url == "u://new"
    assert p["p00.csv.tar.gz"].updated_at == dt.datetime(2021, 6, 1)
    assert p["fresh"].partition_url == "u://f2" and p["fresh"].partition_id == 3
    assert "latest" not in p
    assert [r.reason for r in rejected.collect()] == ["reserved partition name"]
    assert new.datasets.first().updated_at == dt.datetime(2021, 6, 1)  # an insert touched it


def test_register_from_config(spark, tmp_path):
    here = os.path.dirname(__file__)
    cfg = configs.read_dataset_configs(spark, os.path.join(here, "data", "dd.json"))
    cfg = cfg.withColumn("request_id", F.lit(1).cast("long")).withColumn("manager_id", F.lit(1).cast("long"))
    reg = registry(spark, ["other"])
    new, rejected = mutations.register_datasets(reg, cfg, NOW)
    assert rejected.count() == 0
    row = new.datasets.where("dataset_name = 'tide_levels'").first()
    assert row.dataset_schema == {"harbour": "string", "measured_at": "timestamp", "level_cm": "float"}
    assert (row.dataset_format, row.dataset_compression, row.dataset_classification) == \
        ("csv", "gzip", "public")
    assert row.dataset_id == 2
    # the same config again conflicts with the registered name
    _, rejected = mutations.register_datasets(new, cfg, NOW)
    assert [r.reason for r in rejected.collect()] == ["dataset_name already registered"]
    # export writes one folder per classification and name
    out = str(tmp_path / "export")
    configs.export_configs(new.datasets, out)
    back = spark.read.json(configs.config_path(out, "public", "tide_levels"))
    assert back.first()["schema"]["level_cm"] == "float"


def test_managers(spark):
    reg = registry(spark)
    rows = spark.createDataFrame([(1, "a@registry.test"), (2, "b@elsewhere.org"), (3, "a@registry.test"),
                                  (4, "owner@registry.test")], "request_id long, manager_email string")
    new, rejected = mutations.register_managers(reg, rows, "registry.test", NOW, "s")
    assert {r.request_id: r.reason for r in rejected.collect()} == {
        2: "email outside the domain", 3: "duplicate manager_email in batch",
        4: "manager_email already registered"}
    m = new.managers.where("manager_email = 'a@registry.test'").first()
    assert m.manager_id == 2 and len(m.api_key) == 36
    found = lookup.find_managers(new.managers, spark.createDataFrame([(m.api_key,), ("nope",)], "api_key string"))
    assert {r.api_key: r.found for r in found.collect()} == {m.api_key: True, "nope": False}
    assert set(lookup.manager_public(new.managers).columns) == {"manager_id", "manager_email", "api_key"}


def test_delete_dataset_cascades(spark):
    reg = registry(spark, ["a", "b"], n_parts=3)
    new = mutations.delete_datasets(reg, spark.createDataFrame([("a",), ("missing",)], "dataset_name string"))
    assert [r.dataset_name for r in new.datasets.collect()] == ["b"]
    assert new.partitions.count() == 0   # all three belonged to dataset 1 ('a')
    assert conform(new.partitions, S.PARTITIONS).columns == S.PARTITION_COLUMNS


def test_all_range_combinations(spark):
    """SURVEY 2.6.1: every start/end/count/offset combination, for
    partitions (per dataset) and datasets, against a plain model."""
    import itertools
    reg = registry(spark, [f"ds{i}" for i in range(12)], n_parts=12, part_step_ms=1000)
    parts = sorted(((r.created_at, r.partition_id) for r in reg.partitions.collect()), reverse=True)
    dsets = sorted(((r.updated_at, r.dataset_id, r.created_at) for r in reg.datasets.collect()), reverse=True)
    start_p, end_p = parts[8][0], parts[2][0]
    start_d, end_d = dsets[9][2], dsets[3][2]
    for s, e, c, o in itertools.product([False, True], repeat=4):
        kw = dict(start=start_p if s else None, end=end_p if e else None,
                  count=4 if c else None, offset=2 if o else None)
        want = [pid for t, pid in parts if (not s or t >= start_p) and (not e or t <= end_p)]
        want = want[(2 if o else 0):]
        want = want[:4] if c else want
        got = listing.list_partitions(reg, **kw)
        got = [r.partition_id for r in (got.orderBy("position").collect() if c else got.collect())]
        assert got == want, kw
        kw_d = dict(kw, start=start_d if s else None, end=end_d if e else None)
        want_d = [i for u, i, cr in dsets if (not s or cr >= start_d) and (not e or cr <= end_d)]
        want_d = want_d[(2 if o else 0):]
        want_d = want_d[:4] if c else want_d
        got_d = listing.list_datasets(reg, **kw_d)
        got_d = [r.dataset_id for r in (got_d.orderBy("position").collect() if c else got_d.collect())]
        assert got_d == want_d, kw_d


def test_config_reader_paths(spark, tmp_path):
    """dd.json files are read from a file, a glob or a folder (recursively)."""
    here = os.path.dirname(__file__)
    single = configs.read_dataset_configs(spark, os.path.join(here, "data", "dd.json"))
    by_glob = configs.read_dataset_configs(spark, os.path.join(here, "data", "*.json"))
    by_dir = configs.read_dataset_configs(spark, os.path.join(here, "data"))
    for df in (single, by_glob, by_dir):
        assert [r.name for r in df.collect()] == ["tide_levels"]


def test_many_config_folders_are_listed_by_few_tasks(spark, tmp_path):
    n, setting = 300, spark.conf.get(configs.LISTING)
    rows = spark.range(n).select(
        F.concat(F.lit("d"), F.col("id").cast("string")).alias("dataset_name"), F.lit("public").alias("dataset_classification"),
        F.lit("zip").alias("dataset_compression"), F.lit("csv").alias("dataset_format"), F.lit("x").alias("dataset_desc"),
        F.create_map(F.lit("a"), F.lit("string")).alias("dataset_schema"))
    configs.export_configs(rows, str(tmp_path / "out"))
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        back = configs.read_dataset_configs(spark, str(tmp_path / "out"))
        status = spark.sparkContext.statusTracker()
        tasks = [status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup("listing")
                 for s in status.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < sum(tasks) <= max(32, 4 * spark.sparkContext.defaultParallelism) < n
    assert spark.conf.get(configs.LISTING) == setting
    assert {r.name for r in back.select("name").collect()} == {f"d{i}" for i in range(n)}


def _config_text(name, **more):
    return json.dumps({"name": name, "classification": "public", "compression": "zip", "format": "csv",
                       "description": "é", "schema": {"a": "string"}} | more, ensure_ascii=False)


def _by_sparks_reader(spark, folder):
    return (spark.read.schema(S.DATASET_CONFIG).option("multiLine", True).option("recursiveFileLookup", True)
            .json(folder).withColumn("source", F.input_file_name()))


def test_the_driver_holds_no_config_file(spark, tmp_path):
    n, out = 120, str(tmp_path / "out")
    for i in range(n):
        folder = tmp_path / "out" / "bucket" / ("a" if i % 2 else "b/c") / f"d{i}"
        folder.mkdir(parents=True)
        (folder / "dd.json").write_text(_config_text(f"d{i}"))
    back = configs.read_dataset_configs(spark, out)
    assert not back.inputFiles()
    old = _by_sparks_reader(spark, out)
    assert back.schema == old.schema
    assert sorted(map(str, back.collect())) == sorted(map(str, old.collect())) and back.count() == n


def test_config_folders_read_as_sparks_reader_does(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(configs, "FILES", 5)
    one = _config_text("x")
    files = {
        "a b/c": one, "é  ü": one, "[x]{y}*?": one, "t%3A\\#'\"<^`|&=+$,;@!~()": one, "😀": one, "k=1": one, "_h=1": one,
        "_hidden": one, ".hidden": one, "c._COPYING_": one, "_metadata_of": one, "none": "", "blank": " \n", "lead": " \n" + one,
        "array": f"[{one}, {one}]", "[o]{d,}*? %20": f"[{one}]", "bad array": f"[{one}, 5]", "empty array": "[]", "two": one + one, "null": "null", "cut": one[:40],
        "types": _config_text("x", schema=5, format=7.50, compression=None), "values": _config_text("x", schema={"a": 1, "b": None, "c": {"x": [1]}}),
        "nested name": '{"name": {"x":  1}, "format": NaN}', "text schema": '{"schema": "a"}', "more": _config_text("x", version=1, tags=[1, {}]),
        "twice": '{"name": "a", "name": "b", "schema": {"k": "1", "k": "2"}}', "single": "{'name': 'x'}", "control": '{"name": "a\nb"}', "empty": "{}",
        "bom": one.encode("utf-8-sig"), "utf16": one.encode("utf-16"), "latin": one.encode("latin-1"), "nul": b'{"name": "a\0b"}',
    }
    root = tmp_path / "in é%20"
    for k, v in files.items():
        (root / k).mkdir(parents=True)
        (root / k / "dd.json").write_bytes(v if isinstance(v, bytes) else v.encode())
    for k, v in {"dd.json": one.encode(), "z/dd.json.gz": gzip.compress(one.encode()), "z/plain": one.encode(),
                 "z/_metadata": one.encode(), "z/_x.json": one.encode(), "z/.dd.json.1": one.encode()}.items():
        (root / k).parent.mkdir(exist_ok=True)
        (root / k).write_bytes(v)
    (root / "no files").mkdir()
    (root / "link").symlink_to(root / "k=1")
    (root / "broken").symlink_to(root / "nowhere")
    assert configs._folder(spark, str(root)) is not None
    back, old = configs.read_dataset_configs(spark, str(root)), _by_sparks_reader(spark, str(root))
    assert back.schema == old.schema
    rows = sorted(map(str, old.collect()))
    assert sorted(map(str, back.collect())) == rows and len(rows) > 25
    assert configs._folder(spark, str(tmp_path / "missing")) is None
