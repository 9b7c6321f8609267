"""Inputs that must not vanish, stop a batch or reach the registry."""

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from shelfmark import schemas as S
from shelfmark.operators import events, listing, lookup, mutations, quality
from shelfmark.sources import notifications
from shelfmark.sources.registry import Registry
from shelfmark.streaming import stream

T0 = dt.datetime(2024, 1, 1)


def registry(spark, n_parts=0):
    managers = spark.createDataFrame([(1, "m@x.org", "k", False, T0, T0)], S.MANAGERS)
    datasets = spark.createDataFrame([(i, f"d{i}", "d", "csv", "zip", "public", {}, 1, T0, T0) for i in (1, 2)],
                                     S.DATASETS)
    parts = spark.range(n_parts).select(
        (F.col("id") + 1).alias("partition_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("partition_name"),
        F.lit("u").alias("partition_url"), F.lit(1).cast("long").alias("partition_size"),
        F.when(F.col("id") % 10 == 0, 2).otherwise(1).cast("long").alias("dataset_id"),
        F.lit(T0).cast(S.TS).alias("created_at"), F.lit(T0).cast(S.TS).alias("updated_at"))
    return Registry(managers, datasets, parts)


def message(i, **attributes):
    a = {"notificationConfig": "c", "eventType": "OBJECT_FINALIZE", "eventTime": "2024-01-01T00:00:00Z",
         "payloadFormat": "JSON_API_V1", "bucketId": "b", "objectId": "d1/f", "objectGeneration": "1"} | attributes
    return {"ackId": f"a{i}", "message": {"data": "e30=", "attributes": a, "messageId": f"m{i}",
                                          "publishTime": "2024-01-01T00:00:00Z"}}


def test_unreadable_responses_and_fields_are_dead_letters(spark):
    folder = tempfile.mkdtemp(prefix="pull-")
    good = {"receivedMessages": [message(1), message(2, eventTime="yesterday"), message(3, objectId=None)]}
    with open(os.path.join(folder, "a.json"), "w") as f:
        f.write(json.dumps(good) + "\n" + json.dumps(good)[:60] + "\n{}\n")
    flat = events.flatten_envelope(notifications.read_notifications_batch(spark, folder))
    got = {r.message_id: r.reason for r in events.dead_letters(events.decode_notifications(flat)).collect()}
    assert got == {"m1": "missing key kind", "m2": "missing field eventTime", "m3": "missing field objectId",
                   None: "unreadable pull response"}


def decoded(spark, name):
    return spark.createDataFrame([("a", f"m-{name}", T0, S.EVENT_FINALIZE, T0, None, f"d1/{name}", "u", 1, "d1",
                                   name, None)], stream.DECODED)


def test_batches_of_another_stream_are_applied(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="streams-"), "r")
    stream.init_registry(registry(spark), root)
    assert stream.apply_decoded(spark, decoded(spark, "x"), root, 1, "one") == 1
    assert stream.apply_decoded(spark, decoded(spark, "y"), root, 0, "two") == 2     # a new checkpoint
    assert stream.apply_decoded(spark, decoded(spark, "y"), root, 0, "two") == 2     # a replay
    assert stream.apply_decoded(spark, decoded(spark, "x"), root, 1, "one") == 2
    assert stream.last_batches(spark, root, 2) == {"one": 1, "two": 0}
    reg, _ = stream.current(spark, root)
    assert sorted(r.partition_name for r in reg.partitions.collect()) == ["x", "y"]


def test_committed_mutations_and_dead_letters(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="commit-"), "r")
    stream.init_registry(registry(spark, 20), root)
    dead = decoded(spark, "z").withColumn("reason", F.lit("undecodable payload"))
    stream.apply_decoded(spark, dead.select(*stream.DECODED.fieldNames()), root)
    rows = spark.createDataFrame([(1, 1, "new", "u", 5), (2, 1, "p1", "v", 6), (3, None, "n", "u", 1),
                                  (4, 1, None, "u", 1), (5, 2, "n", None, 1), (6, 2, "n", "u", None)],
                                 "request_id long, dataset_id long, partition_name string, partition_url string, "
                                 "partition_size long")
    _, rejected = stream.upsert_and_commit(spark, root, rows, "2024-02-01 00:00:00")
    assert {r.request_id: r.reason for r in rejected.collect()} == dict.fromkeys((3, 4, 5, 6), "missing field")
    stream.delete_partitions_and_commit(spark, root, spark.createDataFrame(
        [(1, "p2"), (1, "none")], "dataset_id long, partition_name string"))
    stream.sign_up_and_commit(spark, root, spark.createDataFrame([(1, "b@x.org")], "request_id long, manager_email string"),
                              "x.org", "2024-02-01 00:00:00", "secret")
    reg, _ = stream.current(spark, root)
    parts = {r.partition_name: (r.partition_id, r.partition_url) for r in reg.partitions.collect()}
    assert len(parts) == 20 and "p2" not in parts
    assert parts["new"] == (21, "u") and parts["p1"] == (2, "v")
    assert reg.managers.count() == 2
    stream.delete_datasets_and_commit(spark, root, spark.createDataFrame([("d1",)], "dataset_name string"))
    reg, _ = stream.current(spark, root)
    assert [r.dataset_id for r in reg.datasets.collect()] == [2]
    assert {r.dataset_id for r in reg.partitions.collect()} == {2}
    # dead letters of older versions can still be read
    assert [(r.message_id, r.version) for r in stream.all_dead_letters(spark, root).collect()] == [("m-z", 1)]


def test_search_paths_agree(spark):
    reg = registry(spark)
    names = ["abc", "abc%", "a_c", "x", "", "zzab\\c"]
    ds = spark.createDataFrame([(i, n, "d", "csv", "zip", "public", {}, 1, T0, T0) for i, n in enumerate(names)], S.DATASETS)
    reg = reg._replace(datasets=ds)
    terms = spark.createDataFrame([(t,) for t in ["abc\\", "a", "ab", "%", "", "__", "___%", "b_", "\\%", "c", "b\\\\", "q"]],
                                  "term string")
    loop = lookup.search_datasets(reg, terms)
    index = lookup.search_datasets(reg, terms, max_broadcast=0)
    pairs = lambda df: sorted((r.term, r.dataset_name) for r in df.collect())
    assert pairs(loop) == pairs(index)
    assert [n for t, n in pairs(loop) if t == "abc\\"] == ["abc%"]


def test_request_without_a_name_finds_nothing(spark):
    req = spark.createDataFrame([("d1", None), ("d1", "latest")], "dataset_name string, partition_name string")
    got = {r.partition_name: r.found for r in lookup.find_partitions(registry(spark, 20), req).collect()}
    assert got == {None: False, "latest": True}


def test_deep_pages_have_no_single_task(spark):
    reg = registry(spark, 3000)
    w = listing.partition_order()
    want = [r.partition_id for r in reg.partitions.where("dataset_id = 1").orderBy(*w).collect()]
    deep = listing.list_partitions(reg, count=1500, offset=5)
    assert "Window" not in deep._jdf.queryExecution().executedPlan().toString()
    got = {r.position: r.partition_id for r in deep.where("dataset_id = 1").collect()}
    assert got == {i + 1: want[i] for i in range(5, 1505)}
    rest = listing.list_partitions(reg, offset=1200)
    assert rest.where("dataset_id = 1").count() == 1500 and rest.where("dataset_id = 2").count() == 0
    many = spark.range(25_000).select(F.col("id").alias("dataset_id"), (F.col("id") % 7).alias("updated_at"))
    page = listing.page(many, listing.dataset_order(), ["dataset_id"], count=3, offset=20_000)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "SinglePartition" not in plan
    want = [r.dataset_id for r in many.orderBy(*listing.dataset_order()).collect()][20_000:20_003]
    assert [(r.position, r.dataset_id) for r in page.collect()] == list(zip((20_001, 20_002, 20_003), want))


def test_null_keys_break_no_unique_rule(spark):
    reg = registry(spark)
    m = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "x", "c"), (4, "x", "d")],
                              "manager_id long, manager_email string, api_key string")
    full = m.select("*", F.lit(False).alias("is_admin"), F.lit(T0).cast(S.TS).alias("created_at"),
                    F.lit(T0).cast(S.TS).alias("updated_at"))
    got = quality.unique_violations(reg._replace(managers=full)).collect()
    assert [(r.rule, r.key) for r in got] == [("managers unique(manager_email)", "x")]


def test_api_keys_depend_on_the_secret(spark):
    reg = registry(spark)
    rows = spark.createDataFrame([(1, "b@x.org")], "request_id long, manager_email string")
    keys = {s: mutations.register_managers(reg, rows, "x.org", "2024-01-01 00:00:00", s)[0].managers
            .where("manager_email = 'b@x.org'").first().api_key for s in ("one", "two")}
    assert keys["one"] != keys["two"]
