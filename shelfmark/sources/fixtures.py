"""Registry and notification inputs derived from the driver's tables.

Every mapping is a projection (plus one grouping for the event datasets), so
its cost grows with the tables and each column can be written the same way
in plain SQL for the oracle.

* managers   ← nation
* datasets   ← customer          (one dataset per customer)
* partitions ← orders            (one partition file per order)
* notifications ← events         (one bucket notification per event)
* event registry ← events        (datasets ``user_<id>`` and their earlier files)
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.formats import domain_value, expected_ext
from ..functions.sizing import spread
from .registry import Registry, conform

# Values of the derived tables.
EMAIL_DOMAIN = "example.com"
BUCKET = "org-datasets-events"
SCHEMA_FIELDS = [
    ("station", "string"),
    ("reading", "float"),
    ("unit", "string"),
    ("taken_on", "date"),
    ("sensor_no", "integer"),
]
DATASETS_EPOCH = "1994-01-01 00:00:00"
EVENT_DATASETS_EPOCH = "2023-12-01 00:00:00"
EVENT_PARTITIONS_EPOCH = "2023-12-15 00:00:00"
# Text that is not base64, for undecodable notifications.
UNDECODABLE = "@@not-base64@@"


# Tables large enough that their row-wise fixture work should use every
# core even when the file has a single row group (see ``spread``).
LARGE_TABLES = {"customer", "orders", "lineitem", "part", "events"}


# Scans of the driver's read-only files, one plan per session and path (a
# DataFrame is an immutable plan; no data is held).
_SCANS: dict[str, tuple[SparkSession, DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    hit = _SCANS.get(path)
    if hit is None or hit[0] is not spark:
        df = spark.read.parquet(path)
        hit = _SCANS[path] = (spark, spread(df) if name in LARGE_TABLES else df)
    return hit[1]


def _ts_plus_seconds(epoch: str, seconds) -> F.Column:
    return F.expr(f"TIMESTAMP_NTZ'{epoch}'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def schema_map(key) -> F.Column:
    """The first ``1 + key % 5`` fields of the fixed field list."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))
                        for k, v in SCHEMA_FIELDS])
    return F.map_from_entries(F.slice(entries, 1, (key % len(SCHEMA_FIELDS) + 1).cast("int")))


def managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    ts = _ts_plus_seconds("1993-01-01 00:00:00", F.col("n_nationkey") * 3600)
    return conform(
        n.select(
            F.col("n_nationkey").alias("manager_id"),
            F.concat(F.lower("n_name"), F.lit("@" + EMAIL_DOMAIN)).alias("manager_email"),
            F.concat(F.lit("key-"), F.col("n_nationkey").cast("string")).alias("api_key"),
            (F.col("n_nationkey") == 0).alias("is_admin"),
            ts.alias("created_at"),
            ts.alias("updated_at"),
        ),
        S.MANAGERS,
    )


def _dataset_columns(key: F.Column) -> dict:
    return {
        "dataset_format": domain_value(S.FORMATS, key % len(S.FORMATS)),
        "dataset_compression": domain_value(S.COMPRESSIONS, key % len(S.COMPRESSIONS)),
        "dataset_classification": domain_value(S.CLASSIFICATIONS, key % len(S.CLASSIFICATIONS)),
        "dataset_schema": schema_map(key),
    }


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    ts = _ts_plus_seconds(DATASETS_EPOCH, key * 60)
    cols = _dataset_columns(key)
    return conform(
        c.select(
            key.alias("dataset_id"),
            F.col("c_name").alias("dataset_name"),
            F.col("c_mktsegment").alias("dataset_desc"),
            *[v.alias(k) for k, v in cols.items()],
            F.col("c_nationkey").alias("manager_id"),
            ts.alias("created_at"),
            ts.alias("updated_at"),
        ),
        S.DATASETS,
    )


def order_file_name() -> F.Column:
    """File name of an order's partition: ``part-<orderkey>.<ext>`` with the
    extension of its customer's dataset format and compression."""
    ds = F.col("o_custkey")
    return F.concat(
        F.lit("part-"), F.col("o_orderkey").cast("string"), F.lit("."),
        expected_ext(domain_value(S.FORMATS, ds % len(S.FORMATS)),
                     domain_value(S.COMPRESSIONS, ds % len(S.COMPRESSIONS))),
    )


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ds = F.col("o_custkey")
    cls = domain_value(S.CLASSIFICATIONS, ds % len(S.CLASSIFICATIONS))
    name = order_file_name()
    return conform(
        o.select(
            F.col("o_orderkey").alias("partition_id"),
            name.alias("partition_name"),
            F.concat(F.lit("lake://"), cls, F.lit("/ds-"), ds.cast("string"),
                     F.lit("/"), name).alias("partition_url"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("partition_size"),
            ds.alias("dataset_id"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderdate").alias("updated_at"),
        ),
        S.PARTITIONS,
    )


def registry(spark: SparkSession, sf_dir: str) -> Registry:
    return Registry(managers(spark, sf_dir), datasets(spark, sf_dir), partitions(spark, sf_dir))


# ---------------------------------------------------------------------------
# Bucket notifications from the events table
# ---------------------------------------------------------------------------

_EVENT_TYPE = {
    "purchase": S.EVENT_FINALIZE,
    "signup": S.EVENT_FINALIZE,
    "view": S.EVENT_METADATA_UPDATE,
    "click": S.EVENT_ARCHIVE,
    "error": S.EVENT_DELETE,
}


def _event_objects(ev: DataFrame) -> DataFrame:
    """Per event: dataset, object name and the notification fields."""
    eid = F.col("event_id")
    ds = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    k = F.get_json_object("props", "$.k").cast("long")
    etype = F.create_map(*[F.lit(x) for kv in _EVENT_TYPE.items() for x in kv])[F.col("event_type")]
    obj = (
        F.when(eid % 211 == 0, F.concat(ds, F.lit("/" + S.CONFIG_FILE)))
        .when(eid % 97 == 0, F.concat(ds, F.lit("/" + S.LATEST)))
        .when(eid % 193 == 0, F.concat(ds, F.lit("/"), ds, F.lit("/"), k.cast("string")))
        .otherwise(F.concat(ds, F.lit("/2024/"), (k % 10).cast("string"), F.lit(".ndjson")))
    )
    size = F.when(eid % 101 == 0, F.lit("n/a")).otherwise(
        F.round(F.col("value") * 100).cast("long").cast("string"))
    overwritten = F.when((etype == S.EVENT_DELETE) & (eid % 5 == 0), (eid + 1).cast("string"))
    return ev.select(
        eid, F.col("ts"), F.col("user_id"), k.alias("k"), etype.alias("event_type"),
        obj.alias("object_id"), size.alias("size"), overwritten.alias("overwritten_by_generation"),
    )


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat notification per event, ``data`` holding base64 JSON."""
    ev = _event_objects(table(spark, sf_dir, "events"))
    eid = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    self_link = F.concat(F.lit(f"https://storage.example.com/b/{BUCKET}/o/"), F.col("object_id"))
    payload = F.struct(
        F.lit("storage#object").alias("kind"),
        F.concat(F.lit(BUCKET + "/"), F.col("object_id"), F.lit("/"), eid.cast("string")).alias("id"),
        self_link.alias("selfLink"),
        F.col("object_id").alias("name"),
        F.lit(BUCKET).alias("bucket"),
        eid.cast("string").alias("generation"),
        F.lit("1").alias("metageneration"),
        F.lit("application/x-ndjson").alias("contentType"),
        ts.alias("timeCreated"),
        ts.alias("updated"),
        F.lit("STANDARD").alias("storageClass"),
        ts.alias("timeStorageClassUpdated"),
        F.col("size").alias("size"),
    )
    data = F.when(eid % 89 == 0, F.lit(UNDECODABLE)).otherwise(
        # without the line breaks that Spark puts in
        F.regexp_replace(F.base64(F.encode(F.to_json(payload), "utf-8")), r"[\r\n]", ""))
    return ev.select(
        F.concat(F.lit("ack-"), eid.cast("string")).alias("ack_id"),
        eid.cast("string").alias("message_id"),
        (ts + F.expr("INTERVAL 1 SECOND")).alias("publish_time"),
        F.col("event_type"),
        ts.alias("event_time"),
        F.col("object_id"),
        F.col("overwritten_by_generation"),
        data.alias("data"),
    )


def envelopes(spark: SparkSession, sf_dir: str, max_messages: int = 50) -> DataFrame:
    """Pull responses: notifications grouped ``max_messages`` at a time (the
    pull size bounds every group), in the wire shape of the pull API."""
    n = notifications(spark, sf_dir)
    msg = F.struct(
        F.col("ack_id").alias("ackId"),
        F.struct(
            F.col("data").alias("data"),
            F.struct(
                F.lit(f"projects/_/buckets/{BUCKET}/notificationConfigs/1").alias("notificationConfig"),
                F.col("event_type").alias("eventType"),
                F.col("event_time").alias("eventTime"),
                F.lit("JSON_API_V1").alias("payloadFormat"),
                F.lit(BUCKET).alias("bucketId"),
                F.col("object_id").alias("objectId"),
                F.col("message_id").alias("objectGeneration"),
                F.col("overwritten_by_generation").alias("overwrittenByGeneration"),
                F.lit(None).cast("string").alias("overwroteGeneration"),
            ).alias("attributes"),
            F.col("message_id").alias("messageId"),
            F.col("publish_time").alias("publishTime"),
        ).alias("message"),
    )
    pull = F.floor(F.col("message_id").cast("long") / max_messages).alias("pull_id")
    return (n.groupBy(pull).agg(F.collect_list(msg).alias("receivedMessages"))
            .select("pull_id", "receivedMessages"))


def event_registry(spark: SparkSession, sf_dir: str) -> Registry:
    """Registry the notifications are folded into: dataset ``user_<id>`` for
    every user with ``user_id % 10 <> 0`` (the rest stay unknown), and as
    earlier files the keys ``2024/<k % 10>.ndjson`` with ``k % 10 < 3``."""
    ev = table(spark, sf_dir, "events")
    users = ev.select("user_id").distinct().where(F.col("user_id") % 10 != 0)
    uid = F.col("user_id")
    cols = _dataset_columns(uid)
    ts = _ts_plus_seconds(EVENT_DATASETS_EPOCH, uid * 60)
    ds = conform(
        users.select(
            uid.alias("dataset_id"),
            F.concat(F.lit("user_"), uid.cast("string")).alias("dataset_name"),
            F.concat(F.lit("events of user "), uid.cast("string")).alias("dataset_desc"),
            *[v.alias(k) for k, v in cols.items()],
            (uid % 25).alias("manager_id"),
            ts.alias("created_at"),
            ts.alias("updated_at"),
        ),
        S.DATASETS,
    )
    slot = (F.get_json_object("props", "$.k").cast("long") % 10).alias("slot")
    keys = (ev.select(uid, slot).where(F.col("slot") < 3).distinct()
            .join(users, "user_id", "left_semi"))
    name = F.concat(F.lit("2024/"), F.col("slot").cast("string"), F.lit(".ndjson"))
    pts = _ts_plus_seconds(EVENT_PARTITIONS_EPOCH, uid * 60 + F.col("slot"))
    parts = conform(
        keys.select(
            (uid * 16 + F.col("slot")).alias("partition_id"),
            name.alias("partition_name"),
            F.concat(F.lit(f"https://storage.example.com/b/{BUCKET}/o/user_"), uid.cast("string"),
                     F.lit("/"), name).alias("partition_url"),
            (F.col("slot") + 1000).alias("partition_size"),
            uid.alias("dataset_id"),
            pts.alias("created_at"),
            pts.alias("updated_at"),
        ),
        S.PARTITIONS,
    )
    return Registry(managers(spark, sf_dir), ds, parts)


def dirty_registry(spark: SparkSession, sf_dir: str) -> Registry:
    """A registry loaded without constraints, for the constraint reports:
    datasets ← part (names repeat, formats are part types, no description
    for one brand, managers up to 50
    of which only 25 exist), partitions ← lineitem (names repeat within a
    dataset, some urls pass 255 characters)."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    ts = _ts_plus_seconds(DATASETS_EPOCH, key * 60)
    ds = conform(p.select(
        key.alias("dataset_id"), F.col("p_name").alias("dataset_name"),
        F.nullif(F.col("p_brand"), F.lit("Brand#13")).alias("dataset_desc"),
        F.lower("p_type").alias("dataset_format"),
        domain_value(S.COMPRESSIONS, F.col("p_size") % 3).alias("dataset_compression"),
        domain_value(S.CLASSIFICATIONS, key % 4).alias("dataset_classification"),
        schema_map(key).alias("dataset_schema"), F.col("p_size").alias("manager_id"),
        ts.alias("created_at"), ts.alias("updated_at")), S.DATASETS)
    li = table(spark, sf_dir, "lineitem")
    parts = conform(li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("partition_id"),
        F.concat(F.lit("line-"), F.col("l_linenumber").cast("string")).alias("partition_name"),
        F.concat(F.lit("lake://lines/"), F.repeat(F.lit("x"), (F.col("l_quantity") * 6).cast("int")))
        .alias("partition_url"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("partition_size"),
        F.col("l_partkey").alias("dataset_id"),
        F.col("l_shipdate").alias("created_at"), F.col("l_shipdate").alias("updated_at")), S.PARTITIONS)
    return Registry(managers(spark, sf_dir), ds, parts)
