"""Bucket notifications: flatten, decode, dead-letter and route (S3, F1-F6,
C1, C7, T3, T5, T7).

All steps are column expressions plus one join of the notifications to the
dataset names; nothing runs per row in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.paths import dataset_of, is_config_object, partition_of
from ..functions.payload import CORRUPT, decode_base64_json, missing_required, parse_size
from ..functions.sizing import small_side, spread

# Actions of the routing table.
UPSERT = "upsert"
REJECT = "reject"
NOOP = "noop"
SKIP = "skip"
DELETE_PARTITION = "delete_partition"
DELETE_DATASET = "delete_dataset"
IGNORE = "ignore"
RETRY = "retry"
DEAD_LETTER = "dead_letter"
ACTIONS = [UPSERT, REJECT, NOOP, SKIP, DELETE_PARTITION, DELETE_DATASET, IGNORE, RETRY, DEAD_LETTER]

_WRITE_EVENTS = [S.EVENT_FINALIZE, S.EVENT_METADATA_UPDATE, S.EVENT_ARCHIVE]


def flatten_envelope(raw: DataFrame) -> DataFrame:
    """S3: one row per received message; a pull without messages (missing
    or empty list) gives no rows. Times become UTC wall-clock values.

    ``missing`` says why an envelope can't be applied: the first required
    field that is absent (or a time that is none). A response that could not
    be read at all gives one row with its text as ``data``, so that it ends
    as a dead letter and not as nothing."""
    unreadable = F.col(S.UNREADABLE) if S.UNREADABLE in raw.columns else F.lit(None).cast("string")
    lost = F.col("receivedMessages").isNull() & unreadable.isNotNull()
    nothing = F.array(F.lit(None).cast(S.MESSAGE))
    m = raw.select(F.explode(F.when(lost, nothing).otherwise(F.col("receivedMessages"))).alias("m"),
                   F.when(lost, unreadable).alias("_lost"))
    a = "m.message.attributes"
    missing = F.lit(None).cast("string")
    for f in reversed(S.ENVELOPE_REQUIRED):
        missing = F.when(F.col(f"m.{f}").isNull(), F.lit("missing field " + f.rpartition(".")[2])).otherwise(missing)
    missing = F.when(F.col("_lost").isNotNull(), F.lit("unreadable pull response")).otherwise(missing)
    return m.select(
        F.col("m.ackId").alias("ack_id"),
        F.col("m.message.messageId").alias("message_id"),
        F.col("m.message.publishTime").cast(S.TS).alias("publish_time"),
        F.col(f"{a}.eventType").alias("event_type"),
        F.col(f"{a}.eventTime").cast(S.TS).alias("event_time"),
        F.col(f"{a}.objectId").alias("object_id"),
        F.col(f"{a}.overwrittenByGeneration").alias("overwritten_by_generation"),
        F.coalesce("m.message.data", "_lost").alias("data"),
        missing.alias("missing"),
    )


def decode_notifications(flat: DataFrame) -> DataFrame:
    """Decode the payload and give each message either a
    ``reason`` (dead letter) or the fields the router needs.

    Reasons: an unreadable response or a required envelope field that is
    missing (flat rows without a column ``missing`` are checked for their
    own columns), undecodable payload, a missing required key, a size that
    is not an integer, an unknown event type, an empty object name. The
    reference retries the first, fails the pull on the next ones and stops
    on a bad size; here each becomes a dead letter and the batch goes on.
    """
    p = F.col("_p")
    size = parse_size(p["size"])
    name = p["name"]
    if "missing" not in flat.columns:
        absent = F.lit(None).cast("string")
        for c in ("event_time", "publish_time", "message_id", "ack_id"):
            absent = F.when(F.col(c).isNull(), F.lit("missing field " + c)).otherwise(absent)
        flat = flat.withColumn("missing", absent)
    reason = (
        F.when(F.col("missing").isNotNull(), F.col("missing"))
        .when(p.isNull() | p[CORRUPT].isNotNull(), F.lit("undecodable payload"))
        .when(missing_required(p).isNotNull(), F.concat(F.lit("missing key "), missing_required(p)))
        .when(size.isNull(), F.lit("size is not an integer"))
        .when(~F.col("event_type").isin(*S.EVENT_TYPES) | F.col("event_type").isNull(),
              F.lit("unknown event type"))
        .when(dataset_of(name).isNull(), F.lit("empty object name"))
    )
    # The payload is parsed once per row: a one-element explode is a plan
    # node that later filters (on ``reason``) cannot be pushed beneath, so
    # Catalyst never copies the parse into each predicate that reads it.
    flat = spread(flat)
    return (
        flat.select(*flat.columns, F.explode(F.array(decode_base64_json("data"))).alias("_p"))
        .select(
            "ack_id", "message_id", "publish_time", "event_type", "event_time",
            "overwritten_by_generation",
            name.alias("object_name"),
            p["selfLink"].alias("self_link"),
            size.alias("size"),
            dataset_of(name).alias("dataset_name"),
            partition_of(name).alias("partition_name"),
            reason.alias("reason"),
        )
    )


def dead_letters(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reason").isNotNull()).select(
        "ack_id", "message_id", "event_time", "object_name", "reason")


def route_events(decoded: DataFrame, datasets: DataFrame, narrow: bool = False) -> DataFrame:
    """Join messages to the current datasets by the first path
    component and pick the action of the routing table; a message with a
    decode ``reason`` is a ``dead_letter``. ``acked`` is false only for
    ``retry`` (left for a later batch).

    ``narrow``: for a materialised batch against a large registry, first cut
    the datasets down to the batch's names (a map-side semi join against
    the checked, broadcast names), so the left join never shuffles the
    whole datasets table. Otherwise AQE picks the join from measured sizes.
    """
    ds = datasets.select("dataset_id", "dataset_name")
    if narrow:
        names = small_side(decoded.select("dataset_name").where(F.col("dataset_name").isNotNull())
                           .distinct())
        ds = ds.join(names, "dataset_name", "left_semi")
    return with_actions(decoded.join(ds, "dataset_name", "left"))


def with_actions(r: DataFrame) -> DataFrame:
    """The routing table for messages that know their ``dataset_id`` (null:
    there is none at that time)."""
    p, et = F.col("partition_name"), F.col("event_type")
    known = F.col("dataset_id").isNotNull()
    too_long = (F.length(p) > S.MAX_NAME) | (F.length("self_link") > S.MAX_URL)
    action = (
        F.when(F.col("reason").isNotNull(), F.lit(DEAD_LETTER))
        .when(known & et.isin(*_WRITE_EVENTS),
               F.when(p.isNull(), F.lit(NOOP))
               .when((p == S.LATEST) | too_long, F.lit(REJECT))
               .otherwise(F.lit(UPSERT)))
        .when(known & (et == S.EVENT_DELETE),
              F.when(F.col("overwritten_by_generation").isNotNull(), F.lit(SKIP))
              .when(p.isNotNull(), F.lit(DELETE_PARTITION))
              .otherwise(F.lit(DELETE_DATASET)))
        .otherwise(unknown_action())
    )
    return r.withColumn("action", action).withColumn("acked", F.col("action") != RETRY)


def unknown_action() -> F.Column:
    """Action for a message whose dataset is not (or no longer) registered:
    a config object or the bare dataset name is acked and ignored, anything
    else waits for the dataset to appear."""
    return (F.when(is_config_object("object_name") | F.col("partition_name").isNull(), F.lit(IGNORE))
            .otherwise(F.lit(RETRY)))


def decode_payload(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F3-F5/C7 as a pair: decodable messages and dead letters."""
    decoded = decode_notifications(flat)
    return decoded.where(F.col("reason").isNull()).drop("reason"), dead_letters(decoded)
