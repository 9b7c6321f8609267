"""The event fold (M3-M8, W4, T2, T4): apply a batch of routed
notifications to a registry at once.

Sequential semantics being reproduced, per message in the order
``o = (event_time, publish_time, message_id)`` and with ``now`` taken as
the message's event_time:

* upsert: insert the partition, or on a (dataset, name) conflict replace
  url and size only (created_at and id stay); updated_at = now. A real
  insert (not a conflict update) also sets the dataset's updated_at = now.
* delete_partition: remove the row if present.
* delete_dataset: remove the dataset and all its partitions; later
  messages of that dataset in the batch see an unknown dataset.
* retry: kept for the next batch (pending); everything else has no effect.

Set form. The batch is range partitioned and sorted by key
``(dataset_id, partition_name)`` and order, and kept so: a task's stretch of
one key is a run, as long as a task is large, and a hot key has many. A run
becomes one row: its first action, its last upsert and delete, and its last
upsert that follows a delete. A key's runs are then put together in order (at
most one a task), each seeing how the one before it ended. Per key:

* ``lu``/``ld``: last upsert / last delete; the key survives iff lu > ld.
* ``fu``: first upsert.
* ``turn``: the last upsert whose previous message of the key is a delete:
  the newest real insert, and the start of the surviving incarnation. Without
  one these are ``fu``, if the key did not exist before the batch.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.ids import assign_ids
from ..functions.sizing import MAX_BROADCAST_ROWS, small_side
from ..session import materialise
from ..sources.registry import Registry, conform
from .events import DEAD_LETTER, DELETE_DATASET, DELETE_PARTITION, RETRY, UPSERT, unknown_action, with_actions
from .mutations import accepted_configs, validate_configs

KEY = ["dataset_id", "partition_name"]


def order_key() -> Column:
    return F.struct("event_time", "publish_time", "message_id")


def effective_actions(routed: DataFrame) -> DataFrame:
    """W4 'gone': messages after the first delete_dataset of their dataset
    are routed as for an unknown dataset. ``gone`` has one row per dataset
    deleted in the batch; when that is proven small it is broadcast, so the
    batch is not shuffled by dataset (where a hot dataset would sit in one
    task). Pass a materialised batch: the size check reads it."""
    routed = routed.withColumn("_o", order_key())
    gone = small_side(routed.where(F.col("action") == DELETE_DATASET)
                      .groupBy("dataset_id").agg(F.min("_o").alias("_gone")))
    after = (F.col("_gone").isNotNull() & (F.col("_o") > F.col("_gone"))
             & (F.col("action") != DEAD_LETTER))
    return (routed.join(gone, "dataset_id", "left")
            .withColumn("action", F.when(after, unknown_action()).otherwise(F.col("action")))
            .withColumn("acked", F.col("action") != RETRY)
            .drop("_gone"))


class Summary(NamedTuple):
    eff: DataFrame       # the batch with effective actions (checkpointed)
    keys: DataFrame      # one row per touched (dataset, partition) key (checkpointed)
    touched: DataFrame   # touched keys, broadcast when small
    deleted: DataFrame   # datasets deleted by the batch, broadcast when small
    small: bool          # touched keys (so also their datasets) proven small


def pending_messages(routed: DataFrame) -> DataFrame:
    """T4: messages left for a later batch (their dataset is unknown)."""
    return materialise_batch(routed).where(F.col("action") == RETRY).drop("_o")


def materialise_batch(routed: DataFrame) -> DataFrame:
    """The routed batch in runs, materialised once (lineage cut), with its
    effective actions; every later pass reads it. The shuffle's partitions
    follow the advisory size, so a run is bounded by bytes."""
    keyed = routed.withColumn("_o", order_key())
    runs = keyed.repartitionByRange(*KEY, "_o").sortWithinPartitions(*KEY, "_o")
    return effective_actions(materialise(runs.withColumn("_run", F.spark_partition_id())))


def action_counts(eff: DataFrame) -> dict[str, int]:
    """Messages by effective action (a handful of rows)."""
    return {r["action"]: r["count"] for r in eff.groupBy("action").count().collect()}


def summarise(reg: Registry, routed: DataFrame, eff: DataFrame | None = None,
              counts: dict[str, int] | None = None) -> Summary:
    """Per-key summary of a batch."""
    if eff is None:
        eff = materialise_batch(routed)
    if counts is None:
        counts = action_counts(eff)
    keyed = eff.where(F.col("action").isin(UPSERT, DELETE_PARTITION)).select(
        *KEY, "_o", "_run", "action", "event_time",
        F.col("self_link").alias("partition_url"), F.col("size").alias("partition_size"))
    is_up = F.col("action") == UPSERT
    is_del = F.col("action") == DELETE_PARTITION
    o = F.col("_o")

    # how many distinct keys (deleted datasets) there can be at most
    n_keys, n_deleted = counts.get(UPSERT, 0) + counts.get(DELETE_PARTITION, 0), counts.get(DELETE_DATASET, 0)
    before = F.lag("action").over(Window.partitionBy(*KEY, "_run").orderBy("_o"))
    runs = keyed.withColumn("_before", before).groupBy(*KEY, "_run").agg(
        F.max(F.when(is_up, o)).alias("lu"), F.max(F.when(is_del, o)).alias("ld"),
        F.min(F.when(is_up, o)).alias("fu"),
        F.max(F.when(is_up & (F.col("_before") == DELETE_PARTITION), o)).alias("turn"),
        F.min_by("action", o).alias("first"), F.min(o).alias("fo"),
        F.max_by(F.when(is_up, F.struct("partition_url", "partition_size", "event_time")),
                 F.when(is_up, o)).alias("last"))
    ends_deleted = F.col("ld").isNotNull() & (F.col("lu").isNull() | (F.col("ld") > F.col("lu")))
    after_delete = F.lag(ends_deleted).over(Window.partitionBy(*KEY).orderBy("fo"))
    # the run's first message is the turn if the run before ends deleted
    turn = F.coalesce("turn", F.when((F.col("first") == UPSERT) & F.coalesce(after_delete, F.lit(False)), F.col("fu")))
    per_key = runs.withColumn("turn", turn).groupBy(*KEY).agg(
        F.max("lu").alias("lu"), F.max("ld").alias("ld"), F.min("fu").alias("fu"), F.max("turn").alias("turn"),
        F.max_by("last", "lu").alias("last"))

    # The registry is large and a batch is not: the batch's keys and deleted
    # datasets are broadcast (after a size check) so the registry is scanned
    # map-side, never shuffled, for every lookup against it.
    small = n_keys <= MAX_BROADCAST_ROWS
    touched = keyed.select(*KEY).distinct()
    touched = F.broadcast(touched) if small else touched
    deleted = eff.where(F.col("action") == DELETE_DATASET).select("dataset_id").distinct()
    deleted = F.broadcast(deleted) if n_deleted <= MAX_BROADCAST_ROWS else deleted
    prior = reg.partitions.join(touched, KEY).select(
        *KEY, F.lit(True).alias("had"), F.col("partition_id").alias("prior_id"),
        F.col("created_at").alias("prior_created"), F.col("updated_at").alias("prior_updated"))
    keys = per_key.join(prior, KEY, "left").withColumn("had", F.coalesce("had", F.lit(False)))
    survives = F.col("lu").isNotNull() & (F.col("ld").isNull() | (F.col("lu") > F.col("ld")))
    last_ins = F.coalesce("turn", F.when(~F.col("had"), F.col("fu")))
    keys = materialise(keys.withColumn("survives", survives).withColumn("last_ins", last_ins)
                       .withColumn("fa", F.coalesce("turn", "fu")))
    return Summary(eff, keys, touched, deleted, small)


def _fresh_datasets(reg: Registry, sm: Summary) -> DataFrame:
    """The datasets whose updated_at the batch raises to the newest real
    partition insert (M8)."""
    fresh = (sm.keys.where(F.col("last_ins").isNotNull())
             .groupBy("dataset_id").agg(F.max(F.col("last_ins.event_time")).alias("_fresh")))
    # one row per dataset with touched keys: bounded when the keys are
    return (reg.datasets.join(sm.deleted, "dataset_id", "left_anti")
            .join(F.broadcast(fresh) if sm.small else fresh, "dataset_id")
            .where(F.col("_fresh") > F.col("updated_at"))
            .withColumn("updated_at", F.col("_fresh")).drop("_fresh"))


def _put_partitions(reg: Registry, sm: Summary, base_id: int) -> DataFrame:
    """Surviving keys: rows that keep their identity, and new incarnations
    with fresh ids above ``base_id``."""
    keys = sm.keys.join(sm.deleted, "dataset_id", "left_anti").where("survives")
    kept = F.col("had") & F.col("ld").isNull()
    cols = [F.col("last.partition_url").alias("partition_url"), F.col("last.partition_size").alias("partition_size")]
    # a kept row's updated_at never moves back (a late message is older)
    same = keys.where(kept).select(
        *KEY, F.col("prior_id").alias("partition_id"), F.col("prior_created").alias("created_at"), *cols,
        F.greatest("prior_updated", F.col("last.event_time")).alias("updated_at"))
    fresh = keys.where(~kept).select(*KEY, F.col("fa.event_time").alias("created_at"), *cols,
                                     F.col("last.event_time").alias("updated_at"))
    new = assign_ids(fresh, ["created_at", "dataset_id", "partition_name"], base_id, "partition_id")
    return conform(same, S.PARTITIONS).unionByName(conform(new, S.PARTITIONS))


def changes(reg: Registry, sm: Summary, base_id: int, counts: dict[str, int],
            new: DataFrame | None = None) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """What a stored registry has to note of a batch: (rows to put, keys to
    drop), by table; only what the batch's actions (``counts``) can change. A
    deleted dataset's partitions go with its id. ``new``: the datasets among
    ``reg``'s that the batch itself registered."""
    put, drop = {}, {}
    ids = sm.deleted.select("dataset_id")
    if counts.get(UPSERT):
        put = {"datasets": conform(_fresh_datasets(reg, sm), S.DATASETS), "partitions": _put_partitions(reg, sm, base_id)}
    if counts.get(DELETE_PARTITION):
        drop["partitions"] = sm.keys.where(F.col("had") & ~F.col("survives")).select(*KEY)
    if counts.get(DELETE_DATASET):
        whole = ids.withColumn("partition_name", F.lit(None).cast("string"))
        drop["partitions"] = drop["partitions"].unionByName(whole) if "partitions" in drop else whole
        drop["datasets"] = ids
        drop["names"] = reg.datasets.join(sm.deleted, "dataset_id", "left_semi").select("dataset_name")
    if new is not None:
        left = new.join(sm.deleted, "dataset_id", "left_anti")
        put["names"] = left.select("dataset_name", "dataset_id")
        put["fresh"] = left.select("dataset_name")
        if "datasets" in put:
            raised = put["datasets"]
            put["datasets"] = raised.unionByName(
                conform(left.join(raised.select("dataset_id"), "dataset_id", "left_anti"), S.DATASETS))
        else:
            put["datasets"] = left
        if "names" in drop:  # a name that goes and comes back is not dropped
            drop["names"] = drop["names"].join(put["fresh"], "dataset_name", "left_anti").distinct()
    return put, drop


def folded_datasets(reg: Registry, sm: Summary) -> DataFrame:
    """Datasets after the batch."""
    fresh = conform(_fresh_datasets(reg, sm), S.DATASETS)
    ids = F.broadcast(fresh.select("dataset_id")) if sm.small else fresh.select("dataset_id")
    return conform(reg.datasets.join(sm.deleted, "dataset_id", "left_anti")
                   .join(ids, "dataset_id", "left_anti"), S.DATASETS).unionByName(fresh)


def folded_partitions(reg: Registry, sm: Summary, base_id: int | None = None) -> DataFrame:
    """Partitions after the batch: untouched rows and those of surviving
    keys, whose new ids follow ``base_id`` (default: the largest in ``reg``)."""
    base = base_id if base_id is not None else (reg.partitions.agg(F.max("partition_id")).first()[0] or 0)
    untouched = reg.partitions.join(sm.touched, KEY, "left_anti").join(sm.deleted, "dataset_id", "left_anti")
    return conform(untouched, S.PARTITIONS).unionByName(_put_partitions(reg, sm, base))


def fold_events(reg: Registry, routed: DataFrame) -> tuple[Registry, DataFrame]:
    """Apply ``routed`` (output of ``route_events``) to ``reg``. Returns the
    new registry and the pending (retry) messages."""
    sm = summarise(reg, routed)
    pending = sm.eff.where(F.col("action") == RETRY).drop("_o")
    return Registry(reg.managers, folded_datasets(reg, sm), folded_partitions(reg, sm)), pending


# ---------------------------------------------------------------------------
# Registrations in the log
# ---------------------------------------------------------------------------

class Log(NamedTuple):
    routed: DataFrame    # messages with the dataset that is registered at their time
    new: DataFrame       # datasets that the log registers (deleted ones too)
    rejected: DataFrame  # registrations that were refused, with the reason


def _registered_at() -> Column:
    """A registration's place in event order: before the messages of its time."""
    return F.struct(F.col("at").cast(S.TS).alias("event_time"),
                    F.lit("0001-01-01").cast(S.TS).alias("publish_time"),
                    F.lpad(F.col("request_id").cast("string"), 20, "0").alias("message_id"))


def route_log(managers: DataFrame, names: DataFrame, decoded: DataFrame, registrations: DataFrame,
              base_id: int) -> Log:
    """Messages and dataset registrations (configs with a time ``at``) of one
    log, in event order: a registration is refused while its name is taken, a
    deletion of a dataset frees the name, and each message belongs to the
    dataset that has its name at that time (or to none, as in
    ``route_events``).

    ``names`` (dataset_name, dataset_id) is what is registered before; new ids
    follow ``base_id``. Only registrations and deletions of datasets, a few
    rows a name, go through a window; the messages meet the spans of their
    name's datasets in one join, whose side is broadcast if proven small.
    """
    valid = validate_configs(registrations, managers).withColumn("_o", _registered_at())
    wanted = valid.where(F.col("_reason").isNull())
    asked = small_side(decoded.select("dataset_name").unionByName(wanted.select(F.col("name").alias("dataset_name")))
                       .dropna().distinct())
    names = names.select("dataset_name", "dataset_id").join(asked, "dataset_name", "left_semi")
    deletes = decoded.where((F.col("event_type") == S.EVENT_DELETE) & F.col("partition_name").isNull()
                            & F.col("overwritten_by_generation").isNull() & F.col("reason").isNull()
                            & F.col("dataset_name").isNotNull())
    turns = (wanted.select(F.col("name").alias("dataset_name"), "_o", F.col("request_id").alias("_request"))
             .unionByName(deletes.select("dataset_name", order_key().alias("_o"), F.lit(None).cast("long").alias("_request"))))
    w = Window.partitionBy("dataset_name").orderBy("_o")
    opens = F.col("_request").isNotNull()
    taken = F.coalesce(F.lag(opens).over(w), F.col("dataset_id").isNotNull())
    turns = materialise(turns.join(names, "dataset_name", "left")
                        .withColumn("_taken", taken).withColumn("_opens", opens))
    refused = turns.where("_opens AND _taken").select(F.col("_request").alias("request_id"))
    rejected = (valid.where(F.col("_reason").isNotNull()).select("request_id", "name", F.col("_reason").alias("reason"))
                .unionByName(valid.join(refused, "request_id", "left_semi").select(
                    "request_id", "name", F.lit("dataset_name already registered").alias("reason"))))
    opened = turns.where("_opens AND NOT _taken").select(F.col("_request").alias("request_id"))
    new = materialise(assign_ids(accepted_configs(wanted.join(opened, "request_id", "left_semi"), F.col("at")),
                                 ["created_at", "request_id"], base_id, "dataset_id"))

    # only what changes a name's state: it opens if free, closes if taken
    state = turns.where("_opens <> _taken")
    spans = (state.withColumn("_to", F.lead("_o").over(w)).where("_opens").select(
        "dataset_name", F.col("_request").alias("request_id"), F.col("_o").alias("_from"), "_to")
        .join(new.select("request_id", "dataset_id"), "request_id").drop("request_id"))
    first = state.where("NOT _opens").groupBy("dataset_name").agg(F.min("_o").alias("_to"))
    before = names.join(first, "dataset_name", "left").select(
        "dataset_name", F.lit(None).cast(turns.schema["_o"].dataType).alias("_from"), "_to", "dataset_id")
    spans = small_side(materialise(spans.unionByName(before)).withColumnRenamed("dataset_name", "_name"))
    o = order_key()
    inside = ((F.col("dataset_name") == F.col("_name")) & (F.col("_from").isNull() | (o > F.col("_from")))
              & (F.col("_to").isNull() | (o <= F.col("_to"))))
    routed = with_actions(decoded.join(spans, inside, "left").drop("_name", "_from", "_to"))
    return Log(routed, new, rejected)


def fold_log(reg: Registry, decoded: DataFrame, registrations: DataFrame) -> tuple[Registry, DataFrame, DataFrame]:
    """Apply messages and registrations of one log to ``reg``. Returns the
    new registry, the pending messages and the refused registrations."""
    base = reg.datasets.agg(F.max("dataset_id")).first()[0] or 0
    log = route_log(reg.managers, reg.datasets, materialise(decoded), registrations, base)
    reg = reg._replace(datasets=reg.datasets.unionByName(conform(log.new, S.DATASETS)))
    return *fold_events(reg, log.routed), log.rejected
