"""The notification loop as Structured Streaming.

Each micro-batch of pull responses is folded into the registry inside
``foreachBatch``:

    flatten → decode → (+ pending messages of newly registered names) → route
    → fold → commit of the rows that changed (+ pending, dead letters)

State is the registry itself. Each version records, for every stream that
has written to the registry, the last batch it holds. Batch ids belong to a
stream's checkpoint, so that a new checkpoint on an old registry starts a
stream of its own. A replayed batch (after a failure between the commit and
the stream's checkpoint) is recognised and skipped even when other commits
made versions in between. Streams, registrations and other mutations may run
side by side: of two that change the same version one commits, the other is
worked out anew on that result (``sources.registry.transact``).
Ordering holds inside a batch only, as in the reference.

Pending messages are only added to. A message can leave when its dataset's
name is registered: a registration notes its names as fresh, and the next
fold takes the pending messages of these names alone, from their buckets, and
drops them there. What a batch costs does not depend on what is pending.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..functions.ids import assign_ids
from ..functions.sizing import small_side
from ..operators import fold, mutations
from ..operators.events import (DEAD_LETTER, DELETE_DATASET, DELETE_PARTITION, RETRY, UPSERT, dead_letters,
                                decode_notifications, flatten_envelope, route_events)
from ..session import checkpoint_dir, materialise
from ..sources import registry as R
from ..sources.configs import export_configs
from ..sources.notifications import read_notifications
from ..sources.registry import (BUCKETS, Changes, Manifest, Registry, buckets_of, commit_snapshot,  # noqa: F401
                                committed_versions, latest_version, load_registry, load_table, manifest, transact)

DECODED, DEAD = S.DECODED, S.DEAD

# Actions that change partition rows (their datasets' buckets are rewritten).
CHANGES = [UPSERT, DELETE_PARTITION, DELETE_DATASET]


def max_partition_id(spark: SparkSession, root: str, version: int) -> int:
    """Largest partition id ever assigned up to ``version``."""
    return manifest(spark, root, version).max_ids.get("partitions", 0)


def last_batches(spark: SparkSession, root: str, version: int) -> dict[str, int]:
    """By stream, the last batch whose messages are all in ``version``."""
    return {s: b for s, b in manifest(spark, root, version).batches.items() if "/" not in s}


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Structured Streaming wrote into a checkpoint folder."""
    row = spark.read.text(os.path.join(checkpoint, "metadata")).first()
    return json.loads(row["value"])["id"]


def init_registry(reg: Registry, root: str, buckets: int = BUCKETS, derived: bool = False) -> None:
    """Write ``reg`` as version 0 unless a version is committed already;
    ``derived``: with the tables of ``sources.derived``."""
    if not committed_versions(reg.datasets.sparkSession, root):
        commit_snapshot(reg, root, buckets, derived)


def _touched(spark: SparkSession, root: str, m: Manifest, buckets: list[int]) -> Registry:
    """The datasets and partitions of some buckets."""
    return Registry(load_table(spark, root, m, "managers"),
                    *(load_table(spark, root, m, t, buckets) for t in R.BUCKETED))


def _names(spark: SparkSession, root: str, m: Manifest, asked: DataFrame) -> DataFrame:
    """The registered names in the buckets of those asked for."""
    return load_table(spark, root, m, "names", buckets_of(asked, "dataset_name", m))


def apply_decoded(spark: SparkSession, decoded: DataFrame, root: str,
                  batch_id: int | None = None, stream: str = "", part: tuple[int, int] = (0, 1),
                  registrations: DataFrame | None = None) -> int:
    """Fold decoded messages (plus pending ones of newly registered names)
    into the newest committed registry and commit the result; returns the
    version. ``batch_id`` (a batch of ``stream``) makes it idempotent: a
    batch of that stream that the newest version already holds is not
    applied again; of a batch in parts, ``part`` is (number, how many), and
    the parts that are in are not. ``registrations``: configs with a time
    ``at`` that belong to the same log (``fold.route_log``)."""
    # decoded once, whatever version it is folded into
    decoded = materialise(decoded.select(*DECODED.fieldNames()))

    def build(m: Manifest):
        batches = dict(m.batches)
        if batch_id is not None:
            done = f"{stream}/{batch_id}"  # parts of a batch under way
            if batch_id <= batches.get(stream, -1) or part[0] < batches.get(done, 0):
                return None, None
            batches[done] = part[0] + 1
            if part[0] + 1 == part[1]:
                del batches[done]
                batches[stream] = batch_id
        batch, fresh = decoded, None
        if m.tables.get("fresh", R.Files()).deltas:
            fresh = small_side(load_table(spark, root, m, "fresh").distinct())
            waiting = load_table(spark, root, m, "pending", buckets_of(fresh, "dataset_name", m))
            revived = waiting.join(fresh, "dataset_name", "left_semi").select(*DECODED.fieldNames())
            batch = materialise(decoded.unionByName(revived))
        # only the buckets of names and datasets that the batch touches are read
        new = None
        if registrations is None:
            routed = route_events(batch, _names(spark, root, m, batch.select("dataset_name")), narrow=True)
        else:
            asked = batch.select("dataset_name").union(registrations.select("name"))
            log = fold.route_log(load_table(spark, root, m, "managers"), _names(spark, root, m, asked), batch,
                                 registrations, m.max_ids.get("datasets", 0))
            routed, new = log.routed, R.conform(log.new, S.DATASETS)
        eff = fold.materialise_batch(routed)
        counts = fold.action_counts(eff)
        changing = eff.where(F.col("action").isin(*CHANGES))
        touched = _touched(spark, root, m, buckets_of(changing, "dataset_id", m))
        if new is not None:
            touched = touched._replace(datasets=touched.datasets.unionByName(new))
        sm = fold.summarise(touched, routed, eff, counts)
        put, drop = fold.changes(touched, sm, m.max_ids.get("partitions", 0), counts, new)
        if counts.get(RETRY):
            put["pending"] = eff.where(F.col("action") == RETRY).select(*DECODED.fieldNames())
        if counts.get(DEAD_LETTER):
            put["dead_letters"] = dead_letters(batch).withColumn("version", F.lit(m.version + 1))
        if fresh is not None:
            drop["pending"] = fresh
        return Changes(put, drop, clear=["fresh"] if fresh is not None else [], batches=batches), None
    return transact(spark, root, build)[0]


def parts_of(decoded: DataFrame, max_messages: int) -> list[DataFrame]:
    """A batch in parts of at most ``max_messages``, in event order, so that
    folding one after the other is folding the batch. Pass a materialised
    batch: it is sampled for the order, then sorted."""
    known = ["event_time", "publish_time", "message_id"]
    rest = F.xxhash64(*[c for c in decoded.columns if c not in known])
    numbered = assign_ids(decoded.withColumn("_tie", rest), [*known, "_tie"], -1, "_n").drop("_tie")
    last = numbered.agg(F.max("_n")).first()[0]
    if last is None:
        return [decoded]
    part = F.floor(F.col("_n") / max_messages)
    return [numbered.where(part == i).drop("_n") for i in range(last // max_messages + 1)]


def apply_batch(root: str, checkpoint: str | None = None, max_messages: int | None = None):
    """The ``foreachBatch`` function for registry ``root``; ``checkpoint``
    is the stream's checkpoint folder, whose id guards against replays. What
    is folded at once never has more than ``max_messages`` messages, as a
    pull hasn't: a larger batch (one file may hold any number) is committed
    part by part, and a restart goes on after the last part."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        decoded = decode_notifications(flatten_envelope(batch)).select(*DECODED.fieldNames())
        stream = stream_id(spark, checkpoint) if checkpoint else ""
        parts = parts_of(materialise(decoded), max_messages) if max_messages else [decoded]
        for i, part in enumerate(parts):
            apply_decoded(spark, part, root, batch_id, stream, (i, len(parts)))
        R.maintain(spark, root)
    return apply


def start_stream(spark: SparkSession, source: str, root: str, checkpoint: str,
                 max_files_per_trigger: int | None = None, available_now: bool = False,
                 processing_time: str = "1 second", max_messages: int | None = None) -> StreamingQuery:
    """The continuous loop (every ``processing_time``, like the 1 s
    pull delay) or, with ``available_now``, one pass over what is there;
    ``max_messages`` bounds what is folded at once."""
    checkpoint_dir(spark)
    stream = read_notifications(spark, source, max_files_per_trigger)
    writer = stream.writeStream.foreachBatch(apply_batch(root, checkpoint, max_messages)) \
        .option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime=processing_time)
    return writer.start()


def retry_pending(spark: SparkSession, root: str) -> int:
    """T4 for a quiet stream: fold the pending messages alone (they may
    match datasets registered since) as a new version; returns it."""
    return apply_decoded(spark, spark.createDataFrame([], DECODED), root)


def current(spark: SparkSession, root: str) -> tuple[Registry, DataFrame]:
    """Newest committed registry and its pending messages."""
    m = manifest(spark, root)
    return load_registry(spark, root, m.version), load_table(spark, root, m, "pending")


def all_dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """All dead letters, with the version that met them."""
    m = manifest(spark, root)
    if m is None:
        return spark.createDataFrame([], R.SPECS["dead_letters"].schema)
    return load_table(spark, root, m, "dead_letters")


def registry_root(spark: SparkSession, name: str) -> str:
    """A registry folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), name)


# ---------------------------------------------------------------------------
# Mutations against the stored registry
# ---------------------------------------------------------------------------

def register_and_commit(spark: SparkSession, root: str, configs: DataFrame, now,
                        config_root: str | None = None) -> tuple[int, DataFrame]:
    """M1 against the stored registry: register dataset configs as a new
    committed version and, with ``config_root``, write each new dataset's
    config file there (S5). Pending messages of the new names are taken up by
    the next batch or ``retry_pending``. Returns (version, rejected)."""
    def build(m: Manifest):
        taken = load_table(spark, root, m, "names", buckets_of(configs, "name", m))
        new, rejected = mutations.new_datasets(load_table(spark, root, m, "managers"), taken, configs, now,
                                               m.max_ids.get("datasets", 0))
        names = new.select("dataset_name", "dataset_id")
        return Changes({"datasets": new, "names": names, "fresh": names.select("dataset_name")}), (new, rejected)
    version, (new, rejected) = transact(spark, root, build)
    if config_root is not None:
        export_configs(new, config_root)
    return version, rejected


def sign_up_and_commit(spark: SparkSession, root: str, rows: DataFrame, domain: str | None, now,
                       secret: str) -> tuple[int, DataFrame]:
    """M2 against the stored registry. Returns (version, rejected)."""
    def build(m: Manifest):
        new, rejected = mutations.new_managers(load_table(spark, root, m, "managers"), rows, domain, now, secret,
                                               m.max_ids.get("managers", 0))
        return Changes({"managers": new}), rejected
    return transact(spark, root, build)


def upsert_and_commit(spark: SparkSession, root: str, rows: DataFrame, now) -> tuple[int, DataFrame]:
    """M3 against the stored registry: reads only the buckets of the
    requests' datasets and writes only the rows that change. Returns
    (version, rejected)."""
    def build(m: Manifest):
        part = _touched(spark, root, m, buckets_of(rows, "dataset_id", m))
        put, rejected = mutations.upsert_changes(part, rows, now, m.max_ids.get("partitions", 0))
        return Changes(put), rejected
    return transact(spark, root, build)


def delete_partitions_and_commit(spark: SparkSession, root: str, requests: DataFrame) -> int:
    """M5 against the stored registry, of which nothing is read: the keys are
    noted as gone. Returns the version."""
    keys = requests.select("dataset_id", "partition_name").dropna().distinct()
    return transact(spark, root, lambda m: (Changes(drop={"partitions": keys}), None))[0]


def delete_datasets_and_commit(spark: SparkSession, root: str, requests: DataFrame) -> int:
    """M6 against the stored registry: one note for each dataset makes its
    partitions go too. Returns the version."""
    def build(m: Manifest):
        asked = small_side(requests.select("dataset_name").dropna().distinct())
        names = load_table(spark, root, m, "names", buckets_of(asked, "dataset_name", m))
        gone = materialise(names.join(asked, "dataset_name", "left_semi"))
        ids = gone.select("dataset_id")
        return Changes(drop={"datasets": ids, "partitions": ids, "names": gone.select("dataset_name")}), None
    return transact(spark, root, build)[0]


def backfill(spark: SparkSession, source: str, root: str, registrations: DataFrame | None = None) -> int:
    """Fold every pull response under ``source`` as one batch (the whole
    log at once, e.g. to rebuild a registry), with the ``registrations``
    (configs and their time ``at``) of that log, and commit it as the next
    version; returns that version."""
    from ..sources.notifications import read_notifications_batch
    decoded = decode_notifications(flatten_envelope(read_notifications_batch(spark, source)))
    return apply_decoded(spark, decoded, root, registrations=registrations)


def compact(spark: SparkSession, root: str) -> int:
    """Every table as base files alone (readers then merge nothing), as a new
    version."""
    return R.compact(spark, root)
