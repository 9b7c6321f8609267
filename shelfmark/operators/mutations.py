"""Registry mutations as DataFrame transforms.

Each takes a registry and a DataFrame of requests and returns a new
registry (plus the rejected requests with a reason). ``now`` is passed in so
results are reproducible. Requests carry a ``request_id`` that orders them:
where two requests collide, the earlier one wins, as it would have in a
sequence of single-row calls. A ``request_id`` identifies one request (unique).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.formats import email_in_domain, generated_name
from ..functions.ids import assign_ids
from ..functions.sizing import small_side
from ..session import materialise
from ..sources.registry import Registry, conform


def _ts(now) -> Column:
    return F.lit(now).cast(S.TS)


def _max_id(df: DataFrame, col: str) -> int:
    return df.agg(F.max(col)).first()[0] or 0


def _decide(df: DataFrame, invalid: Column, taken: DataFrame, key: str) -> DataFrame:
    """Add ``reason``: invalid request, key already registered (J5), or a
    later duplicate in the same batch; NULL means accepted."""
    df = df.withColumn("_invalid", invalid)
    # registered keys among the requested ones: the registry is scanned
    # map-side against the (checked) small request keys, not aggregated
    asked = small_side(df.select(key).distinct())
    hits = taken.select(key).join(asked, key, "left_semi").distinct()
    df = df.join(hits.withColumn("_taken", F.lit(True)), key, "left")
    # the earliest valid request of each key: a grouped minimum, whose ids
    # (one a key) then mark their rows; request ids are unique, so neither
    # side of the join has a hot key
    first = (df.where(F.col("_invalid").isNull()).groupBy(key).agg(F.min("request_id").alias("request_id"))
             .select("request_id", F.lit(True).alias("_is_first")))
    df = df.join(first, "request_id", "left").withColumn("_is_first", F.coalesce("_is_first", F.lit(False)))
    reason = (F.when(F.col("_invalid").isNotNull(), F.col("_invalid"))
              .when(F.col("_taken").isNotNull(), F.lit(f"{key} already registered"))
              .when(~F.col("_is_first"), F.lit(f"duplicate {key} in batch")))
    return df.withColumn("reason", reason).drop("_invalid", "_taken", "_is_first")


def validate_configs(configs: DataFrame, managers: DataFrame) -> DataFrame:
    """Dataset configs with the first rule each one breaks (C3-C5, F8: enum
    values match exactly, unknown manager) in ``_reason``, or NULL."""
    c = configs
    mids = managers.select("manager_id").withColumn("_mgr", F.lit(True))
    c = c.join(mids, "manager_id", "left")
    reason = (
        F.when(F.col("name").isNull() | F.col("description").isNull() | F.col("schema").isNull(),
               F.lit("missing field"))
        .when(F.length("name") > S.MAX_NAME, F.lit("name too long"))
        .when(~F.col("format").isin(*S.FORMATS) | F.col("format").isNull(), F.lit("unknown format"))
        .when(~F.col("compression").isin(*S.COMPRESSIONS) | F.col("compression").isNull(),
              F.lit("unknown compression"))
        .when(~F.col("classification").isin(*S.CLASSIFICATIONS) | F.col("classification").isNull(),
              F.lit("unknown classification"))
        .when(F.col("_mgr").isNull(), F.lit("unknown manager"))
    )
    return c.withColumn("_reason", reason).drop("_mgr")


def accepted_configs(configs: DataFrame, at: Column) -> DataFrame:
    """Accepted configs as dataset rows without an id, created at ``at``."""
    return configs.select(
        "request_id",
        F.col("name").alias("dataset_name"),
        F.col("description").alias("dataset_desc"),
        F.col("format").alias("dataset_format"),
        F.col("compression").alias("dataset_compression"),
        F.col("classification").alias("dataset_classification"),
        F.col("schema").alias("dataset_schema"),
        "manager_id",
        at.cast(S.TS).alias("created_at"),
        at.cast(S.TS).alias("updated_at"),
    )


def new_datasets(managers: DataFrame, taken: DataFrame, configs: DataFrame, now,
                 base: int) -> tuple[DataFrame, DataFrame]:
    """(accepted datasets with ids after ``base``, rejected requests)
    of dataset configs (``request_id, manager_id, name, format, compression,
    classification, description, schema``); ``taken`` holds the registered
    ``dataset_name``."""
    v = validate_configs(configs, managers).withColumnRenamed("name", "dataset_name")
    decided = _decide(v, F.col("_reason"), taken, "dataset_name").drop("_reason")
    rejected = decided.where(F.col("reason").isNotNull()).select(
        "request_id", F.col("dataset_name").alias("name"), "reason")
    accepted = accepted_configs(decided.where(F.col("reason").isNull()).withColumnRenamed("dataset_name", "name"),
                                _ts(now))
    return conform(assign_ids(accepted, ["request_id"], base, "dataset_id"), S.DATASETS), rejected


def register_datasets(reg: Registry, configs: DataFrame, now) -> tuple[Registry, DataFrame]:
    """Insert dataset configs."""
    new, rejected = new_datasets(reg.managers, reg.datasets, configs, now, _max_id(reg.datasets, "dataset_id"))
    return reg._replace(datasets=reg.datasets.unionByName(new)), rejected


def api_key_for(email, request_id, secret: str) -> Column:
    """UUID-shaped key: a hash keyed by the caller's secret. Nobody without
    the secret can compute it, and recomputation after a lost executor gives
    the same key, which a random UUID would not."""
    h = F.sha2(F.concat_ws(":", F.lit(secret), email, request_id.cast("string")), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def new_managers(managers: DataFrame, rows: DataFrame, domain: str | None, now, secret: str,
                 base: int) -> tuple[DataFrame, DataFrame]:
    """(accepted managers with ids after ``base``, rejected requests)
    of sign-ups (``request_id, manager_email``); the address must contain
    ``@domain`` and be unique; passwords are not handled. API keys are hashes
    keyed by ``secret``."""
    email = F.col("manager_email")
    invalid = (F.when(email.isNull(), F.lit("missing field"))
               .when(F.length(email) > S.MAX_EMAIL, F.lit("email too long"))
               .when(~email_in_domain(email, domain), F.lit("email outside the domain")))
    decided = _decide(rows, invalid, managers, "manager_email")
    rejected = decided.where(F.col("reason").isNotNull()).select("request_id", "manager_email", "reason")
    accepted = decided.where(F.col("reason").isNull()).select(
        "request_id", "manager_email",
        api_key_for(email, F.col("request_id"), secret).alias("api_key"),
        F.lit(False).alias("is_admin"), _ts(now).alias("created_at"), _ts(now).alias("updated_at"))
    return conform(assign_ids(accepted, ["request_id"], base, "manager_id"), S.MANAGERS), rejected


def register_managers(reg: Registry, rows: DataFrame, domain: str | None, now,
                      secret: str) -> tuple[Registry, DataFrame]:
    """Insert managers."""
    new, rejected = new_managers(reg.managers, rows, domain, now, secret, _max_id(reg.managers, "manager_id"))
    return reg._replace(managers=reg.managers.unionByName(new)), rejected


def upsert_changes(reg: Registry, rows: DataFrame, now, base_id: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Register partitions (``request_id, dataset_id,
    partition_name, partition_url, partition_size``). A (dataset, name)
    that exists keeps id and created_at and takes url and size; a new one
    is inserted, with an id after ``base_id``, and raises its dataset's
    updated_at. The latest request per key wins. ``latest``, over-long or
    missing values and unknown datasets are rejected. Returns the rows that
    change, by table, and the rejected requests."""
    key = ["dataset_id", "partition_name"]
    ds = reg.datasets.select("dataset_id").withColumn("_known", F.lit(True))
    r = rows.join(ds, "dataset_id", "left")
    missing = None
    for c in ("dataset_id", "partition_name", "partition_url", "partition_size"):
        missing = F.col(c).isNull() if missing is None else missing | F.col(c).isNull()
    reason = (F.when(missing, F.lit("missing field"))
              .when(F.col("_known").isNull(), F.lit("unknown dataset"))
              .when(F.col("partition_name") == S.LATEST, F.lit("reserved partition name"))
              .when((F.length("partition_name") > S.MAX_NAME) | (F.length("partition_url") > S.MAX_URL),
                    F.lit("value too long")))
    r = r.withColumn("reason", reason).drop("_known")
    rejected = r.where(F.col("reason").isNotNull()).select("request_id", *key, "reason")
    # latest request per key; equal request ids are ordered by their values
    # so the choice never depends on arrival order
    last = materialise(r.where(F.col("reason").isNull()).groupBy(*key)
                       .agg(F.max(F.struct("request_id", "partition_url", "partition_size")).alias("v"))
                       .select(*key, F.col("v.partition_url").alias("partition_url"),
                               F.col("v.partition_size").alias("partition_size")))
    # the registry is scanned once, map-side where the requests are few; only
    # its rows that are asked for go on
    hits = reg.partitions.select(*key, "partition_id", "created_at").join(
        small_side(last.select(*key)), key, "left_semi")
    both = materialise(last.join(hits, key, "left").withColumn("updated_at", _ts(now)))
    kept = both.where(F.col("partition_id").isNotNull())
    inserted = assign_ids(both.where(F.col("partition_id").isNull()).drop("partition_id")
                          .withColumn("created_at", _ts(now)), key, base_id, "partition_id")
    touched = small_side(inserted.select("dataset_id").distinct())
    fresh = (reg.datasets.join(touched, "dataset_id", "left_semi")
             .withColumn("updated_at", F.greatest("updated_at", _ts(now))))
    return {"partitions": conform(kept, S.PARTITIONS).unionByName(conform(inserted, S.PARTITIONS)),
            "datasets": conform(fresh, S.DATASETS)}, rejected


def put_rows(table: DataFrame, put: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with the rows of ``put`` in place of those of their keys."""
    return table.join(small_side(put.select(*key)), key, "left_anti").unionByName(put)


def upsert_partitions(reg: Registry, rows: DataFrame, now, base_id: int | None = None) -> tuple[Registry, DataFrame]:
    """M3/M7/M8/C1 on a registry; ids follow ``base_id`` (default: the largest
    id in ``reg``, which must then hold all partitions)."""
    base = _max_id(reg.partitions, "partition_id") if base_id is None else base_id
    put, rejected = upsert_changes(reg, rows, now, base)
    return reg._replace(datasets=put_rows(reg.datasets, put["datasets"], ["dataset_id"]),
                        partitions=put_rows(reg.partitions, put["partitions"], ["dataset_id", "partition_name"])), rejected


def delete_partitions(reg: Registry, requests: DataFrame) -> Registry:
    """M5: remove (dataset_id, partition_name) rows; a missing row is not an
    error and the dataset's updated_at does not change."""
    key = ["dataset_id", "partition_name"]
    asked = small_side(requests.select(*key).distinct())   # registry scanned map-side when small
    return reg._replace(partitions=reg.partitions.join(asked, key, "left_anti"))


def delete_datasets(reg: Registry, requests: DataFrame) -> Registry:
    """Remove datasets by name and, by cascade, their partitions."""
    asked = small_side(requests.select("dataset_name").distinct())
    gone = small_side(reg.datasets.join(asked, "dataset_name", "left_semi").select("dataset_id"))
    return reg._replace(datasets=reg.datasets.join(gone, "dataset_id", "left_anti"),
                        partitions=reg.partitions.join(gone, "dataset_id", "left_anti"))


def generate_datasets(numbers: DataFrame, template: dict, now) -> DataFrame:
    """One config per row of ``numbers`` (column ``i``) from a
    template config, named ``<name>_<i>_<timestamp>``."""
    schema = F.create_map(*[F.lit(x) for kv in sorted(template["schema"].items()) for x in kv])
    return numbers.select(
        F.col("i").alias("request_id"),
        generated_name(F.lit(template["name"]), F.col("i"), _ts(now)).alias("name"),
        F.lit(template["classification"]).alias("classification"),
        F.lit(template["compression"]).alias("compression"),
        F.lit(template["format"]).alias("format"),
        F.lit(template["description"]).alias("description"),
        schema.alias("schema"),
    )


def generate_n_datasets(spark, template: dict, n: int, now) -> DataFrame:
    """M9 as the reference's generator binary: ``n`` configs numbered 1..n
    (the numbers come from ``spark.range``, split across tasks)."""
    return generate_datasets(spark.range(1, n + 1).select(F.col("id").alias("i")), template, now)
