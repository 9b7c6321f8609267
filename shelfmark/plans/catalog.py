"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
computed from the driver's tables through the library's operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import formats, paths
from ..operators import events, fold, listing, lookup, mutations, quality, stored
from ..session import checkpoint_dir, materialise
from ..sources import configs, fixtures
from ..streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def latest_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest partition of every dataset, with dataset name and manager email."""
    return listing.latest_with_dataset(fixtures.registry(spark, sf_dir))


# ---------------------------------------------------------------------------
# Request and term tables derived from the driver's tables
# ---------------------------------------------------------------------------

def schema_text(c: str) -> F.Column:
    """A declared schema as ``field:type,...`` in order of the fields."""
    return F.array_join(F.array_sort(F.transform(
        F.map_entries(c), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"], F.lit(""))))), ",")


def _view(df: DataFrame) -> DataFrame:
    """The declared schema map in a form that can be compared."""
    return df.withColumn("dataset_schema", schema_text("dataset_schema"))


def dataset_name_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's dataset name plus every nation name (never a dataset)."""
    c = fixtures.table(spark, sf_dir, "customer").select(F.col("c_name").alias("dataset_name"))
    n = fixtures.table(spark, sf_dir, "nation").select(F.col("n_name").alias("dataset_name"))
    return c.unionByName(n)


def partition_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order: its own file, ``latest`` or a missing name."""
    o = fixtures.table(spark, sf_dir, "orders")
    c = fixtures.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    key = F.col("o_orderkey")
    name = (F.when(key % 10 == 0, F.lit(S.LATEST))
            .when(key % 10 == 1, F.concat(F.lit("missing-"), key.cast("string")))
            .otherwise(fixtures.order_file_name()))
    return (o.join(c, o.o_custkey == c.c_custkey)
            .select(F.col("c_name").alias("dataset_name"), name.alias("partition_name")))


def api_key_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fixtures.table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("key-"), F.col("n_nationkey").cast("string")).alias("api_key")) \
        .unionByName(n.select(F.concat(F.lit("key-"), (F.col("n_nationkey") + 100).cast("string"))
                              .alias("api_key")))


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight terms per nation: plain, ``_`` and ``%`` wildcards, a backslash
    before an ordinary character, an escaped underscore, a backslash at the
    end, wildcards alone, and a single character."""
    n = fixtures.table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("string")
    terms = [
        F.concat(F.lit("#00000"), F.lpad(k, 2, "0")),
        F.concat(F.lit("0001_"), k),
        F.concat(F.lit("r#%"), F.lpad(k, 3, "0")),
        F.concat(F.lit("\\"), F.col("n_name")),
        F.concat(F.lit("\\_"), k),
        F.concat(F.lit("0"), k, F.lit("\\")),
        F.concat(F.lit("%"), F.lpad(F.lit(""), F.col("n_nationkey").cast("int"), "_")),
        F.substring(k, 1, 1),
    ]
    out = None
    for t in terms:
        df = n.select(t.alias("term"))
        out = df if out is None else out.unionByName(df)
    return out


def _stored_root(spark: SparkSession, sf_dir: str, derived: bool = False) -> str:
    """The folder of the fixture registry, committed to the shared folder."""
    root = stream.registry_root(spark, f"registry-{uuid.uuid4().hex}")
    # some ten thousand rows: a few buckets
    stream.init_registry(fixtures.registry(spark, sf_dir), root, buckets=8, derived=derived)
    return root


BUCKETS = {c: f"org-datasets-{c}" for c in S.CLASSIFICATIONS}


# ---------------------------------------------------------------------------
# Listing, paging, lookups, search, views
# ---------------------------------------------------------------------------

@query
def list_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dataset with its manager's email, newest updated_at first."""
    return _view(listing.list_datasets(fixtures.registry(spark, sf_dir)))


@query
def datasets_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: the ten most recently updated datasets, with their position."""
    return _view(listing.list_datasets(fixtures.registry(spark, sf_dir), count=10)) \
        .withColumn("position", F.col("position").cast("long"))


@query
def datasets_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: every dataset after the first twenty (offset without a count)."""
    return _view(listing.list_datasets(fixtures.registry(spark, sf_dir), offset=20))


@query
def datasets_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 3 of ten datasets (offset 30, count 10)."""
    return _view(listing.page_datasets(fixtures.registry(spark, sf_dir), page_no=3)) \
        .withColumn("position", F.col("position").cast("long"))


@query
def datasets_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets created in a time range, offset 2, count 5."""
    reg = fixtures.registry(spark, sf_dir)
    return _view(listing.list_datasets(reg, start="1994-01-01 06:00:00", end="1994-01-01 20:00:00",
                                       count=5, offset=2)) \
        .withColumn("position", F.col("position").cast("long"))


@query
def list_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every partition of every requested dataset name, newest first."""
    reg = fixtures.registry(spark, sf_dir)
    req = fixtures.table(spark, sf_dir, "customer").select(F.col("c_name").alias("dataset_name"))
    return listing.list_partitions(reg, requests=req)


@query
def partitions_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per dataset, partitions created in a range, offset 1, count 3."""
    reg = fixtures.registry(spark, sf_dir)
    return listing.list_partitions(reg, start="1996-01-01 00:00:00", end="1999-12-31 00:00:00",
                                   count=3, offset=1) \
        .withColumn("position", F.col("position").cast("long"))


@query
def partitions_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second and third newest partitions of every dataset."""
    return listing.partitions_page(fixtures.registry(spark, sf_dir), count=2, offset=1) \
        .withColumn("position", F.col("position").cast("long"))


@query
def partitions_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per dataset, every partition after the three newest."""
    return listing.list_partitions(fixtures.registry(spark, sf_dir), offset=3)


@query
def partition_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every partition with its latest badge, size and display time."""
    return lookup.partition_view(fixtures.partitions(spark, sf_dir))


@query
def find_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets by name; nation names are never found."""
    reg = fixtures.registry(spark, sf_dir)
    return _view(lookup.find_datasets(reg, dataset_name_requests(spark, sf_dir)))


@query
def find_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: one lookup per order: its file, `latest`, or a missing name."""
    return lookup.find_partitions(fixtures.registry(spark, sf_dir), partition_requests(spark, sf_dir))


@query
def find_managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Managers by api key; half the keys do not exist."""
    return lookup.find_managers(fixtures.managers(spark, sf_dir), api_key_requests(spark, sf_dir))


@query
def manager_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public columns of every manager."""
    return lookup.manager_public(fixtures.managers(spark, sf_dir))


@query
def manager_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The datasets of every requested manager api key."""
    reg = fixtures.registry(spark, sf_dir)
    return _view(lookup.manager_datasets(reg, api_key_requests(spark, sf_dir)))


@query
def partitions_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partitions of the requested dataset names."""
    return lookup.partitions_by_name(fixtures.registry(spark, sf_dir),
                                     dataset_name_requests(spark, sf_dir))


@query
def search_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name search for eight kinds of terms per nation (broadcast path)."""
    return _view(lookup.search_datasets(fixtures.registry(spark, sf_dir), search_terms(spark, sf_dir)))


@query
def search_datasets_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search through the trigram equi-join path (no broadcast)."""
    return _view(lookup.search_datasets(fixtures.registry(spark, sf_dir), search_terms(spark, sf_dir),
                                        max_broadcast=1))


@query
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: hits per search term, zero included."""
    return lookup.search_counts(fixtures.registry(spark, sf_dir), search_terms(spark, sf_dir))


@query
def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared schema fields per dataset in display order."""
    return listing.schema_fields(fixtures.datasets(spark, sf_dir)) \
        .withColumn("position", F.col("position").cast("long"))


@query
def storage_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dataset's bucket and storage URI by classification."""
    buckets = spark.createDataFrame(list(BUCKETS.items()), "classification string, bucket string")
    return lookup.storage_uri(fixtures.datasets(spark, sf_dir), buckets)


@query
def dataset_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2/M8: datasets with updated_at raised to their newest partition."""
    return _view(listing.dataset_freshness(fixtures.datasets(spark, sf_dir),
                                           fixtures.partitions(spark, sf_dir)))


@query
def expected_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the file extension each dataset's format and compression imply."""
    d = fixtures.datasets(spark, sf_dir)
    return d.select("dataset_id", "dataset_format", "dataset_compression",
                    formats.expected_ext("dataset_format", "dataset_compression").alias("expected_ext"))


@query
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose parent is missing, of a registry loaded without
    constraints."""
    return lookup.orphans(fixtures.dirty_registry(spark, sf_dir))


# ---------------------------------------------------------------------------
# Bucket notifications: envelope → decode → route → fold
# ---------------------------------------------------------------------------

def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded notifications. The flat rows equal a flattened envelope (the
    envelope itself is exercised by ``flatten_envelope`` and the stream)."""
    return events.decode_notifications(fixtures.notifications(spark, sf_dir))


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = fixtures.event_registry(spark, sf_dir)
    return events.route_events(_decoded(spark, sf_dir), reg.datasets)


@query
def flatten_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: pull responses flattened to one row per message."""
    return events.flatten_envelope(fixtures.envelopes(spark, sf_dir)).drop("missing")


@query
def decode_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded payload fields and the dead-letter reason."""
    return _decoded(spark, sf_dir).select(
        "message_id", "object_name", "self_link", "size", "dataset_name", "partition_name", "reason")


@query
def parse_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset and partition name of every notification's object."""
    n = fixtures.notifications(spark, sf_dir)
    return n.select("message_id", "object_id",
                    paths.dataset_of("object_id").alias("dataset_name"),
                    paths.partition_of("object_id").alias("partition_name"))


@query
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that cannot be applied, with the reason."""
    return events.dead_letters(_decoded(spark, sf_dir))


@query
def route_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action the routing table gives every message."""
    return _routed(spark, sf_dir).select(
        "message_id", "dataset_name", "partition_name", "dataset_id", "action", "acked")


def _folded(spark: SparkSession, sf_dir: str):
    reg = fixtures.event_registry(spark, sf_dir)
    return fold.fold_events(reg, events.route_events(_decoded(spark, sf_dir), reg.datasets))


@query
def decode_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode straight from pull responses (envelope → flatten → decode)."""
    return events.decode_notifications(events.flatten_envelope(fixtures.envelopes(spark, sf_dir))) \
        .select("message_id", "object_name", "self_link", "size", "dataset_name", "partition_name",
                "reason")


@query
def fold_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions of the event registry after folding every notification."""
    return _folded(spark, sf_dir)[0].partitions


@query
def fold_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets after the fold: deleted ones gone, freshness raised."""
    reg = fixtures.event_registry(spark, sf_dir)
    sm = fold.summarise(reg, events.route_events(_decoded(spark, sf_dir), reg.datasets))
    return _view(fold.folded_datasets(reg, sm))


@query
def pending_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages left for a later batch (their dataset is not registered)."""
    reg = fixtures.event_registry(spark, sf_dir)
    pending = fold.pending_messages(events.route_events(_decoded(spark, sf_dir), reg.datasets))
    return pending.select("message_id", "dataset_name", "partition_name", "action")


# ---------------------------------------------------------------------------
# Mutations and constraints
# ---------------------------------------------------------------------------

NOW = "2025-01-01 00:00:00"
MANAGER_DOMAIN = "registry.test"
API_KEY_SECRET = "test secret"
# The dataset config of the generator and of the config test (dd.json).
TEMPLATE = {
    "name": "station_readings",
    "classification": "internal",
    "compression": "gzip",
    "format": "ndjson",
    "description": "Hourly readings of all stations",
    "schema": {"station": "string", "hour": "timestamp", "mean_reading": "float"},
}


def dataset_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One config per supplier: names repeat in pairs, every 7th takes an
    existing dataset's name, every 11th has an unknown format, every 13th
    an upper-case one."""
    s = fixtures.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    fmt = formats.domain_value(S.FORMATS, k % 6)
    return s.select(
        k.alias("request_id"),
        F.col("s_nationkey").cast("long").alias("manager_id"),
        F.when(k % 7 == 0, F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0")))
        .otherwise(F.concat(F.lit("supplier_ds_"), F.floor(k / 2).cast("string"))).alias("name"),
        F.when(k % 11 == 0, F.lit("Parquet")).when(k % 13 == 0, F.upper(fmt)).otherwise(fmt)
        .alias("format"),
        formats.domain_value(S.COMPRESSIONS, k % 3).alias("compression"),
        formats.domain_value(S.CLASSIFICATIONS, F.col("s_nationkey") % 4).alias("classification"),
        F.concat(F.lit("supplied by "), F.col("s_name")).alias("description"),
        fixtures.schema_map(k).alias("schema"),
    )


@query
def register_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets accepted from the configs, with their new ids."""
    reg = fixtures.registry(spark, sf_dir)
    new, _ = mutations.register_datasets(reg, dataset_configs(spark, sf_dir), NOW)
    return _view(new.datasets.join(reg.datasets.select("dataset_id"), "dataset_id", "left_anti"))


@query
def register_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected dataset configs with their reason."""
    reg = fixtures.registry(spark, sf_dir)
    return mutations.register_datasets(reg, dataset_configs(spark, sf_dir), NOW)[1]


def manager_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sign-up per supplier; addresses repeat in threes, every 9th
    (remainder 4) is outside the domain."""
    k = F.col("s_suppkey")
    return fixtures.table(spark, sf_dir, "supplier").select(
        k.alias("request_id"),
        F.concat(F.lit("mgr"), F.floor(k / 3).cast("string"),
                 F.when(k % 9 == 4, F.lit("@other.org")).otherwise(F.lit("@" + MANAGER_DOMAIN)))
        .alias("manager_email"))


@query
def register_managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Managers after the sign-ups (public columns, rejected ones absent)."""
    reg = fixtures.registry(spark, sf_dir)
    new, rejected = mutations.register_managers(reg, manager_rows(spark, sf_dir), MANAGER_DOMAIN, NOW,
                                           secret=API_KEY_SECRET)
    return new.managers


@query
def register_managers_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected manager sign-ups with their reason."""
    reg = fixtures.registry(spark, sf_dir)
    return mutations.register_managers(reg, manager_rows(spark, sf_dir), MANAGER_DOMAIN, NOW,
                                           secret=API_KEY_SECRET)[1]


def partition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registration per line item for the order's dataset: line 1
    re-registers the order's file, lines 2 and 3 share a name (the later
    wins), line 7 uses the reserved name."""
    li = fixtures.table(spark, sf_dir, "lineitem")
    o = fixtures.partitions(spark, sf_dir).select(
        F.col("partition_id").alias("l_orderkey"), "dataset_id",
        F.col("partition_name").alias("order_file"))
    ln = F.col("l_linenumber")
    name = (F.when(ln == 1, F.col("order_file"))
            .when(ln == 7, F.lit(S.LATEST))
            .otherwise(F.concat(F.lit("line-"), F.col("l_orderkey").cast("string"), F.lit("-"),
                                F.when(ln == 3, F.lit(2)).otherwise(ln).cast("string"))))
    return li.join(o, "l_orderkey").select(
        (F.col("l_orderkey") * 8 + ln).alias("request_id"), "dataset_id",
        name.alias("partition_name"),
        F.concat(F.lit("lake://lines/"), F.col("l_orderkey").cast("string"), F.lit("/"),
                 ln.cast("string")).alias("partition_url"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("partition_size"))


@query
def upsert_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions after one registration per line item."""
    reg = fixtures.registry(spark, sf_dir)
    return mutations.upsert_partitions(reg, partition_rows(spark, sf_dir), NOW)[0].partitions


@query
def upsert_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations that are rejected, also those with a value
    missing (every 9th name, 10th url, 11th size)."""
    r = F.col("request_id")
    rows = (partition_rows(spark, sf_dir)
            .withColumn("partition_name", F.when(r % 9 != 0, F.col("partition_name")))
            .withColumn("partition_url", F.when(r % 10 != 0, F.col("partition_url")))
            .withColumn("partition_size", F.when(r % 11 != 0, F.col("partition_size"))))
    return mutations.upsert_partitions(fixtures.registry(spark, sf_dir), rows, NOW)[1]


@query
def committed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored partitions after the registrations were committed."""
    root = _stored_root(spark, sf_dir)
    stream.upsert_and_commit(spark, root, partition_rows(spark, sf_dir), NOW)
    return stream.current(spark, root)[0].partitions


@query
def committed_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored partitions after two committed deletions."""
    root = _stored_root(spark, sf_dir)
    _delete_some(spark, sf_dir, root)
    return stream.current(spark, root)[0].partitions


def _delete_some(spark: SparkSession, sf_dir: str, root: str) -> None:
    done = fixtures.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F") \
        .select(F.col("o_orderkey").alias("partition_id"))
    stream.delete_partitions_and_commit(spark, root, fixtures.partitions(spark, sf_dir).join(
        done, "partition_id", "left_semi").select("dataset_id", "partition_name"))
    stream.delete_datasets_and_commit(spark, root, fixtures.table(spark, sf_dir, "customer").where(
        F.col("c_mktsegment") == "AUTOMOBILE").select(F.col("c_name").alias("dataset_name")))


@query
def committed_managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored managers after the sign-ups were committed."""
    root = _stored_root(spark, sf_dir)
    stream.sign_up_and_commit(spark, root, manager_rows(spark, sf_dir), MANAGER_DOMAIN, NOW, API_KEY_SECRET)
    return stream.current(spark, root)[0].managers


@query
def committed_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored datasets that a committed registration added."""
    root = _stored_root(spark, sf_dir)
    stream.register_and_commit(spark, root, dataset_configs(spark, sf_dir), NOW)
    old = fixtures.datasets(spark, sf_dir).select("dataset_id")
    return _view(stream.current(spark, root)[0].datasets.join(old, "dataset_id", "left_anti"))


@query
def deep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions from the second on, up to 2,000 a dataset, by
    ranges instead of a window."""
    return listing.list_partitions(fixtures.registry(spark, sf_dir), count=2_000, offset=1)


@query
def upsert_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets after the registrations (inserted files raise updated_at)."""
    reg = fixtures.registry(spark, sf_dir)
    return _view(mutations.upsert_partitions(reg, partition_rows(spark, sf_dir), NOW)[0].datasets)


@query
def delete_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions left after deleting the files of finished orders."""
    reg = fixtures.registry(spark, sf_dir)
    done = fixtures.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F") \
        .select(F.col("o_orderkey").alias("partition_id"))
    req = reg.partitions.join(done, "partition_id", "left_semi").select("dataset_id", "partition_name")
    return mutations.delete_partitions(reg, req).partitions


@query
def delete_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions left after deleting the AUTOMOBILE datasets (cascade)."""
    reg = fixtures.registry(spark, sf_dir)
    req = fixtures.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "AUTOMOBILE") \
        .select(F.col("c_name").alias("dataset_name"))
    return mutations.delete_datasets(reg, req).partitions


@query
def generate_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bulk generator over one number per customer."""
    nums = fixtures.table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("i"))
    return mutations.generate_datasets(nums, TEMPLATE, NOW).withColumn("schema", schema_text("schema"))


@query
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations per constraint of a registry loaded without them."""
    return quality.constraint_report(fixtures.dirty_registry(spark, sf_dir))


@query
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys held by more than one row."""
    return quality.unique_violations(fixtures.dirty_registry(spark, sf_dir))


# ---------------------------------------------------------------------------
# Scans, config files, attributes, per-rule listings
# ---------------------------------------------------------------------------

def _stored(spark: SparkSession, sf_dir: str):
    return stream.current(spark, _stored_root(spark, sf_dir))[0]


@query
def scan_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The datasets of a committed snapshot, read with their schema."""
    return _view(_stored(spark, sf_dir).datasets)


@query
def scan_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partitions of a committed snapshot."""
    return _stored(spark, sf_dir).partitions


@query
def config_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 then S4: export every dataset's config file into the shared
    checkpoint folder and read the files back as typed config rows."""
    out = os.path.join(checkpoint_dir(spark), f"configs-{uuid.uuid4().hex}")
    names = spark.createDataFrame(list(BUCKETS.items()), "classification string, bucket string")
    configs.export_configs(fixtures.datasets(spark, sf_dir), out, names)
    back = configs.read_dataset_configs(spark, out)
    return back.select("name", "classification", "compression", "format", "description",
                       schema_text("schema").alias("schema"))


@query
def attribute_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind's values in declaration order, with dataset counts."""
    return listing.attribute_variants(fixtures.datasets(spark, sf_dir))


@query
def find_managers_by_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Managers by email address."""
    n = fixtures.table(spark, sf_dir, "nation")
    req = n.select(F.concat(F.lower("n_name"), F.lit("@example.com")).alias("manager_email")).unionByName(
        n.select(F.concat(F.lower("n_name"), F.lit("@elsewhere.org")).alias("manager_email")))
    return lookup.find_managers(fixtures.managers(spark, sf_dir), req, by="manager_email")


@query
def null_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a missing required value."""
    return quality.row_violations(fixtures.dirty_registry(spark, sf_dir), "not null")


@query
def length_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values longer than their column allows."""
    return quality.row_violations(fixtures.dirty_registry(spark, sf_dir), "length")


@query
def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: enum columns outside their domain."""
    return quality.row_violations(fixtures.dirty_registry(spark, sf_dir), "in domain")


# ---------------------------------------------------------------------------
# The stored registry: stream, lookups, kept tables
# ---------------------------------------------------------------------------

def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """The event registry on storage after the whole log in three commits."""
    root = stream.registry_root(spark, f"events-{uuid.uuid4().hex}")
    stream.init_registry(fixtures.event_registry(spark, sf_dir), root, buckets=8)
    # decoded once: counted, sampled for the order and dealt out
    decoded = materialise(_decoded(spark, sf_dir))
    parts = stream.parts_of(decoded, -(-decoded.count() // 3))
    for i, part in enumerate(parts):
        stream.apply_decoded(spark, part, root, 0, "log", (i, len(parts)))
    return root


@query
def stored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored partitions after the log in three parts
    (ids depend on the parts)."""
    return stream.current(spark, _streamed(spark, sf_dir))[0].partitions.drop("partition_id")


@query
def stored_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 on storage: the dead letters of all commits."""
    return stream.all_dead_letters(spark, _streamed(spark, sf_dir)).drop("version")


@query
def stored_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 on storage: what waits after every second of the unknown names was
    registered and the waiting messages were tried again."""
    root = _streamed(spark, sf_dir)
    waiting = stream.current(spark, root)[1].select("dataset_name").distinct()
    chosen = waiting.where(F.expr("right(dataset_name, 2)").isin("00", "20", "40", "60", "80"))
    configs_ = chosen.select(
        F.xxhash64("dataset_name").alias("request_id"), F.lit(0).cast("long").alias("manager_id"),
        F.col("dataset_name").alias("name"), F.lit("csv").alias("format"), F.lit("zip").alias("compression"),
        F.lit("public").alias("classification"), F.lit("late").alias("description"), fixtures.schema_map(F.lit(1)).alias("schema"))
    stream.register_and_commit(spark, root, configs_, NOW)
    stream.retry_pending(spark, root)
    return stream.current(spark, root)[1].select("message_id", "dataset_name", "partition_name")


@query
def stored_find_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 on storage: name buckets, then the buckets of the datasets found."""
    return stored.find_partitions(spark, _stored_root(spark, sf_dir, derived=True), partition_requests(spark, sf_dir))


@query
def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7, J8 on storage: through the kept grams of the names."""
    root = _stored_root(spark, sf_dir, derived=True)
    return _view(stored.search_datasets(spark, root, search_terms(spark, sf_dir)))


@query
def stored_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 on storage: the kept newest partitions after registrations and two
    deletions, of which some take a newest partition away."""
    root = _stored_root(spark, sf_dir, derived=True)
    stream.upsert_and_commit(spark, root, partition_rows(spark, sf_dir), NOW)
    _delete_some(spark, sf_dir, root)
    return stored.latest_partitions(spark, root)


@query
def stored_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3-L6 on storage: a page in the middle, from the ranges that hold it."""
    root = _stored_root(spark, sf_dir)
    return _view(stored.page_datasets(spark, root, 40, 60))


@query
def commit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2-C6 of one commit: the registrations of partitions, checked on the
    buckets they touch, with lengths and datasets that break the rules."""
    root = _stored_root(spark, sf_dir)
    rows = partition_rows(spark, sf_dir)
    bad = (rows.where("partition_name IS NOT NULL AND dataset_id IS NOT NULL").groupBy("dataset_id", "partition_name")
           .agg(F.max("request_id").alias("r")).where("r % 7 < 2")
           .select((F.col("r") + 10_000_000).alias("partition_id"),
                   F.when(F.col("r") % 7 == 0, F.rpad("partition_name", 300, "x")).otherwise(F.col("partition_name")).alias("partition_name"),
                   F.lit("u").alias("partition_url"), F.lit(1).cast("long").alias("partition_size"),
                   F.when(F.col("r") % 7 == 1, F.col("dataset_id") + 100_000_000).otherwise(F.col("dataset_id")).alias("dataset_id"),
                   F.lit(NOW).cast(S.TS).alias("created_at"), F.lit(NOW).cast(S.TS).alias("updated_at")))
    stream.transact(spark, root, lambda m: (stream.Changes({"partitions": bad}), None))
    return quality.commit_violations(spark, root)
