"""Lookups on the stored registry that read only what they need (P4, P5, P7,
W1, L4-L7): name buckets, then the buckets of the datasets found; the grams of
the terms; the ranges that hold a page.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.ids import assign_ids
from ..functions.sizing import small_side
from ..session import materialise
from ..sources import registry as R
from . import listing, lookup


def _of_names(spark: SparkSession, root: str, m: R.Manifest, requests: DataFrame) -> tuple[R.Registry, list[int]]:
    """The registry as far as the requested names go, and the buckets read."""
    asked = small_side(requests.select("dataset_name").dropna().distinct())
    names = R.load_table(spark, root, m, "names", R.buckets_of(asked, "dataset_name", m))
    ids = materialise(names.join(asked, "dataset_name", "left_semi"))
    buckets = R.buckets_of(ids, "dataset_id", m)
    return R.Registry(R.load_table(spark, root, m, "managers"),
                      *(R.load_table(spark, root, m, t, buckets) for t in R.BUCKETED)), buckets


def find_datasets(spark: SparkSession, root: str, requests: DataFrame) -> DataFrame:
    """P4 on storage: opens as many buckets as names are asked for, at most."""
    return lookup.find_datasets(_of_names(spark, root, R.manifest(spark, root), requests)[0], requests)


def find_partitions(spark: SparkSession, root: str, requests: DataFrame) -> DataFrame:
    """P5 on storage; ``latest`` is read from the kept table where there is
    one."""
    m = R.manifest(spark, root)
    reg, buckets = _of_names(spark, root, m, requests)
    newest = R.load_table(spark, root, m, "latest", buckets) if "latest" in m.tables else None
    return lookup.find_partitions(reg, requests, newest)


def latest_partitions(spark: SparkSession, root: str) -> DataFrame:
    """W1 on storage: one row a dataset, kept up to date by every commit."""
    m = R.manifest(spark, root)
    if "latest" in m.tables:
        return R.load_table(spark, root, m, "latest").select(*S.PARTITION_COLUMNS)
    return listing.latest_partitions(R.load_table(spark, root, m, "partitions"))


def search_datasets(spark: SparkSession, root: str, terms: DataFrame) -> DataFrame:
    """P7 on storage: reads the rows of the terms' grams, then the datasets
    that match. Terms of wildcards alone ask for a length and read all names."""
    m = R.manifest(spark, root)
    view = listing.dataset_view(R.load_registry(spark, root, m.version))
    t = lookup.search_terms(terms)

    def index(wanted: DataFrame) -> DataFrame:
        return R.load_table(spark, root, m, "grams", R.buckets_of(wanted, "gram", m))
    return lookup.search_by_grams(view, index, t)


# ---------------------------------------------------------------------------
# Pages of a version, from sorted ranges with their row counts
# ---------------------------------------------------------------------------

def _order_path(root: str, version: int, table: str) -> str:
    return os.path.join(root, "_ordered", f"{version}-{table}")


def write_order(spark: SparkSession, root: str, table: str = "datasets") -> int:
    """Stores a version's datasets (newest updated_at first) or partitions (by
    dataset, newest first) as sorted ranges, and beside them the numbers of
    each range's first and last row; returns the version. Nothing is done if
    that is there."""
    m = R.manifest(spark, root)
    folder = _order_path(root, m.version, table)
    if R.exists(spark, os.path.join(folder, "ranges")):
        return m.version
    if table == "datasets":
        rows, order = listing.dataset_view(R.load_registry(spark, root, m.version)), listing.dataset_order()
    else:
        rows = R.load_table(spark, root, m, "partitions")
        order = [F.col("dataset_id"), *listing.partition_order()]
    write = uuid.uuid4().hex
    path = os.path.join(folder, write)
    numbered = assign_ids(rows, order, -1, "_n")
    numbered.withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
    n = F.col("_n")
    held = [] if not m.tables.get(table) or not R._has_buckets(spark, path) else [
        {"write": write, **r.asDict()} for r in spark.read.parquet(path).groupBy("_range").agg(
            F.min(n).alias("first"), F.max(n).alias("last"), F.min("dataset_id").alias("from"),
            F.max("dataset_id").alias("to")).orderBy("first").collect()]
    R._put_if_absent(spark, os.path.join(folder, "ranges"), json.dumps(held))
    return m.version


def _ranges(spark: SparkSession, root: str, version: int, table: str) -> list[dict]:
    """A version's ranges in order (one small row each)."""
    return json.loads(R._read_text(spark, os.path.join(_order_path(root, version, table), "ranges")))


def _rows(spark: SparkSession, root: str, version: int, table: str, ranges: list[dict]) -> DataFrame:
    columns = T.StructType([*(S.PARTITIONS if table == "partitions" else listing.dataset_view(
        R.empty_registry(spark)).schema).fields, T.StructField("_n", T.LongType())])
    if not ranges:
        return spark.createDataFrame([], columns)
    path = _order_path(root, version, table)
    return spark.read.schema(columns).parquet(
        *[os.path.join(path, r["write"], f"_range={r['_range']}") for r in ranges])


def _page(rows: DataFrame, first: int, count: int, start: int) -> DataFrame:
    return (rows.where((F.col("_n") >= first) & (F.col("_n") < first + count))
            .withColumn("position", F.col("_n") - start + 1).drop("_n").orderBy("position"))


def page_datasets(spark: SparkSession, root: str, count: int, offset: int = 0) -> DataFrame:
    """L3-L6 on storage: rows ``offset + 1`` to ``offset + count`` of the
    newest version's order, with their position; only the ranges that hold
    them are read."""
    version = write_order(spark, root)
    held = [r for r in _ranges(spark, root, version, "datasets") if r["last"] >= offset and r["first"] < offset + count]
    return _page(_rows(spark, root, version, "datasets", held), offset, count, 0)


def page_partitions(spark: SparkSession, root: str, dataset_id: int, count: int, offset: int = 0) -> DataFrame:
    """W3 on storage, for one dataset however deep the page: the dataset's
    first number comes from the first range that has its id, the page from
    the ranges at that distance."""
    version = write_order(spark, root, "partitions")
    held = _ranges(spark, root, version, "partitions")
    mine = [r for r in held if r["from"] <= dataset_id <= r["to"]]
    of_it = F.col("dataset_id") == dataset_id
    # ranges overlap at their ends only: the first may end before the id
    start = _rows(spark, root, version, "partitions", mine[:2]).where(of_it).agg(F.min("_n")).first()[0]
    first = (start or 0) + offset
    pages = [r for r in mine if start is not None and r["last"] >= first and r["first"] < first + count]
    return _page(_rows(spark, root, version, "partitions", pages).where(of_it), first, count, start or 0)
