"""Tables kept up to date with a stored registry.

* ``latest`` (W1): each dataset's newest partition, by dataset. A commit
  compares the partitions it puts with the dataset's latest; where the latest
  itself goes (or comes back as another row), that dataset alone is looked
  through again.
* ``grams`` (P7): each dataset name under its grams of one to three
  characters, by gram. A registration adds its names' rows, a deletion drops
  them.

A registry has them if it was made with them (``commit_snapshot(derived=True)``);
they are written by the same commit as the rows they follow from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.sizing import small_side
from ..session import materialise
from . import registry as R

KEY = ["dataset_id", "partition_name"]


def name_grams(s: Column, lengths=(1, 2, 3)) -> Column:
    """The distinct grams of a name, of each of some lengths."""
    def grams(n: int) -> Column:
        return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1),
                                                    lambda i: F.substring(s, i, n))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[grams(n) for n in lengths])))


def grams(names: DataFrame) -> DataFrame:
    return names.select(F.explode(name_grams(F.col("dataset_name"))).alias("gram"), "dataset_id", "dataset_name")


def newest(partitions: DataFrame) -> DataFrame:
    """Each dataset's partition with the newest created_at, then id."""
    cols = [c for c in S.PARTITION_COLUMNS if c != "dataset_id"]
    best = F.max_by(F.struct(*cols), F.struct("created_at", "partition_id"))
    return partitions.groupBy("dataset_id").agg(best.alias("_p")).select("dataset_id", "_p.*")


def tables(reg: R.Registry) -> dict[str, DataFrame]:
    # a row a dataset, written by a sort that reads it twice
    return {"latest": materialise(newest(reg.partitions)), "grams": grams(reg.datasets.select("dataset_name", "dataset_id"))}


def with_derived(spark: SparkSession, root: str, m: R.Manifest, changes: R.Changes) -> R.Changes:
    """The change, with what it means for the tables derived from it."""
    put, drop = dict(changes.put), dict(changes.drop)
    if "latest" in m.tables and ("partitions" in put or "partitions" in drop):
        put["latest"], drop["latest"] = _latest(spark, root, m, put.get("partitions"), drop.get("partitions"))
    if "grams" in m.tables and ("names" in put or "names" in drop):
        if "names" in put:
            put["grams"] = grams(put["names"])
        if "datasets" in drop:
            asked = [d["names"].select("dataset_name") for d in (put, drop) if "names" in d]
            asked = small_side(reduce(DataFrame.union, asked).distinct())
            old = (R.load_table(spark, root, m, "names", R.buckets_of(asked, "dataset_name", m))
                   .join(asked, "dataset_name", "left_semi").join(drop["datasets"], "dataset_id", "left_semi"))
            drop["grams"] = grams(old).select("gram", "dataset_id")
    return R.Changes(put, drop, changes.whole, changes.clear, changes.batches)


def _latest(spark: SparkSession, root: str, m: R.Manifest, put: DataFrame | None,
            drop: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    put = spark.createDataFrame([], S.PARTITIONS) if put is None else put.select(*S.PARTITION_COLUMNS)
    drop = spark.createDataFrame([], S.PARTITIONS).select(*KEY) if drop is None else drop
    if "partition_name" not in drop.columns:
        drop = drop.withColumn("partition_name", F.lit(None).cast("string"))
    drop = drop.select(*KEY)
    whole = drop.where(F.col("partition_name").isNull()).select("dataset_id").distinct()
    ids = put.select("dataset_id").union(drop.select("dataset_id")).distinct()
    buckets = R.buckets_of(ids, "dataset_id", m)
    old = R.load_table(spark, root, m, "latest", buckets)
    # a latest that goes, or whose key comes back as another row
    again = put.select(*KEY, F.col("partition_id").alias("_id"))
    lost = materialise(
        old.join(drop, KEY, "left_semi").select("dataset_id")
        .union(old.join(again, KEY).where(F.col("_id") != F.col("partition_id")).select("dataset_id"))
        .distinct().join(whole, "dataset_id", "left_anti"))
    few = small_side(lost)
    rest = (R.load_table(spark, root, m, "partitions", R.buckets_of(lost, "dataset_id", m))
            .join(few, "dataset_id", "left_semi"))
    new = (old.join(few, "dataset_id", "left_anti").join(put.select("dataset_id").distinct(), "dataset_id", "left_semi")
           .unionByName(rest.select(*old.columns))
           .join(drop, KEY, "left_anti").join(put.select(*KEY), KEY, "left_anti")
           .unionByName(put.select(*old.columns)))
    new = materialise(newest(new).join(whole, "dataset_id", "left_anti"))
    return new, whole.union(lost.join(new.select("dataset_id"), "dataset_id", "left_anti"))
