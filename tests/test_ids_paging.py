"""Dense ids without a global window, and paging without one task."""

from pyspark.sql import functions as F

from shelfmark.functions.ids import assign_ids
from shelfmark.operators import listing


def test_assign_ids_dense_in_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"),
                                     (F.col("id") % 3).alias("g"))
    out = assign_ids(df, ["g", "k"], 100, "nid", num_partitions=7).collect()
    ordered = sorted(out, key=lambda r: (r.g, r.k))
    assert [r.nid for r in ordered] == list(range(101, 5101))


def test_assign_ids_empty(spark):
    df = spark.range(0).select(F.col("id").alias("k"))
    assert assign_ids(df, ["k"], 5, "nid").count() == 0


def test_offset_without_count_keeps_the_rest(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("dataset_id"),
                                     (F.col("id") % 97).alias("updated_at"))
    order = listing.dataset_order()
    rest = listing.page(df, order, ["dataset_id"], offset=250)
    head = df.orderBy(*order).limit(250)
    assert rest.count() == 750
    assert rest.join(head, "dataset_id", "left_semi").count() == 0
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
