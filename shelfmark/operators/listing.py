"""Listings, paging, latest partition and aggregates.

Global order: datasets newest-``updated_at`` first, partitions
newest-``created_at`` first; ids break ties so every page is deterministic.

Scale notes
* Whole-table orders are range-partitioned sorts: a dataset holding a third
  of all partitions is split across ranges by its timestamps.
* Per-dataset pages that end within ``GROUP_ROWS`` filter ``row_number()``;
  Catalyst plans a partial ``WindowGroupLimit`` before the shuffle for
  those, so a hot dataset ships at most so many rows per map task.
* Pages over all rows that end within ``PAGE_ROWS`` are a top-k.
* Deeper pages number the rows by a range-partitioned sort and one count a
  partition, and filter on the number: no task sees more than its range.
* The newest partition per dataset is a grouped ``max_by`` with map-side
  partial aggregation, immune to a hot dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.ids import assign_ids
from ..functions.sizing import broadcast_if_bounded
from ..session import materialise
from ..sources.registry import Registry


def dataset_order() -> list[Column]:
    return [F.desc("updated_at"), F.desc("dataset_id")]


def partition_order() -> list[Column]:
    return [F.desc("created_at"), F.desc("partition_id")]


def _check_paging(count, offset):
    for name, v in (("count", count), ("offset", offset)):
        if v is not None and v < 0:
            raise ValueError(f"{name} must not be negative: {v}")


def _range_filter(df: DataFrame, start, end, col: str = "created_at") -> DataFrame:
    if start is not None:
        df = df.where(F.col(col) >= F.lit(start).cast(S.TS))
    if end is not None:
        df = df.where(F.col(col) <= F.lit(end).cast(S.TS))
    return df


def dataset_view(reg: Registry) -> DataFrame:
    """Datasets with their manager's email (inner join, as the
    reference's JOIN drops datasets without a manager)."""
    m = reg.managers.select("manager_id", "manager_email")
    return reg.datasets.join(m, "manager_id").select(*S.DATASET_VIEW_COLUMNS)


# Rows a top-k gathers in one task at most, and rows of one dataset that
# Spark limits before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
PAGE_ROWS, GROUP_ROWS = 10_000, 1_000


def page(df: DataFrame, order: list[Column], keys: list[str], count: int | None = None,
         offset: int | None = None, position: bool = True) -> DataFrame:
    """Global ORDER BY / OFFSET / LIMIT.

    A page with a count has a 1-based ``position``. One that ends within
    ``PAGE_ROWS`` is a ``TakeOrderedAndProject``; a deeper one, or an offset
    without a count beyond that bound, is a filter on the rows' numbers.
    A short offset without a count is removed by an anti join on ``keys``.
    """
    _check_paging(count, offset)
    first, end = offset or 0, (offset or 0) + (count or 0)
    if count is None and not first:
        return df.orderBy(*order)
    if end > PAGE_ROWS:
        out = assign_ids(df, order, 0, "position").where(F.col("position") > first)
        if count is None:
            return out.drop("position").orderBy(*order)
        out = out.where(F.col("position") <= end).orderBy("position")
        return out if position else out.drop("position")
    if count is not None:
        out = df.orderBy(*order)
        if offset:
            out = out.offset(offset)
        out = out.limit(count)
        if position:
            # the page holds at most PAGE_ROWS rows: a window over it is cheap
            out = out.withColumn("position", F.row_number().over(Window.orderBy(*order)) + first)
        return out
    head = broadcast_if_bounded(df.orderBy(*order).limit(first).select(*keys))
    return df.join(head, keys, "left_anti").orderBy(*order)


def list_datasets(reg: Registry, start=None, end=None, count: int | None = None,
                  offset: int | None = None) -> DataFrame:
    """L1/L7 for datasets: range on ``datasets.created_at``, newest
    ``updated_at`` first, then offset and count."""
    view = _range_filter(dataset_view(reg), start, end)
    return page(view, dataset_order(), ["dataset_id"], count, offset)


def page_datasets(reg: Registry, page_no: int, count: int = S.DEFAULT_PAGE_COUNT) -> DataFrame:
    """Page number → ``offset = page * count``."""
    return list_datasets(reg, count=count, offset=page_no * count)


def latest_partitions(partitions: DataFrame) -> DataFrame:
    """Per dataset the partition with the newest ``created_at``
    (``partition_id`` breaks ties). A dataset without partitions has no row."""
    cols = [c for c in S.PARTITION_COLUMNS if c != "dataset_id"]
    best = F.max_by(F.struct(*cols), F.struct("created_at", "partition_id"))
    return (partitions.groupBy("dataset_id").agg(best.alias("p"))
            .select(*[F.col(f"p.{c}").alias(c) if c != "dataset_id" else F.col(c)
                      for c in S.PARTITION_COLUMNS]))


def latest_with_dataset(reg: Registry) -> DataFrame:
    """Newest partition of every dataset with the dataset's name and its
    manager's email (the flagship query)."""
    view = dataset_view(reg).select("dataset_id", "dataset_name", "manager_email")
    return latest_partitions(reg.partitions).join(view, "dataset_id")


def _requested(reg: Registry, requests: DataFrame | None) -> DataFrame:
    """Partitions of the requested dataset names (P9 + J3), with the name."""
    ds = reg.datasets.select("dataset_id", "dataset_name")
    if requests is not None:
        ds = ds.join(requests.select("dataset_name").distinct(), "dataset_name", "left_semi")
    return reg.partitions.join(ds, "dataset_id")


def list_partitions(reg: Registry, requests: DataFrame | None = None, start=None, end=None,
                    count: int | None = None, offset: int | None = None) -> DataFrame:
    """L2/L7/W3 for partitions: per requested dataset, ``created_at`` in
    [start, end], newest first, then offset and count within each dataset."""
    _check_paging(count, offset)
    parts = _range_filter(_requested(reg, requests), start, end)
    first, last = offset or 0, (offset or 0) + (count or 0)
    if count is None and not first:
        return parts.orderBy("dataset_id", *partition_order())
    if last > GROUP_ROWS:
        out = _numbered(parts)
        if count is None:
            return out.where(F.col("position") > first).drop("position").orderBy("dataset_id", *partition_order())
        return out.where((F.col("position") > first) & (F.col("position") <= last))
    w = Window.partitionBy("dataset_id").orderBy(*partition_order())
    if count is not None:
        return (parts.withColumn("position", F.row_number().over(w))
                .where((F.col("position") > first) & (F.col("position") <= last)))
    head = (parts.withColumn("position", F.row_number().over(w))
            .where(F.col("position") <= first).select("dataset_id", "partition_id"))
    return parts.join(head, ["dataset_id", "partition_id"], "left_anti").orderBy("dataset_id", *partition_order())


def _numbered(parts: DataFrame) -> DataFrame:
    """``position`` of each partition within its dataset, however large the
    dataset is: all rows are numbered in (dataset, order) by ranges, and the
    dataset's first number is taken off."""
    rows = assign_ids(parts, [F.col("dataset_id"), *partition_order()], 0, "_n")
    starts = materialise(rows.groupBy("dataset_id").agg(F.min("_n").alias("_first")))
    return (rows.join(starts, "dataset_id")
            .withColumn("position", F.col("_n") - F.col("_first") + 1).drop("_n", "_first"))


def partitions_page(reg: Registry, count: int, offset: int = 0) -> DataFrame:
    """The same page of every dataset."""
    return list_partitions(reg, count=count, offset=offset)


def dataset_freshness(datasets: DataFrame, partitions: DataFrame) -> DataFrame:
    """A2/M8: ``updated_at`` raised to the newest partition insert."""
    newest = partitions.groupBy("dataset_id").agg(F.max("created_at").alias("_newest"))
    return (datasets.join(newest, "dataset_id", "left")
            .withColumn("updated_at", F.greatest("updated_at", "_newest"))
            .select(*[f.name for f in S.DATASETS.fields]))


def schema_fields(datasets: DataFrame) -> DataFrame:
    """The declared schema as rows, shortest field name first, then by
    name; ``position`` is the 1-based display order within the dataset."""
    fields = datasets.select("dataset_id", "dataset_name",
                             F.explode("dataset_schema").alias("field", "field_type"))
    # a schema has a handful of fields: the per-dataset window is tiny
    w = Window.partitionBy("dataset_id").orderBy(F.length("field"), "field")
    return fields.withColumn("position", F.row_number().over(w))


def domain_table(spark) -> DataFrame:
    """The enum domains as (kind, ord, value) rows."""
    rows = [(kind, i, v) for kind, vals in (("format", S.FORMATS), ("compression", S.COMPRESSIONS),
                                             ("classification", S.CLASSIFICATIONS))
            for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "kind string, ord int, value string")


def attribute_variants(datasets: DataFrame) -> DataFrame:
    """A1/J7 over a registry: for each kind of attribute its values in
    declaration order and, beside them, how many datasets use each (zero
    included). One scan, one grouping."""
    used = (datasets.select(F.expr("stack(3, 'format', dataset_format, 'compression', dataset_compression, "
                                   "'classification', dataset_classification) AS (kind, value)"))
            .groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")))
    # the domain table has 13 rows by definition, and so has what is collected
    rows = domain_table(datasets.sparkSession).join(used, ["kind", "value"], "left").groupBy("kind").agg(
        F.array_sort(F.collect_list(F.struct("ord", "value", F.coalesce("n", F.lit(0)).alias("n")))).alias("v"))
    return rows.select("kind", F.array_join(F.transform("v", lambda x: x["value"]), ",").alias("variants"),
                       F.array_join(F.transform("v", lambda x: x["n"].cast("string")), ",").alias("datasets"))
