"""Dense, reproducible surrogate ids without a single-partition window.

``row_number() OVER (ORDER BY ...)`` would move every row into one task.
Instead rows are range partitioned and sorted on the order, materialised
once (``checkpoint`` into the shared checkpoint folder, so a lost executor
never recomputes a different order), counted per partition (one small row
per partition reaches the driver) and numbered by partition offset plus
position inside the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialise


def assign_ids(df: DataFrame, order: list[str] | list[Column], base: int, name: str,
               num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = ``base + 1, base + 2, ...`` following ``order``
    (which must be a total order on the rows)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mono", F.monotonically_increasing_id()))
    counts = {r["_pid"]: r["n"] for r in
              ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = {}, 0
    for pid in sorted(counts):
        offsets[pid] = total
        total += counts[pid]
    if not offsets:
        return ranged.drop("_pid", "_mono").withColumn(name, F.lit(None).cast("long"))
    # one row a shuffle partition
    starts = F.broadcast(spark.createDataFrame(list(offsets.items()), "_pid int, _start long"))
    local = F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (ranged.join(starts, "_pid").withColumn(name, F.lit(base) + F.col("_start") + local + 1)
            .drop("_pid", "_mono", "_start"))
