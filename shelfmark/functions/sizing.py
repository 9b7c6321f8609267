"""Checked broadcasts.

A side is broadcast only after its row count is known to be under a bound;
the caller gets ``None`` otherwise and takes a shuffle-based path. Joins
whose sides are not checked here are left to Spark's size statistics and
AQE's runtime conversion (measured shuffle sizes), never forced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a request/term table that may be broadcast to every task.
MAX_BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most
    ``max_rows + 1`` of them)."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame | None:
    return F.broadcast(df) if bounded(df, max_rows) else None


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row-wise work (payload decoding) every core when the
    input arrives in fewer partitions than the cluster runs tasks at once
    (one small file, one micro-batch). Inputs that are already split pass
    through unchanged, so a large scan never pays an extra shuffle."""
    try:
        # only a scan is dealt out: asking a plan with a shuffle for its
        # partitions would run it
        if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
            return df
        parallelism = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # sessions without RDD access (Spark Connect): leave as is
        return df
    if splits < parallelism:
        return df.repartition(parallelism)
    return df


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when it is proven small, else unchanged
    (Spark then shuffles both sides). For the batch side of a join against
    the whole registry: a bounded batch never makes the registry shuffle."""
    b = broadcast_if_bounded(df, max_rows)
    return df if b is None else b
