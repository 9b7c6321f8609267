"""Plan shapes the scale claims rest on (hot keys never in one task)."""

from shelfmark.operators import events, fold, listing
from shelfmark.plans import catalog
from shelfmark.sources import fixtures

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_windows_are_bounded(spark):
    """The one window over messages is cut into runs, a task's stretch of a
    key; the one over a key sees a row a run. A hot key never sits in one
    task, and equal event times don't keep it together."""
    n = 20_000
    rows = spark.range(n).selectExpr(
        "1L AS dataset_id", "if(id % 3 = 0, 'hot', concat('k', id)) AS partition_name",
        "if(id % 7 = 0, 'delete_partition', 'upsert') AS action", "timestamp_ntz'2024-01-01 00:00:00' AS event_time",
        "timestamp_ntz'2024-01-01 00:00:00' AS publish_time", "cast(id AS string) AS message_id", "'u' AS self_link", "id AS size",
        "'d/x' AS object_name", "false AS acked")
    reg = fixtures.event_registry(spark, SF_SMALL)
    seen = {}
    real = fold.materialise
    fold.materialise = lambda df: seen.setdefault(len(seen), df) and real(df)
    # so few rows would be one task's
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sm = fold.summarise(reg, rows)
    finally:
        fold.materialise = real
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    plan = seen[1]._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert len(windows) == 2 and "Join" not in windows[0]
    cut = [x for x in windows if "_run" in x.split("[dataset_id")[-1].split("]")[0]]
    assert len(cut) == 1                        # partitioned by the run too
    runs = sm.eff.where("partition_name = 'hot'").groupBy("_run").count()
    assert runs.count() > 2 and runs.agg({"count": "max"}).first()[0] < n / 6


def test_latest_is_partially_aggregated(spark):
    plan = _plan(listing.latest_partitions(fixtures.partitions(spark, SF_SMALL)))
    assert "partial_max_by" in plan and "Window" not in plan


def test_per_dataset_page_limits_before_shuffle(spark):
    plan = _plan(listing.list_partitions(fixtures.registry(spark, SF_SMALL), count=3, offset=1))
    assert "WindowGroupLimit" in plan and "Partial" in plan
