"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of the library expects. Timestamps are UTC; AQE
# coalesces small shuffles toward ~128 MB partitions (so a large
# spark.sql.shuffle.partitions is safe to set on a cluster and spills stay
# bounded) and splits skewed join partitions at runtime.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "shelfmark") -> SparkSession:
    """Local session for tests and the bench. On a cluster the session is
    given, and only :data:`SESSION_CONF` is applied to it."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # checkpoint files of a batch are removed once nothing refers to
        # them (a long-running stream would otherwise fill the folder); a
        # context-start setting, so cluster sessions set it at submit time
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_conf(spark: SparkSession) -> SparkSession:
    for k, v in SESSION_CONF.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names shared storage and is only read here.
    Where it is unset a local master (tests, the bench) gets a fresh scratch
    folder, so lineage cuts still go through ``checkpoint()``; any other
    master is refused, since executors would not see that folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server side owns the setting
        return spark.conf.get("spark.checkpoint.dir", None)
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="shelfmark-ckpt-",
                                dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def materialise(df):
    """Cut lineage: ``df.checkpoint()`` (eager) into the shared checkpoint
    folder. Used where a result is read by several later passes or must not
    be recomputed differently after a lost executor; never a local
    checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
