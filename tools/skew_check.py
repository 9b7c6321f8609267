"""Fold a batch in which one file key gets a third of all messages and report,
from Spark's event log, the largest and the median shuffle-read records of
the tasks of each stage (a hot key landing in one task shows as max >> median).

    python tools/skew_check.py [sf_dir]

The event log goes to a fresh scratch folder; nothing else is written.
"""

from __future__ import annotations

import collections
import glob
import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="skew-check-")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F
    from shelfmark.session import SESSION_CONF, checkpoint_dir
    b = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
         .config("spark.eventLog.compress", "false"))
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    from shelfmark.operators import events, fold
    from shelfmark.plans import catalog
    from shelfmark.sources import fixtures

    reg = fixtures.event_registry(spark, sf_dir)
    dec = catalog._decoded(spark, sf_dir)
    hot = (F.abs(F.hash("message_id")) % 3 == 0) & F.col("reason").isNull()
    dec = (dec.withColumn("dataset_name", F.when(hot, F.lit("user_1")).otherwise(F.col("dataset_name")))
           .withColumn("partition_name", F.when(hot, F.lit("2024/hot.ndjson"))
                       .otherwise(F.col("partition_name")))
           .withColumn("event_type", F.when(hot, F.lit("OBJECT_FINALIZE")).otherwise(F.col("event_type"))))
    t = time.time()
    sm = fold.summarise(reg, events.route_events(dec, reg.datasets))
    rows = fold.folded_partitions(reg, sm).count()
    secs = time.time() - t
    spark.stop()

    stages = collections.defaultdict(list)
    for path in glob.glob(os.path.join(log_dir, "*", "*events*")):
        for line in open(path):
            e = json.loads(line)
            if e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
                sr = e["Task Metrics"].get("Shuffle Read Metrics", {})
                stages[e["Stage ID"]].append(sr.get("Total Records Read", 0))
    report = []
    for sid, recs in stages.items():
        if sum(recs) > 1000 and len(recs) > 1:
            recs = sorted(recs)
            report.append({"stage": sid, "tasks": len(recs), "total": sum(recs),
                           "max": recs[-1], "median": recs[len(recs) // 2]})
    report.sort(key=lambda r: -r["max"] / max(r["median"], 1))
    print(json.dumps({"rows": rows, "secs": round(secs, 2), "worst_stages": report[:5]}))


if __name__ == "__main__":
    main(sys.argv)
