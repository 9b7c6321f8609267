"""Command line: ``python -m shelfmark <command> ...``.

    stream    --source DIR --root DIR --checkpoint DIR [--max-files N] [--max-messages N] [--available-now]
    backfill  --source DIR --root DIR
    retry     --root DIR
    compact   --root DIR
    vacuum    --root DIR [--keep N]
    rebucket  --root DIR --buckets N
    generate  --root DIR --config dd.json --count N --manager-id ID

``--root`` is the registry folder (see ``sources/registry.py``); it must
exist as a registry (version 0) except for ``stream``/``backfill``, which
start an empty registry there if none is committed.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .session import apply_conf, checkpoint_dir
from .sources import registry
from .sources.registry import empty_registry
from .streaming import stream


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("shelfmark").getOrCreate()
    apply_conf(spark)
    checkpoint_dir(spark)
    return spark


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="shelfmark")
    sub = p.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("stream", help="fold bucket notifications continuously")
    s.add_argument("--source", required=True)
    s.add_argument("--root", required=True)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--max-files", type=int, default=None)
    s.add_argument("--max-messages", type=int, default=None)
    s.add_argument("--available-now", action="store_true")
    b = sub.add_parser("backfill", help="fold every pull response under --source at once")
    b.add_argument("--source", required=True)
    b.add_argument("--root", required=True)
    r = sub.add_parser("retry", help="fold pending messages alone")
    r.add_argument("--root", required=True)
    c = sub.add_parser("compact", help="rewrite the registry as one full version")
    c.add_argument("--root", required=True)
    v = sub.add_parser("vacuum", help="remove all but the last versions")
    v.add_argument("--root", required=True)
    v.add_argument("--keep", type=int, default=2)
    n = sub.add_parser("rebucket", help="deal the tables into another number of buckets")
    n.add_argument("--root", required=True)
    n.add_argument("--buckets", type=int, required=True)
    g = sub.add_parser("generate", help="register N datasets from a template config")
    g.add_argument("--root", required=True)
    g.add_argument("--config", required=True)
    g.add_argument("--count", type=int, default=50)
    g.add_argument("--manager-id", type=int, required=True)
    a = p.parse_args(argv)

    spark = _session()
    if a.cmd in ("stream", "backfill"):
        stream.init_registry(empty_registry(spark), a.root)
    if a.cmd == "stream":
        q = stream.start_stream(spark, a.source, a.root, a.checkpoint, a.max_files, a.available_now,
                                max_messages=a.max_messages)
        q.awaitTermination()
    elif a.cmd == "backfill":
        print(stream.backfill(spark, a.source, a.root))
    elif a.cmd == "retry":
        print(stream.retry_pending(spark, a.root))
    elif a.cmd == "compact":
        print(stream.compact(spark, a.root))
    elif a.cmd == "vacuum":
        print(len(registry.vacuum(spark, a.root, a.keep)))
    elif a.cmd == "rebucket":
        print(registry.rebucket(spark, a.root, a.buckets))
    elif a.cmd == "generate":
        from .operators.mutations import generate_n_datasets
        with open(a.config) as f:
            template = json.load(f)
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat(sep=" ")
        configs = (generate_n_datasets(spark, template, a.count, now)
                   .withColumn("manager_id", F.lit(a.manager_id).cast("long")))
        version, rejected = stream.register_and_commit(spark, a.root, configs, now)
        print(version, rejected.count())
    return 0


if __name__ == "__main__":
    sys.exit(main())
