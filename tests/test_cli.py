"""The command line: generate into a stored registry, retry, compact."""

import datetime as dt
import os
import tempfile

from shelfmark import schemas as S
from shelfmark.__main__ import main
from shelfmark.sources.registry import Registry, load_registry
from shelfmark.streaming import stream

HERE = os.path.dirname(__file__)


def test_cli_generate_retry_compact(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="cli-test-"), "registry")
    t0 = dt.datetime(2024, 1, 1)
    managers = spark.createDataFrame([(1, "m@x.org", "k", False, t0, t0)], S.MANAGERS)
    stream.init_registry(Registry(managers, spark.createDataFrame([], S.DATASETS),
                                  spark.createDataFrame([], S.PARTITIONS)), root)
    assert main(["generate", "--root", root, "--config", os.path.join(HERE, "data", "dd.json"),
                 "--count", "7", "--manager-id", "1"]) == 0
    names = [r.dataset_name for r in load_registry(spark, root).datasets.collect()]
    assert len(names) == 7 and all(n.startswith("tide_levels_") for n in names)
    assert main(["retry", "--root", root]) == 0
    assert main(["compact", "--root", root]) == 0
    assert stream.committed_versions(spark, root) == [0, 1, 2, 3]
    assert main(["rebucket", "--root", root, "--buckets", "3"]) == 0
    assert main(["vacuum", "--root", root, "--keep", "1"]) == 0
    assert stream.committed_versions(spark, root) == [4]
    assert load_registry(spark, root).datasets.count() == 7
