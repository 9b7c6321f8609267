"""File-source stream with foreachBatch, restarted midway: the final
registry equals the batch fold of all notifications (SURVEY §5 (d))."""

import os
import tempfile

from pyspark.sql import functions as F

from shelfmark.operators import events, fold  # noqa: F401
from shelfmark.sources import fixtures
from shelfmark.sources.notifications import write_pull_responses
from shelfmark.streaming import stream

from conftest import SF_SMALL

COLS = ["dataset_id", "partition_name", "partition_url", "partition_size", "created_at", "updated_at"]


def _write_pulls(spark, env, out, lo, hi):
    write_pull_responses(env.where((F.col("pull_id") >= lo) & (F.col("pull_id") < hi)).coalesce(1), out)


def test_stream_restart_equals_batch_fold(spark):
    scratch = tempfile.mkdtemp(prefix="stream-test-")
    src, root, ckpt = (os.path.join(scratch, d) for d in ("src", "registry", "ckpt"))
    reg = fixtures.event_registry(spark, SF_SMALL)
    env = fixtures.envelopes(spark, SF_SMALL).cache()
    n_pulls = env.agg(F.max("pull_id")).first()[0] + 1
    cut = n_pulls // 2
    stream.init_registry(reg, root)

    _write_pulls(spark, env, os.path.join(src, "a"), 0, cut)
    q = stream.start_stream(spark, os.path.join(src, "*"), root, ckpt, max_files_per_trigger=1,
                            available_now=True)
    q.awaitTermination()
    first_versions = stream.committed_versions(spark, root)
    assert first_versions[-1] >= 1

    # restart with the rest of the pulls in a second file
    _write_pulls(spark, env, os.path.join(src, "b"), cut, n_pulls)
    q = stream.start_stream(spark, os.path.join(src, "*"), root, ckpt, max_files_per_trigger=1,
                            available_now=True)
    q.awaitTermination()
    versions = stream.committed_versions(spark, root)
    assert versions[-1] > first_versions[-1]

    got, pending = stream.current(spark, root)
    decoded = events.decode_notifications(events.flatten_envelope(env))
    want, want_pending = fold.fold_events(reg, events.route_events(decoded, reg.datasets))

    def rows(df, cols):
        return sorted(tuple(r) for r in df.select(*cols).collect())

    assert rows(got.partitions, COLS) == rows(want.partitions, COLS)
    ids = [r.partition_id for r in got.partitions.collect()]
    assert len(ids) == len(set(ids))                     # ids stay unique across versions
    dcols = ["dataset_id", "dataset_name", "updated_at"]
    assert rows(got.datasets, dcols) == rows(want.datasets, dcols)
    assert rows(pending, ["message_id"]) == rows(want_pending, ["message_id"])

    # a backfill of the same files into a fresh registry gives the same result
    root2 = os.path.join(scratch, "registry2")
    stream.init_registry(reg, root2)
    stream.backfill(spark, os.path.join(src, "*"), root2)
    got2, pending2 = stream.current(spark, root2)
    assert rows(got2.partitions, COLS) == rows(want.partitions, COLS)
    assert rows(pending2, ["message_id"]) == rows(want_pending, ["message_id"])

    # replaying a committed batch changes nothing
    before = rows(got.partitions, COLS)
    (sid, last), = stream.last_batches(spark, root, versions[-1]).items()
    assert last == versions[-1] - 1                    # one version per batch here
    assert stream.apply_decoded(spark, decoded, root, last, sid) == versions[-1]
    assert stream.committed_versions(spark, root) == versions
    assert rows(stream.current(spark, root)[0].partitions, COLS) == before


def test_pending_applies_after_registration(spark):
    """T4: a message for an unknown dataset waits; once the dataset is
    registered, retry_pending folds it in."""
    import datetime as dt
    from shelfmark import schemas as S
    from shelfmark.sources.registry import Registry
    root = os.path.join(tempfile.mkdtemp(prefix="pending-test-"), "registry")
    t0 = dt.datetime(2024, 1, 1)
    managers = spark.createDataFrame([(1, "m@x.org", "k", False, t0, t0)], S.MANAGERS)
    reg = Registry(managers, spark.createDataFrame([], S.DATASETS), spark.createDataFrame([], S.PARTITIONS))
    stream.init_registry(reg, root)
    msg = [("ack1", "m1", t0, S.EVENT_FINALIZE, t0, None, "late/2024/a.csv", "u://late/a", 10,
            "late", "2024/a.csv", None)]
    stream.apply_decoded(spark, spark.createDataFrame(msg, stream.DECODED), root, 1)
    got, pending = stream.current(spark, root)
    assert got.partitions.count() == 0 and [r.message_id for r in pending.collect()] == ["m1"]

    cfg = spark.createDataFrame(
        [(1, 1, "late", "csv", "zip", "public", "arrives late", {"id": "integer"})],
        "request_id long, manager_id long, name string, format string, compression string, "
        "classification string, description string, schema map<string,string>")
    version, rejected = stream.register_and_commit(spark, root, cfg, "2024-01-02 00:00:00")
    assert rejected.count() == 0 and version == 2
    assert stream.current(spark, root)[1].count() == 1      # still pending
    v = stream.retry_pending(spark, root)
    got, pending = stream.current(spark, root)
    assert v == 3 and pending.count() == 0
    row = got.partitions.first()
    assert (row.partition_name, row.partition_url, row.partition_size) == ("2024/a.csv", "u://late/a", 10)
    # the dataset's freshness moves to the insert's event time only if newer
    ds = got.datasets.first()
    assert ds.updated_at == dt.datetime(2024, 1, 2)


def test_continuous_trigger(spark):
    """The loop with a processing-time trigger (the reference's 1 s
    pull delay) picks up files as they arrive."""
    scratch = tempfile.mkdtemp(prefix="stream-cont-")
    src, root, ckpt = (os.path.join(scratch, d) for d in ("src", "registry", "ckpt"))
    os.makedirs(src)
    reg = fixtures.event_registry(spark, SF_SMALL)
    env = fixtures.envelopes(spark, SF_SMALL)
    stream.init_registry(reg, root)
    q = stream.start_stream(spark, os.path.join(src, "*"), root, ckpt, max_files_per_trigger=1,
                            processing_time="1 second")
    try:
        write_pull_responses(env.where("pull_id < 5").coalesce(1), os.path.join(src, "a"))
        q.processAllAvailable()
        got, _ = stream.current(spark, root)
        assert stream.committed_versions(spark, root)[-1] >= 1
        assert got.partitions.count() > 0
    finally:
        q.stop()


def test_batches_interleaved_with_registrations(spark):
    """Versions made by a registration between two stream batches do not
    make the next batch look applied; a replayed batch is still skipped."""
    import datetime as dt
    from shelfmark import schemas as S
    from shelfmark.sources.registry import Registry
    root = os.path.join(tempfile.mkdtemp(prefix="interleave-test-"), "registry")
    t0 = dt.datetime(2024, 1, 1)
    managers = spark.createDataFrame([(1, "m@x.org", "k", False, t0, t0)], S.MANAGERS)
    datasets = spark.createDataFrame([(1, "da", "d", "csv", "zip", "public", {}, 1, t0, t0)], S.DATASETS)
    stream.init_registry(Registry(managers, datasets, spark.createDataFrame([], S.PARTITIONS)), root)

    def msg(i, name):
        return spark.createDataFrame([(f"a{i}", f"m{i}", t0, S.EVENT_FINALIZE, t0 + dt.timedelta(minutes=i),
                                       None, f"da/{name}", f"u://{name}", i, "da", name, None)], stream.DECODED)

    assert stream.apply_decoded(spark, msg(1, "x"), root, 0) == 1
    cfg = spark.createDataFrame(
        [(1, 1, "db", "csv", "zip", "public", "second", {"id": "integer"})],
        "request_id long, manager_id long, name string, format string, compression string, "
        "classification string, description string, schema map<string,string>")
    assert stream.register_and_commit(spark, root, cfg, "2024-01-02 00:00:00")[0] == 2
    assert stream.apply_decoded(spark, msg(2, "y"), root, 1) == 3          # applied, not skipped
    assert stream.apply_decoded(spark, msg(2, "y"), root, 1) == 3          # replay: skipped
    names = sorted(r.partition_name for r in stream.current(spark, root)[0].partitions.collect())
    assert names == ["x", "y"]
    assert stream.last_batches(spark, root, 3) == {"": 1}


def test_batch_in_parts_goes_on_after_a_restart(spark, monkeypatch):
    """One file may hold any number of messages; what is folded at once never
    exceeds the bound, and a restart folds no part twice."""
    scratch = tempfile.mkdtemp(prefix="parts-test-")
    src, root, ckpt = (os.path.join(scratch, d) for d in ("src", "registry", "ckpt"))
    reg = fixtures.event_registry(spark, SF_SMALL)
    env = fixtures.envelopes(spark, SF_SMALL).cache()
    stream.init_registry(reg, root)
    _write_pulls(spark, env, src, 0, 10**9)                  # one file
    decoded = events.decode_notifications(events.flatten_envelope(env))
    total = decoded.count()
    bound = total // 4
    sizes, real = [], stream.apply_decoded

    def counted(spark, part, *args, **kw):
        if len(sizes) == 2:
            sizes.append(None)
            raise RuntimeError("lost")
        before = stream.latest_version(spark, root)
        after = real(spark, part, *args, **kw)
        sizes.append(part.count() if after > before else 0)  # 0: skipped
        return after
    monkeypatch.setattr(stream, "apply_decoded", counted)

    def run():
        q = stream.start_stream(spark, src, root, ckpt, available_now=True, max_messages=bound)
        q.awaitTermination()
    try:
        run()
    except Exception as e:
        assert "lost" in str(e)
    assert stream.last_batches(spark, root, stream.latest_version(spark, root)) == {}
    run()
    assert sizes[2] is None and sizes[3:5] == [0, 0]         # the parts that were in
    done = [n for n in sizes if n]
    assert sum(done) == total and max(done) <= bound
    (batch,) = stream.last_batches(spark, root, stream.latest_version(spark, root)).values()
    assert batch == 0
    got, pending = stream.current(spark, root)
    want, want_pending = fold.fold_events(reg, events.route_events(decoded, reg.datasets))

    def rows(df, cols):
        return sorted(tuple(r) for r in df.select(*cols).collect())
    assert rows(got.partitions, COLS) == rows(want.partitions, COLS)
    assert rows(got.datasets, ["dataset_id", "updated_at"]) == rows(want.datasets, ["dataset_id", "updated_at"])
    assert rows(pending, ["message_id"]) == rows(want_pending, ["message_id"])
