"""The set-based fold against a sequential model of the reference's loop
(one message at a time, in event order) on random batches."""

import datetime as dt
import random

import pytest

from shelfmark import schemas as S
from shelfmark.operators import events, fold
from shelfmark.sources.registry import Registry
from shelfmark.streaming.stream import DECODED

T0 = dt.datetime(2022, 1, 1)
KNOWN = {"a": 1, "b": 2, "c": 3}


def part_name(path):
    ds = path.split("/")[0]
    rest = path
    while rest.startswith(ds + "/"):
        rest = rest[len(ds) + 1:]
    return ds, (None if rest in (ds, "dd.json") else rest)


def model(prior_parts, msgs, registrations=()):
    """prior_parts: {(ds_id, name): (id, url, size, created, updated)};
    registrations: (request_id, name, at), before the messages of their time."""
    names = dict(KNOWN)
    next_id, refused = max(KNOWN.values()), set()
    log = [((m["event_time"], m["publish_time"], m["message_id"]), m) for m in msgs]
    log += [((at, dt.datetime.min, f"{i:020d}"), (i, name, at)) for i, name, at in registrations]
    new_ids = {}
    parts = {k: dict(id=v[0], url=v[1], size=v[2], created=v[3], updated=v[4], prior=True)
             for k, v in prior_parts.items()}
    fresh = {}
    pending, actions = [], {}
    for _, m in sorted(log, key=lambda x: x[0]):
        if isinstance(m, tuple):
            i, ds, at = m
            if ds in names:
                refused.add(i)
            else:
                next_id += 1
                names[ds] = new_ids[ds, at] = next_id
                fresh[next_id] = at
            continue
        ds, p = m["dataset_name"], m["partition_name"]
        now = m["event_time"]
        if ds in names:
            dsid = names[ds]
            if m["event_type"] != S.EVENT_DELETE:
                if p is None:
                    act = "noop"
                elif p == "latest":
                    act = "reject"
                else:
                    act = "upsert"
                    k = (dsid, p)
                    if k in parts:
                        updated = max(parts[k]["updated"], now) if parts[k]["prior"] else now
                        parts[k].update(url=m["self_link"], size=m["size"], updated=updated)
                    else:
                        parts[k] = dict(id=None, url=m["self_link"], size=m["size"], created=now,
                                        updated=now, prior=False)
                        fresh[dsid] = max(fresh.get(dsid, now), now)
            elif m["overwritten_by_generation"] is not None:
                act = "skip"
            elif p is not None:
                act = "delete_partition"
                parts.pop((dsid, p), None)
            else:
                act = "delete_dataset"
                del names[ds]
                parts = {k: v for k, v in parts.items() if k[0] != dsid}
        else:
            act = "ignore" if (m["object_name"].endswith("dd.json") or p is None) else "retry"
            if act == "retry":
                pending.append(m["message_id"])
        actions[m["message_id"]] = act
    base = max((v[0] for v in prior_parts.values()), default=0)
    new = sorted((v["created"], k[0], k[1]) for k, v in parts.items() if not v["prior"])
    for i, (_, dsid, name) in enumerate(new):
        parts[(dsid, name)]["id"] = base + i + 1
    return (names, parts, fresh, pending, actions, refused) if registrations else (names, parts, fresh, pending, actions)


def random_batch(rng, n, hot=0.0):
    msgs = []
    for i in range(n):
        ds = rng.choice(["a", "b", "c", "x"])
        kind = rng.random()
        if rng.random() < hot:          # one file key takes this share of the batch
            ds, kind = "a", 1.0
        if kind < 0.05:
            obj = f"{ds}/dd.json"
        elif kind < 0.08:
            obj = ds
        elif kind < 0.11:
            obj = f"{ds}/latest"
        elif kind < 0.14:
            obj = f"{ds}/{ds}/f{rng.randint(0, 2)}"
        elif ds == "a" and kind == 1.0:
            obj = "a/hot"
        else:
            obj = f"{ds}/f{rng.randint(0, 2)}"
        et = rng.choice([S.EVENT_FINALIZE, S.EVENT_FINALIZE, S.EVENT_METADATA_UPDATE, S.EVENT_ARCHIVE,
                         S.EVENT_DELETE, S.EVENT_DELETE])
        if et == S.EVENT_DELETE and obj in (f"{ds}/dd.json", ds) and rng.random() < 0.7:
            et = S.EVENT_FINALIZE   # keep dataset deletions rare
        ts = T0 + dt.timedelta(seconds=rng.randint(0, 40))
        dsn, p = part_name(obj)
        msgs.append(dict(
            ack_id=f"ack{i}", message_id=f"m{i:03d}", publish_time=ts + dt.timedelta(seconds=rng.randint(0, 3)),
            event_type=et, event_time=ts,
            overwritten_by_generation=("g" if et == S.EVENT_DELETE and rng.random() < 0.2 else None),
            object_name=obj, self_link=f"u://{obj}/{i}", size=i, dataset_name=dsn, partition_name=p,
            reason=None))
    return msgs


@pytest.mark.parametrize("seed,hot,drops", [(s, 0.0, 0.0) for s in range(6)]
                         + [(100, 0.34, 0.0), (101, 0.34, 0.0), (200, 0.0, 0.03), (201, 0.3, 0.03)])
def test_fold_matches_sequential_model(spark, seed, hot, drops):
    rng = random.Random(seed)
    prior_parts = {(1, "f0"): (7, "u://old0", 1, T0 - dt.timedelta(days=1), T0 + dt.timedelta(seconds=20)),
                   (2, "f1"): (9, "u://old1", 2, T0 - dt.timedelta(days=2), T0 - dt.timedelta(days=2))}
    msgs = random_batch(rng, 90 if hot else 60, hot)
    for m in msgs:                      # extra deletions of a whole dataset (bare name)
        if rng.random() < drops:
            m.update(event_type=S.EVENT_DELETE, overwritten_by_generation=None,
                     object_name=m["dataset_name"], partition_name=None)
    managers = spark.createDataFrame([(1, "m@x.org", "k", False, T0, T0)], S.MANAGERS)
    datasets = spark.createDataFrame(
        [(i, n, "d", "csv", "zip", "public", {}, 1, T0 - dt.timedelta(days=5), T0 - dt.timedelta(days=5))
         for n, i in KNOWN.items()], S.DATASETS)
    partitions = spark.createDataFrame(
        [(v[0], k[1], v[1], v[2], k[0], v[3], v[4]) for k, v in prior_parts.items()], S.PARTITIONS)
    reg = Registry(managers, datasets, partitions)
    decoded = spark.createDataFrame([tuple(m[f] for f in DECODED.fieldNames()) for m in msgs], DECODED)
    routed = events.route_events(decoded, reg.datasets)
    new, pending = fold.fold_events(reg, routed)

    names, parts, fresh, want_pending, actions = model(prior_parts, msgs)
    got_parts = {(r.dataset_id, r.partition_name): (r.partition_id, r.partition_url, r.partition_size,
                                                    r.created_at, r.updated_at)
                 for r in new.partitions.collect()}
    want_parts = {k: (v["id"], v["url"], v["size"], v["created"], v["updated"]) for k, v in parts.items()}
    assert got_parts == want_parts
    got_ds = {r.dataset_name: r.updated_at for r in new.datasets.collect()}
    want_ds = {n: max(T0 - dt.timedelta(days=5), fresh.get(i, T0 - dt.timedelta(days=5)))
               for n, i in names.items()}
    assert got_ds == want_ds
    assert sorted(r.message_id for r in pending.collect()) == sorted(want_pending)
    eff = {r.message_id: r.action for r in fold.effective_actions(routed).collect()}
    assert eff == actions


@pytest.mark.parametrize("seed", range(2))
def test_fold_of_a_log_with_registrations(spark, seed):
    """register → delete → register of one name inside one log, in memory and
    as a stored backfill, against the sequential model."""
    import os
    import tempfile

    from shelfmark.streaming import stream
    rng = random.Random(1000 + seed)
    prior_parts = {(1, "f0"): (7, "u://old0", 1, T0 - dt.timedelta(days=1), T0 + dt.timedelta(seconds=20)),
                   (2, "f1"): (9, "u://old1", 2, T0 - dt.timedelta(days=2), T0 - dt.timedelta(days=2))}
    msgs = random_batch(rng, 90)
    for m in msgs:
        if rng.random() < 0.15:
            m.update(event_type=S.EVENT_DELETE, overwritten_by_generation=None,
                     object_name=m["dataset_name"], partition_name=None)
    regs = [(i, rng.choice("abcxy"), T0 + dt.timedelta(seconds=rng.randint(0, 40))) for i in range(1, 25)]
    managers = spark.createDataFrame([(1, "m@x.org", "k", False, T0, T0)], S.MANAGERS)
    old = T0 - dt.timedelta(days=5)
    datasets = spark.createDataFrame([(i, n, "d", "csv", "zip", "public", {}, 1, old, old) for n, i in KNOWN.items()],
                                     S.DATASETS)
    partitions = spark.createDataFrame(
        [(v[0], k[1], v[1], v[2], k[0], v[3], v[4]) for k, v in prior_parts.items()], S.PARTITIONS)
    reg = Registry(managers, datasets, partitions)
    decoded = spark.createDataFrame([tuple(m[f] for f in DECODED.fieldNames()) for m in msgs], DECODED)
    configs = spark.createDataFrame(
        [(i, 1, n, "csv", "zip", "public", "d", {"a": "b"}, at) for i, n, at in regs]
        + [(90, 2, "nobody", "csv", "zip", "public", "d", {}, T0)],
        "request_id long, manager_id long, name string, format string, compression string, classification string, "
        "description string, schema map<string,string>, at timestamp_ntz")
    new, pending, rejected = fold.fold_log(reg, decoded, configs)
    names, parts, fresh, want_pending, _, refused = model(prior_parts, msgs, regs)
    assert len(refused) < 24 and max(names.values()) > 3
    want = {(k[0], k[1]): (v["url"], v["size"], v["created"], v["updated"]) for k, v in parts.items()}

    def check(registry, waiting):
        got = {(r.dataset_id, r.partition_name): (r.partition_url, r.partition_size, r.created_at, r.updated_at)
               for r in registry.partitions.collect()}
        assert got == want
        assert {r.dataset_name: (r.dataset_id, r.updated_at) for r in registry.datasets.collect()} == {
            n: (i, max(old, fresh.get(i, old))) for n, i in names.items()}
        assert sorted(r.message_id for r in waiting.collect()) == sorted(want_pending)
    check(new, pending)
    assert {r.request_id: r.reason for r in rejected.collect()} == {
        **dict.fromkeys(refused, "dataset_name already registered"), 90: "unknown manager"}
    ids = [r.partition_id for r in new.partitions.collect()]
    assert len(set(ids)) == len(ids)

    root = os.path.join(tempfile.mkdtemp(prefix="log-test-"), "registry")
    stream.init_registry(reg, root)
    stream.apply_decoded(spark, decoded, root, registrations=configs)
    check(*stream.current(spark, root))
    # waiting messages of names that the log registered are taken up next
    stream.retry_pending(spark, root)
    left = {r.dataset_name for r in stream.current(spark, root)[1].collect()}
    assert not left & set(names)
