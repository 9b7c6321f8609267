"""Registry tables: typed scans (S1) and versioned snapshots.

A registry is three DataFrames. On storage each table is dealt into hash
buckets of its scope (the dataset's id, or name) and kept as

* base files, ``<root>/<table>/<write>/bucket=<b>/``: all rows of a bucket;
* delta files, ``<root>/<table>/<write>/``: the rows that one commit put or
  dropped, sorted by bucket. A reader merges a bucket's base with the deltas
  after it: the newest version of a key counts.

``<root>/_commits/<version>`` is the commit: a small JSON manifest that names
the files of every table by bucket, the bucket count, the largest ids, and by
stream the last batch. It is created only if absent (written aside and renamed
without overwriting, as Structured Streaming's own log is), so that of two
writers of one version one wins; the other drops its files and works its
change out anew on the winner's version (:func:`transact`). A commit thus
writes what it changes; a crash before the rename leaves files that no
manifest names, which :func:`vacuum` removes.

:func:`maintain` merges deltas into new base files for the buckets whose
deltas have outgrown ``COMPACT_BYTES`` and a share of the base, and merges
many deltas into one; :func:`rebucket` changes the bucket count; and
:func:`vacuum` keeps the last versions.

Besides the registry's tables there are ``names`` (name to id, by name),
``pending`` and ``dead_letters`` (messages) and ``fresh`` (names registered
since pending messages were last looked at); ``latest`` and ``grams`` are
optional (``sources.derived``).
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.sizing import MAX_BROADCAST_ROWS

#: Hash buckets of a new registry's tables; more buckets mean smaller merges.
BUCKETS = 64
#: A bucket is merged when its deltas have this many bytes and this share of
#: its base; a table's deltas become one when there are more than so many.
COMPACT_BYTES, COMPACT_SHARE, MAX_DELTAS = 32 << 20, 0.25, 16
#: Writers that lose to another try again so often.
TRIES = 20

NAMES = T.StructType([T.StructField("dataset_name", T.StringType()), T.StructField("dataset_id", T.LongType())])
FRESH = T.StructType([T.StructField("dataset_name", T.StringType())])
GRAMS = T.StructType([T.StructField("gram", T.StringType()), *reversed(NAMES.fields)])


class Registry(NamedTuple):
    managers: DataFrame
    datasets: DataFrame
    partitions: DataFrame


class Spec(NamedTuple):
    """A stored table: rows of one ``key`` replace each other (none: rows are
    only added); all rows of a ``scope`` lie in one bucket and can be dropped
    together (none: one bucket)."""

    schema: T.StructType
    key: tuple[str, ...]
    scope: str | None
    id_col: str | None = None


SPECS = {
    "managers": Spec(S.MANAGERS, ("manager_id",), None, "manager_id"),
    "datasets": Spec(S.DATASETS, ("dataset_id",), "dataset_id", "dataset_id"),
    "partitions": Spec(S.PARTITIONS, ("dataset_id", "partition_name"), "dataset_id", "partition_id"),
    "names": Spec(NAMES, ("dataset_name",), "dataset_name"),
    "pending": Spec(S.DECODED, (), "dataset_name"),
    "fresh": Spec(FRESH, (), "dataset_name"),
    "latest": Spec(S.PARTITIONS, ("dataset_id",), "dataset_id"),
    "grams": Spec(GRAMS, ("gram", "dataset_id"), "gram"),
    "dead_letters": Spec(T.StructType([*S.DEAD.fields, T.StructField("version", T.IntegerType())]), (), None),
}
BUCKETED = ("datasets", "partitions")


def conform(df: DataFrame, schema) -> DataFrame:
    """Cast and order columns to a registry table schema."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def empty_registry(spark: SparkSession) -> Registry:
    return Registry(*(spark.createDataFrame([], S.TABLES[t]) for t in S.TABLES))


def bucket_of(value, buckets: int = BUCKETS) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


# --- files ----------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(text.encode("utf-8"))
    finally:
        out.close()


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """``text`` as the file ``path``, whole or not at all; False if there is
    one already. The rename refuses to overwrite in one step on HDFS; a store
    whose rename does not needs a file system that offers that."""
    from py4j.protocol import Py4JJavaError

    jvm = spark._jvm
    aside = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{uuid.uuid4().hex}")
    _write_text(spark, aside, text)
    fs, src = _fs(spark, aside)
    dst = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        context.rename(fs.makeQualified(src), fs.makeQualified(dst), options)
    except Py4JJavaError as e:
        fs.delete(src, False)
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            return False
        raise
    return True


# --- manifests ------------------------------------------------------------

@dataclass
class Files:
    """The files of one table: ``base``: bucket -> [write, rows, bytes];
    ``deltas``: oldest first, each with its rows by bucket and its bytes."""

    base: dict[int, list] = field(default_factory=dict)
    deltas: list[dict] = field(default_factory=list)

    def writes(self) -> set[str]:
        return {w for w, _, _ in self.base.values()} | {d["write"] for d in self.deltas}


@dataclass
class Manifest:
    version: int
    buckets: int
    tables: dict[str, Files]
    max_ids: dict[str, int]
    batches: dict[str, int]

    def text(self) -> str:
        return json.dumps({
            "version": self.version, "buckets": self.buckets, "max_ids": self.max_ids, "batches": self.batches,
            "tables": {t: {"base": {str(b): e for b, e in f.base.items()}, "deltas": f.deltas}
                       for t, f in self.tables.items()}})

    @staticmethod
    def of(text: str) -> Manifest:
        x = json.loads(text)
        tables = {t: Files({int(b): e for b, e in f["base"].items()},
                           [{**d, "rows": {int(b): n for b, n in d["rows"].items()}} for d in f["deltas"]])
                  for t, f in x["tables"].items()}
        return Manifest(x["version"], x["buckets"], tables, x["max_ids"], x["batches"])


def _commit_path(root: str, version: int) -> str:
    return os.path.join(root, "_commits", str(version))


def committed_versions(spark: SparkSession, root: str) -> list[int]:
    """Versions with a manifest (a listing of one small folder)."""
    fs, p = _fs(spark, os.path.join(root, "_commits"))
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)
                  if s.getPath().getName().isdigit())


def is_committed(spark: SparkSession, root: str, version: int) -> bool:
    return exists(spark, _commit_path(root, version))


def latest_version(spark: SparkSession, root: str) -> int | None:
    """Newest committed version from the pointer written after each commit
    (checked forward, since a crash or a slower writer can leave it behind);
    a listing of the manifests where the pointer is of no use."""
    try:
        v = int(_read_text(spark, os.path.join(root, "_commits", "_latest")))
    except Exception:  # none yet, or just being written
        v = -1
    if v < 0 or not is_committed(spark, root, v):
        versions = committed_versions(spark, root)
        return versions[-1] if versions else None
    while is_committed(spark, root, v + 1):
        v += 1
    return v


def manifest(spark: SparkSession, root: str, version: int | None = None) -> Manifest | None:
    if version is None:
        version = latest_version(spark, root)
        if version is None:
            return None
    return Manifest.of(_read_text(spark, _commit_path(root, version)))


# --- reading --------------------------------------------------------------

def _delta_schema(spec: Spec) -> T.StructType:
    return T.StructType([*spec.schema.fields, T.StructField("bucket", T.IntegerType()),
                         T.StructField("_v", T.IntegerType()), T.StructField("_gone", T.BooleanType())])


def _deltas(spark: SparkSession, root: str, table: str, files: Files, wanted: set[int] | None):
    """(the table's delta rows of the wanted buckets or None, their number)."""
    spec, frames, rows = SPECS[table], [], 0
    whole: list[str] = []
    for d in files.deltas:
        mine = d["rows"].keys() if wanted is None else d["rows"].keys() & wanted
        if not mine:
            continue
        rows += sum(d["rows"][b] for b in mine)
        path = os.path.join(root, table, d["write"])
        if len(mine) == d["buckets"]:
            whole.append(path)
        else:  # row groups of other buckets are skipped
            frames.append(spark.read.schema(_delta_schema(spec)).parquet(path).where(F.col("bucket").isin(sorted(mine))))
    if whole:
        frames.append(spark.read.schema(_delta_schema(spec)).parquet(*whole))
    return (reduce(DataFrame.unionByName, frames) if frames else None), rows


def _newest(delta: DataFrame, spec: Spec):
    """(the newest row of each key, the newest drop of each scope or None)."""
    has_key = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in spec.key], F.lit(True))
    dropped = None
    if spec.scope is not None and spec.key != (spec.scope,):
        whole = F.col("_gone") & ~has_key if spec.key else F.col("_gone")
        dropped = delta.where(whole).groupBy(spec.scope).agg(F.max("_v").alias("_dropped"))
    if not spec.key:
        return delta.where(~F.col("_gone")), dropped
    fields = [c for c in delta.columns if c not in spec.key]
    newest = (delta.where(has_key).groupBy(*spec.key).agg(F.max_by(F.struct(*fields), "_v").alias("_row"))
              .select(*spec.key, "_row.*"))
    return newest, dropped


def _merged(base: DataFrame, delta: DataFrame, spec: Spec, small: bool) -> DataFrame:
    """A table's rows: its base and the deltas after it."""
    hint = F.broadcast if small else (lambda df: df)  # as many rows as the manifest says
    names = spec.schema.fieldNames()
    newest, dropped = _newest(delta, spec)
    if spec.key:
        base = base.join(hint(newest.select(*spec.key)), list(spec.key), "left_anti")
    live = newest.where(~F.col("_gone"))
    if dropped is not None:
        base = base.join(hint(dropped.select(spec.scope)), spec.scope, "left_anti")
        live = (live.join(hint(dropped), spec.scope, "left")
                .where(F.col("_dropped").isNull() | (F.col("_v") >= F.col("_dropped"))))
    return base.select(*names).unionByName(live.select(*names))


def load_table(spark: SparkSession, root: str, m: Manifest, table: str, only_buckets=None) -> DataFrame:
    """A table at a version (optionally some buckets only)."""
    spec, files = SPECS[table], m.tables.get(table, Files())
    wanted = None if only_buckets is None else set(only_buckets)
    paths = [os.path.join(root, table, w, f"bucket={b}") for b, (w, n, _) in sorted(files.base.items())
             if n and (wanted is None or b in wanted)]
    base = spark.read.schema(spec.schema).parquet(*paths) if paths else spark.createDataFrame([], spec.schema)
    delta, rows = _deltas(spark, root, table, files, wanted)
    return base if delta is None else _merged(base, delta, spec, rows <= MAX_BROADCAST_ROWS)


def load_partitions(spark: SparkSession, root: str, version: int, only_buckets=None) -> DataFrame:
    return load_table(spark, root, manifest(spark, root, version), "partitions", only_buckets)


def load_registry(spark: SparkSession, root: str, version: int | None = None, only_buckets=None) -> Registry:
    """The newest committed registry (or a version of it) with fixed schemas;
    ``only_buckets``: of its datasets and partitions."""
    m = manifest(spark, root, version)
    if m is None:
        return empty_registry(spark)
    return Registry(load_table(spark, root, m, "managers"),
                    *(load_table(spark, root, m, t, only_buckets) for t in BUCKETED))


def buckets_of(df: DataFrame, column: str, m: Manifest) -> list[int]:
    """The buckets that some ids or names lie in (at most as many numbers as
    there are buckets)."""
    return [r[0] for r in df.where(F.col(column).isNotNull())
            .select(bucket_of(column, m.buckets)).distinct().collect()]


# --- writing --------------------------------------------------------------

@dataclass
class Changes:
    """What a commit changes: rows ``put`` (whole, new or in place of their
    key's) and keys that ``drop``, by table; ``whole`` tables take the place of
    what was there, tables to ``clear`` lose their rows. A row of ``drop``
    without the rest of its key drops its whole scope. No key is in both."""

    put: dict[str, DataFrame] = field(default_factory=dict)
    drop: dict[str, DataFrame] = field(default_factory=dict)
    whole: dict[str, DataFrame] = field(default_factory=dict)
    clear: list[str] = field(default_factory=list)
    batches: dict[str, int] | None = None


def _bucket(spec: Spec, buckets: int) -> Column:
    return F.lit(0) if spec.scope is None else bucket_of(spec.scope, buckets)


def _sort(spec: Spec) -> list[str]:
    more = ["created_at"] if "created_at" in spec.schema.fieldNames() and spec.scope else []
    return ["bucket", *([spec.scope] if spec.scope else []), *more, *spec.key[1:]]


def _bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def _write_base(df: DataFrame, root: str, table: str, buckets: int) -> tuple[dict[int, list], int]:
    """(bucket -> [write, rows, bytes], largest id). Files follow the advisory
    partition size; a hot scope spreads over several."""
    spark, spec, write = df.sparkSession, SPECS[table], uuid.uuid4().hex
    path = os.path.join(root, table, write)
    (conform(df, spec.schema).withColumn("bucket", _bucket(spec, buckets))
     .repartitionByRange(*_sort(spec)).sortWithinPartitions(*_sort(spec))
     .write.partitionBy("bucket").parquet(path))
    if not _has_buckets(spark, path):
        return {}, 0
    schema = T.StructType([*spec.schema.fields, T.StructField("bucket", T.IntegerType())])
    top = F.max(spec.id_col) if spec.id_col else F.lit(0)
    held = spark.read.schema(schema).parquet(path).groupBy("bucket").agg(F.count("*"), top).collect()
    return ({b: [write, n, _bytes(spark, os.path.join(path, f"bucket={b}"))] for b, n, _ in held},
            max((x or 0 for _, _, x in held), default=0))


def _has_buckets(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return any(s.isDirectory() for s in fs.listStatus(p))


def _write_delta(df: DataFrame, root: str, table: str) -> tuple[dict | None, int]:
    """(entry of a delta with bucket, _v and _gone, or None; largest id)."""
    spark, spec, write = df.sparkSession, SPECS[table], uuid.uuid4().hex
    path = os.path.join(root, table, write)
    # as many files as the advisory partition size asks for, most often one
    (df.select(*_delta_schema(spec).fieldNames()).hint("rebalance")
     .sortWithinPartitions(*_sort(spec)).write.parquet(path))
    top = F.max(spec.id_col) if spec.id_col else F.lit(0)
    held = spark.read.schema(_delta_schema(spec)).parquet(path).groupBy("bucket").agg(F.count("*"), top).collect()
    if not held:
        _fs(spark, path)[0].delete(_fs(spark, path)[1], True)
        return None, 0
    rows = {b: n for b, n, _ in held}
    return ({"write": write, "rows": rows, "buckets": len(rows), "bytes": _bytes(spark, path)},
            max(x or 0 for _, _, x in held))


def _change_rows(table: str, changes: Changes, version: int, buckets: int) -> DataFrame | None:
    spec, frames = SPECS[table], []
    for rows, gone in ((changes.put.get(table), False), (changes.drop.get(table), True)):
        if rows is not None:
            missing = {f.name: F.lit(None) for f in spec.schema.fields if f.name not in rows.columns}
            frames.append(conform(rows.withColumns(missing), spec.schema).withColumns(
                {"bucket": _bucket(spec, buckets), "_v": F.lit(version), "_gone": F.lit(gone)}))
    return reduce(DataFrame.unionByName, frames) if frames else None


def try_commit(spark: SparkSession, root: str, before: Manifest | None, changes: Changes,
               buckets: int = BUCKETS) -> int | None:
    """The change as the version after ``before``; None, and nothing left
    behind, if another writer made that version first."""
    version = 0 if before is None else before.version + 1
    buckets = buckets if before is None else before.buckets
    tables = {} if before is None else {t: Files(dict(f.base), list(f.deltas)) for t, f in before.tables.items()}
    max_ids = {} if before is None else dict(before.max_ids)
    mine: list[str] = []
    for table, df in changes.whole.items():
        base, top = _write_base(df, root, table, buckets)
        tables[table] = Files(base)
        mine += [os.path.join(root, table, w) for w in tables[table].writes()]
        max_ids[table] = max(max_ids.get(table, 0), top)
    for table in changes.clear:
        tables[table] = Files()
    for table in sorted(changes.put.keys() | changes.drop.keys()):
        entry, top = _write_delta(_change_rows(table, changes, version, buckets), root, table)
        if entry is not None:
            tables.setdefault(table, Files()).deltas.append(entry)
            mine.append(os.path.join(root, table, entry["write"]))
            max_ids[table] = max(max_ids.get(table, 0), top)
    batches = changes.batches if changes.batches is not None else {} if before is None else before.batches
    return _publish(spark, root, Manifest(version, buckets, tables, max_ids, batches), mine)


def _publish(spark: SparkSession, root: str, m: Manifest, mine: list[str]) -> int | None:
    if not _put_if_absent(spark, _commit_path(root, m.version), m.text()):
        for path in mine:
            fs, p = _fs(spark, path)
            fs.delete(p, True)
        return None
    _write_text(spark, os.path.join(root, "_commits", "_latest"), str(m.version))
    return m.version


def transact(spark: SparkSession, root: str, build):
    """Commits ``build(manifest) -> (Changes or None, result)`` on the newest
    version; where another writer is first, the change is worked out anew on
    that writer's version. Returns (version, result)."""
    from .derived import with_derived

    for _ in range(TRIES):
        before = manifest(spark, root)
        changes, result = build(before)
        if changes is None:
            return before.version, result
        version = try_commit(spark, root, before, with_derived(spark, root, before, changes))
        if version is not None:
            return version, result
    raise RuntimeError(f"{TRIES} other commits came first")


def commit_snapshot(reg: Registry, root: str, buckets: int = BUCKETS, derived: bool = False) -> int | None:
    """Write ``reg`` whole as version 0, with the tables derived from it if
    asked for; None if the registry exists."""
    from .derived import tables

    spark = reg.datasets.sparkSession
    whole = {"managers": reg.managers, "datasets": reg.datasets, "partitions": reg.partitions,
             "names": reg.datasets.select("dataset_name", "dataset_id")}
    if derived:
        whole |= tables(reg)
    return try_commit(spark, root, None, Changes(whole=whole), buckets)


# --- maintenance ----------------------------------------------------------

def _due(files: Files) -> list[int]:
    """The buckets whose deltas have outgrown their base."""
    size: dict[int, float] = {}
    for d in files.deltas:
        total = sum(d["rows"].values())
        for b, n in d["rows"].items():
            size[b] = size.get(b, 0) + d["bytes"] * n / total
    return sorted(b for b, s in size.items()
                  if s >= COMPACT_BYTES and s >= COMPACT_SHARE * files.base.get(b, ["", 0, 0])[2])


def _rebased(spark: SparkSession, root: str, m: Manifest, table: str, buckets: list[int] | None) -> Files:
    """The table's files with new base files for some buckets (or all)."""
    files = m.tables[table]
    base, _ = _write_base(load_table(spark, root, m, table, buckets), root, table, m.buckets)
    if buckets is None:
        return Files(base)
    deltas = [{**d, "rows": {b: n for b, n in d["rows"].items() if b not in buckets}} for d in files.deltas]
    return Files({**{b: e for b, e in files.base.items() if b not in buckets}, **base},
                 [d for d in deltas if d["rows"]])


def _joined(spark: SparkSession, root: str, m: Manifest, table: str) -> Files:
    """The table's files with its deltas as one, the newest row of each key."""
    spec, files = SPECS[table], m.tables[table]
    delta, _ = _deltas(spark, root, table, files, None)
    newest, dropped = _newest(delta, spec)
    if dropped is not None:
        newest = (newest.join(dropped, spec.scope, "left")
                  .where(F.col("_dropped").isNull() | (F.col("_v") >= F.col("_dropped"))).drop("_dropped"))
        missing = {f.name: F.lit(None).cast(f.dataType) for f in spec.schema.fields if f.name != spec.scope}
        newest = newest.unionByName(
            dropped.withColumnRenamed("_dropped", "_v").withColumns(
                {**missing, "bucket": _bucket(spec, m.buckets), "_gone": F.lit(True)}).select(*newest.columns))
    entry, _ = _write_delta(newest, root, table)
    return Files(dict(files.base), [entry] if entry else [])


def _rewrite(spark: SparkSession, root: str, build) -> int | None:
    """Commits other files for the same rows; None if nothing was to do."""
    for _ in range(TRIES):
        before = manifest(spark, root)
        new = build(before)
        if new is None:
            return None
        buckets, tables = new
        old = {w for t, f in before.tables.items() for w in f.writes()}
        mine = [os.path.join(root, t, w) for t, f in tables.items() for w in f.writes() - old]
        m = Manifest(before.version + 1, buckets, {**before.tables, **tables}, before.max_ids, before.batches)
        version = _publish(spark, root, m, mine)
        if version is not None:
            return version
    raise RuntimeError(f"{TRIES} other commits came first")


def maintain(spark: SparkSession, root: str) -> int | None:
    """Merges what has outgrown its bounds; most calls only look at the
    manifest. Returns the version made, if any."""
    def build(m: Manifest):
        tables = {}
        for t, f in m.tables.items():
            due = _due(f)
            if due:
                tables[t] = _rebased(spark, root, m, t, due)
            elif len(f.deltas) > MAX_DELTAS:
                tables[t] = _joined(spark, root, m, t)
        return (m.buckets, tables) if tables else None
    return _rewrite(spark, root, build)


def compact(spark: SparkSession, root: str) -> int:
    """Every table as base files alone, as a new version."""
    return _rewrite(spark, root, lambda m: (m.buckets, {t: _rebased(spark, root, m, t, None) for t in m.tables}))


def rebucket(spark: SparkSession, root: str, buckets: int) -> int:
    """The same rows in another number of buckets, as a new version."""
    def build(m: Manifest):
        return buckets, {t: Files(_write_base(load_table(spark, root, m, t), root, t, buckets)[0]) for t in m.tables}
    return _rewrite(spark, root, build)


def vacuum(spark: SparkSession, root: str, keep: int = 2, grace_seconds: float = 86_400) -> list[str]:
    """Removes all but the last ``keep`` versions' manifests, and files that
    no kept manifest names and that are older than ``grace_seconds`` (younger
    ones may be a commit under way). Returns the folders removed."""
    versions = committed_versions(spark, root)
    kept = [manifest(spark, root, v) for v in versions[-keep:]]
    for v in versions[:-keep]:
        fs, p = _fs(spark, _commit_path(root, v))
        fs.delete(p, False)
    removed = []
    for table in SPECS:
        named = {w for m in kept for w in m.tables.get(table, Files()).writes()}
        fs, folder = _fs(spark, os.path.join(root, table))
        if not fs.exists(folder):
            continue
        for s in fs.listStatus(folder):
            old = s.getModificationTime() < (time.time() - grace_seconds) * 1000
            if s.getPath().getName() not in named and old:
                fs.delete(s.getPath(), True)
                removed.append(f"{table}/{s.getPath().getName()}")
    # sorted ranges of versions that are gone (operators.stored)
    fs, folder = _fs(spark, os.path.join(root, "_ordered"))
    for s in fs.listStatus(folder) if fs.exists(folder) else ():
        if int(s.getPath().getName().split("-")[0]) not in versions[-keep:]:
            fs.delete(s.getPath(), True)
            removed.append(f"_ordered/{s.getPath().getName()}")
    return removed
