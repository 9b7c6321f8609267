"""Dataset config files (dd.json): source (S4) and sink."""

from __future__ import annotations

import json
import os
import sys
import unicodedata
import uuid
from contextlib import contextmanager
from functools import reduce
from itertools import islice

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .. import schemas as S
from ..session import checkpoint_dir, materialise


#: Tasks that list folders at once. Spark's default, up to 10,000 tasks for
#: each folder of many folders, is a task for some two dozen datasets.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _listing(spark: SparkSession):
    """Folders are listed by four tasks a core, however many there are."""
    try:
        tasks = max(32, 4 * spark.sparkContext.defaultParallelism)
    except Exception:  # Spark Connect: the server side owns the setting
        yield
        return
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(tasks, int(before))))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


#: Paths that make a further task; files that Spark's own reader is given at once.
PATHS, FILES = 1000, 10_000
#: Rows of a walk: a folder to list, a file to read, a text read, a file for Spark's own reader.
FOLDER, FILE, TEXT, ODD = range(4)


def read_dataset_configs(spark: SparkSession, path: str) -> DataFrame:
    """dd.json files → typed config rows (one JSON object per file); enum
    values must be written exactly; ``source`` is the file the row came from. ``path``
    is a glob, a file, or a folder (read recursively, e.g. an export). A folder
    is listed and read by the tasks, and holds any number of files; the files
    of a glob, or of a store that only Spark opens, are listed in the driver."""
    root = None if any(ch in path for ch in "*?[{") else _folder(spark, path)
    if root is not None:
        return _read_folder(spark, *root)
    reader = _reader(spark)
    if any(ch in path for ch in "*?[{"):
        reader = reader.option("recursiveFileLookup", False)
    with _listing(spark):
        df = reader.json(path)
    return df.withColumn("source", F.input_file_name())


def _reader(spark: SparkSession):
    return spark.read.schema(S.DATASET_CONFIG).option("multiLine", True).option("recursiveFileLookup", True)


def _folder(spark: SparkSession, path: str) -> tuple[str, str, str] | None:
    """A folder as Spark's readers take it, as ``input_file_name`` writes it
    and as pyarrow takes it, if that opens it (as for the export) and there is
    a shared folder to keep what the tasks find."""
    from pyarrow import fs

    try:
        checkpoint_dir(spark)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p)
        uri = _slashes(full.toUri().toASCIIString())
        store, at = fs.FileSystem.from_uri(uri)
        if store.get_file_info(at).type != fs.FileType.Directory:
            return None
        return _slashes(full.toString()), _slashes(full.toUri().toString()), uri
    except Exception:  # Spark's reader opens it, or says why not
        return None


def _read_folder(spark: SparkSession, root: str, shown: str, uri: str) -> DataFrame:
    """Level by level, each task lists its folders and reads its files: the
    driver holds no names, only their number. A plain text is parsed as Spark's
    reader would; that reader itself takes all others, some at a time."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(S)
    visit, most = _visit(uri), max(32, 4 * spark.sparkContext.defaultParallelism)
    level = spark.range(0, 1, 1, 1).select(F.lit(FOLDER).alias("kind"), F.lit("").alias("path"))
    levels, odd = [], 0
    while level is not None:
        rows = materialise(level.mapInArrow(visit, "kind int, path string, value string"))
        levels.append(rows)
        n = {r.kind: r.n for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        more, odd = n.get(FOLDER, 0) + n.get(FILE, 0), odd + n.get(ODD, 0)
        # one by one: a few folders may hold all others
        level = rows.where(F.col("kind").isin(FOLDER, FILE)).select("kind", "path").repartition(
            min(most, more, 2 + more // PATHS)) if more else None
    found = reduce(DataFrame.union, levels)
    df = found.where(F.col("kind") == TEXT).select(
        F.from_json("value", S.DATASET_CONFIG).alias("c"), F.concat(F.lit(shown), "path").alias("source")).select("c.*", "source")
    if odd:
        df = df.unionByName(_read_odd(spark, found.where(F.col("kind") == ODD), root))
    return df.withColumn("source", F.coalesce("source", F.lit("")))  # as input_file_name, never null


def _read_odd(spark: SparkSession, rows: DataFrame, root: str) -> DataFrame:
    """Files that aren't plain: of several objects, of other encodings or
    types, compressed or damaged."""
    kept = os.path.join(checkpoint_dir(spark), f"configs-read-{uuid.uuid4().hex}")
    paths = (root + r.path for r in rows.select("path").toLocalIterator())
    while some := list(islice(paths, FILES)):
        with _listing(spark):
            df = _reader(spark).option("__globPaths__", False).json(some)
        df.withColumn("source", F.input_file_name()).write.mode("append").parquet(kept)
    return spark.read.schema(df.withColumn("source", F.input_file_name()).schema).parquet(kept)


def _visit(uri: str):
    """For ``mapInArrow``: (kind, path below the folder ``uri``) to what is there."""
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        rows, held = [], 0
        names = {"kind": pa.int32(), "path": pa.string(), "value": pa.string()}

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), names.values())], names=list(names))

        for b in batches:
            for kind, path in zip(b.column("kind").to_pylist(), b.column("path").to_pylist()):
                for row in _listed(store, root, path) if kind == FOLDER else _texts(store, root, path):
                    rows.append(row)
                    held += len(row[1]) + len(row[2] or "")
                    if held > 1 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()
    return run


def _listed(store, root: str, path: str):
    """What Spark's reader sees in a folder; a local one is listed entry by entry."""
    from pyarrow import fs

    def local():
        with os.scandir(root + path) as entries:
            for e in entries:
                if e.is_dir() or e.is_file():
                    yield e.name, e.is_dir()

    def other():
        for i in store.get_file_info(fs.FileSelector(root + path)):
            if i.type in (fs.FileType.Directory, fs.FileType.File):
                yield i.base_name, i.type == fs.FileType.Directory

    for name, folder in local() if isinstance(store, fs.LocalFileSystem) else other():
        hidden = name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name
        if not hidden or folder and name.startswith(("_metadata", "_common_metadata")):
            yield FOLDER if folder else FILE, f"{path}/{name}", None


def _texts(store, root: str, path: str):
    from pyarrow import fs

    folder, _, name = path.rpartition("/")
    # Hadoop checks a local file that it wrote
    summed = isinstance(store, fs.LocalFileSystem) and os.path.exists(f"{root}{folder}/.{name}.crc")
    if summed or not name.endswith(".json"):
        yield ODD, path, None
        return
    with store.open_input_stream(root + path, compression=None) as f:
        data = f.read()
    if _plain(data):
        yield TEXT, _quoted(path), data.decode("utf-8")
    elif data:
        yield ODD, path, None


def _plain(data: bytes) -> bool:
    """Whether it is one object in UTF-8 whose values are all of their types:
    what isn't, Spark reads from a file otherwise than from a string."""
    def text(v):
        return v is None or isinstance(v, str)

    try:
        found = json.loads(data.decode("utf-8"), object_pairs_hook=tuple)
    except (ValueError, RecursionError):
        return False
    kinds = {f.name: f.dataType.typeName() for f in S.DATASET_CONFIG.fields}
    return isinstance(found, tuple) and all(
        k not in kinds or text(v) or kinds[k] == "map" and isinstance(v, tuple) and all(text(x) for _, x in v)
        for k, v in found)


#: What a URI's path has as it is, of ASCII.
PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-!.~'()*;/:@&=+$,")


def _quoted(path: str) -> str:
    """A path as ``java.net.URI`` and so ``input_file_name`` writes it."""
    return "".join(c if c in PLAIN or c > "\x7f" and unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc")
                   else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in path)


def storage_name(name: str) -> str:
    """A bucket's or dataset's name as folders. What Hadoop paths can't hold
    (``:``, ``%``, ``\\``, control characters, empty or dotted folders) is
    written as ``%XX``; every other name is itself."""
    safe = "".join(f"%{ord(c):02X}" if c in ":%\\" or c < " " else c for c in name)
    return "/".join(f.replace(".", "%2E") if f in (".", "..") else f or "%00" for f in safe.split("/"))


class ConfigWriter(DataSourceWriter):
    """Each task writes its files aside and renames them when they are whole:
    a file is never seen in part, and a task that runs again puts the same
    content there."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.root)
        for row in iterator:
            folder = f"{root}/{storage_name(row['bucket'])}/{storage_name(row['name'])}"
            store.create_dir(folder, recursive=True)
            aside = f"{folder}/.{S.CONFIG_FILE}.{uuid.uuid4().hex}"
            with store.open_output_stream(aside) as out:
                out.write(row["value"].encode("utf-8"))
            store.move(aside, f"{folder}/{S.CONFIG_FILE}")
        return WriterCommitMessage()


class ConfigSink(DataSource):
    """``df.write.format("dataset_config").option("path", folder)`` for rows of
    (bucket, name, value)."""

    @classmethod
    def name(cls) -> str:
        return "dataset_config"

    def schema(self) -> str:
        return "bucket string, name string, value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ConfigWriter(self.options["path"])


def export_configs(datasets: DataFrame, out: str, buckets: DataFrame | None = None) -> None:
    """Bulk form of the config upload: ``<out>/<bucket>/<dataset>/dd.json``
    for each dataset, in place of a file that is there. ``buckets`` maps each
    ``classification`` to its ``bucket``; without it the classification names
    the bucket. Datasets without a name or bucket have no file."""
    spark = datasets.sparkSession
    # the workers need no copy of this package
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(S)
    spark.dataSource.register(ConfigSink)
    body = F.to_json(F.struct(
        F.col("dataset_name").alias("name"),
        F.col("dataset_classification").alias("classification"),
        F.col("dataset_compression").alias("compression"),
        F.col("dataset_format").alias("format"),
        F.col("dataset_desc").alias("description"),
        F.col("dataset_schema").alias("schema"),
    ))
    rows = datasets.select(F.col("dataset_classification").alias("bucket"), F.col("dataset_name").alias("name"),
                           body.alias("value"))
    if buckets is not None:
        # one row for each classification: four
        uri = F.broadcast(buckets.select(F.col("classification").alias("_class"), F.col("bucket").alias("_bucket")))
        rows = rows.join(uri, F.col("bucket") == F.col("_class"), "left").select(
            F.col("_bucket").alias("bucket"), "name", "value")
    (rows.dropna(subset=["bucket", "name"]).write.format("dataset_config").mode("append")
     .option("path", _uri(spark, out)).save())


def _uri(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark finds it on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return _slashes(str(p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p)))


def _slashes(full: str) -> str:
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def config_path(out: str, bucket: str, name: str) -> str:
    return f"{out}/{storage_name(bucket)}/{storage_name(name)}/{S.CONFIG_FILE}"
