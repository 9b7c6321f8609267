"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: A word is a run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows and bytes in one Arrow batch sent to Python: whole texts, so few rows;
#: long ones end a batch sooner, so that only a single row can exceed the bytes.
BATCH_ROWS, BATCH_BYTES = 256, "32m"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once for each
    application: Spark sends the zip to every executor."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="package-"), "shelfmark_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(package):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(package)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """The package on the workers, and the session settings that the
    Python-backed operators rely on."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    checkpoint_dir(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out round robin if it is a scan of fewer splits than
    the cluster has cores (a single small file); else as it is."""
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row: a lambda's
    variable is bound to it, so that a nested lambda can't copy it into a
    step that runs for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; none for null or white space alone."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")),
                             rf"^{GAP}|{GAP}\z", "")
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(
        F.split(inner, GAP))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read
    again: cuts the lineage, survives lost executors, and later joins see a
    plain scan, so that Spark can split their skewed partitions."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a sieve for each key, and its most words of 64 bits (broadcast).
SIEVE_BITS, SIEVE_WORDS = 16, 1 << 18


def sieve(keys: DataFrame):
    """A function that splits rows by a column: those whose value may be one
    of ``keys`` (a table of one column, of the same type), and those whose
    value surely is none, nulls included.

    Only a Bloom filter of bounded size (a word of 64 bits for each key's
    hash, three bits of it set) is broadcast, so that a join with few matches
    moves few rows. An exact join of the first part has to follow; with more
    keys than the filter is made for, that part only grows.
    """
    n = min(1 << (keys.count() * SIEVE_BITS // 64).bit_length(), SIEVE_WORDS)
    word, bits, found = (f"{name}_{uuid.uuid4().hex}" for name in ("word", "bits", "found"))

    def place(value: Column) -> tuple[Column, Column]:
        h = F.xxhash64(value)
        one = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, at).bitwiseAND(63).cast("int"))
               for at in (40, 46, 52)]
        return h.bitwiseAND(n - 1), one[0].bitwiseOR(one[1]).bitwiseOR(one[2])

    at, mask = place(F.col(keys.columns[0]))
    table = stored(keys.where(F.col(keys.columns[0]).isNotNull()).select(at.alias(word), mask.alias(bits))
                   .groupBy(word).agg(F.bit_or(bits).alias(found)), "sieve")

    def split(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        at, mask = place(F.col(column))
        marked = rows.withColumn(word, at).withColumn(bits, mask).join(F.broadcast(table), word, "left")
        may = F.col(column).isNotNull() & F.coalesce(F.col(found).bitwiseAND(F.col(bits)) == F.col(bits), F.lit(False))
        return tuple(marked.where(x).drop(word, bits, found) for x in (may, ~may))

    return split


def bucket(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as text ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n
