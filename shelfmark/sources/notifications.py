"""Notification source (S2): pull responses as JSON lines, one response per
line, read as a stream with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S


def read_notifications(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of pull responses: ``receivedMessages``, and the
    text of a response that can't be read.
    ``max_files_per_trigger`` bounds a micro-batch, as the pull size does.
    ``path`` is a folder of JSON-lines files or a glob such as ``<dir>/*``
    for files in sub-folders (the glob is matched again on every trigger)."""
    reader = spark.readStream.schema(S.PULL_RESPONSE).option("columnNameOfCorruptRecord", S.UNREADABLE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def read_notifications_batch(spark: SparkSession, path: str) -> DataFrame:
    """The same files as one batch (backfill)."""
    return spark.read.schema(S.PULL_RESPONSE).option("columnNameOfCorruptRecord", S.UNREADABLE).json(path)


# RFC 3339 with microseconds, the precision Spark timestamps carry.
RFC3339 = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_pull_responses(envelopes: DataFrame, path: str) -> None:
    """Write pull responses as JSON lines (the shape the source reads)."""
    (envelopes.select("receivedMessages").write.mode("overwrite")
     .option("timestampFormat", RFC3339).json(path))


def read_notifications_kafka(spark: SparkSession, bootstrap_servers: str, topic: str,
                             max_offsets_per_trigger: int | None = None) -> DataFrame:
    """The same stream from a Kafka topic whose values are pull responses
    (needs the Kafka connector on the classpath; nothing else here does)."""
    from pyspark.sql import functions as F
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", bootstrap_servers).option("subscribe", topic))
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return (reader.load()
            .select(F.from_json(F.col("value").cast("string"), S.PULL_RESPONSE,
                                {"columnNameOfCorruptRecord": S.UNREADABLE}).alias("r"))
            .select("r.*"))
