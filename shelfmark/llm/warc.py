"""WARC archives with revisits, and one merged capture index (operator 10).

Writing: payload digests are computed in the scan; of the pages whose
payloads (of at least ``min_bytes``) are equal, the smallest page id is the
response and the others are revisit records that carry no payload. Records
are WARC/1.1 text, written by Spark as gzip-compressed archives into the
shared folder.

Reading: every archive is parsed by its record lengths, digests of response
payloads are recomputed and compared, and its captures form a run, sorted by
(url key, timestamp, page id) where it is read. The runs are cut at common
range bounds, and each range merges its pieces of the runs with a loser tree
(one comparison per tree level for each capture), which leaves the whole
index in global order: partition by partition, row by row.

Defined results: a null html is an empty payload, a null url an empty key; a
null page id is written as an empty one and read as null; rows with equal
ids are separate records (rows that repeat the smallest id of a payload are
all responses); an empty table writes no record and reads none.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread, stored

#: Payloads below this many bytes are always responses.
MIN_BYTES = 100
#: Records in one archive at most.
ARCHIVE_RECORDS = 5_000
SAMPLE = 20
EPOCH = 1_704_067_200  # capture time of page 0; one second a page

CAPTURE = T.StructType([
    T.StructField("url_key", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("archive", T.StringType()),
    T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])


# --- writing --------------------------------------------------------------

def _first_of_equals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """digest -> smallest page id, for payloads found more than once."""
    d = pages.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"),
                     F.octet_length("html").alias("n")).where(F.col("n") >= min_bytes)
    d = d.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    return stored(d.where("copies > 1").select(F.col("digest").alias("dup_digest"), "first"), "equal-payloads")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """One WARC record for each row, in archives under ``folder``."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"),
                     F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                     F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    firsts = _first_of_equals(p, min_bytes)
    p = p.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "n": F.octet_length("html")})
    # equal digests are equal lengths, so that short payloads find no match
    p = p.join(firsts, F.col("digest") == F.col("dup_digest"), "left")
    p = p.withColumn("revisit", F.col("first").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("first"))))
    when = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col("page_id"), F.lit(0))),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'")
    # a url's line breaks would end the header line
    url = F.regexp_replace("url", r"[\r\n]", " ")
    row_id = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html"))
    record = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), row_id, F.lit(">")),
        F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("n").cast("string")),
        F.when(F.col("revisit"), F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
            F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
        F.concat(F.lit("\r\n"), body))
    # two line breaks end a record
    (p.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", ARCHIVE_RECORDS).text(folder))


# --- reading --------------------------------------------------------------

def url_key(url: str) -> str:
    """Reversed host labels, ')', then the rest without the scheme."""
    rest = url.split("://", 1)[-1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def parse(content: bytes, archive: str):
    """The captures of one archive's bytes, in the order of its records."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"{archive}: no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        body = end + 4
        stop = body + int(head["Content-Length"])
        if content[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"{archive}: the record at byte {at} has another length")
        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
        if kind == "response" and hashlib.sha256(content[body:stop]).hexdigest() != digest:
            raise ValueError(f"{archive}: the payload at byte {body} has another digest")
        ident = lambda s: int(x) if (x := s.removeprefix("<urn:page:").removesuffix(">")) else None
        yield (url_key(head["WARC-Target-URI"]), head["WARC-Date"], ident(head["WARC-Record-ID"]),
               int(head["X-Payload-Length"]), digest, kind,
               ident(head["WARC-Refers-To"]) if kind == "revisit" else None, archive, at, stop + 4 - at)
        at = stop + 4


def _order(capture) -> tuple:
    return (capture[0], capture[1], capture[2] is not None, capture[2] or 0, capture[7], capture[8])


def _runs(batches):
    """Archives to captures; each archive is a run in index order."""
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content")):
            data = content.as_py()
            if data and path.endswith(".gz"):
                data = zlib.decompress(data, wbits=31)
            rows = sorted(parse(data, os.path.basename(path)), key=_order)
            del data
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], names=CAPTURE.names)


_ARROW = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
          pa.string(), pa.int64(), pa.int64()]


def loser_tree(runs: list[list], key):
    """Merges sorted runs: inner nodes keep the loser of each match, so the
    next smallest costs one match per level."""
    k = max(1, 1 << (len(runs) - 1).bit_length())
    ends = object()

    def source(run):
        for x in run:
            yield key(x), x
        while True:
            yield ends, None

    feeds = [source(r) for r in runs] + [source([]) for _ in range(k - len(runs))]
    heads = [next(f) for f in feeds]

    def beats(i, j):
        a, b = heads[i][0], heads[j][0]
        return b is ends or (a is not ends and (a, i) < (b, j))

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        i, j = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (i, j) if beats(i, j) else (j, i)
    champion = winners[1] if k > 1 else 0
    while heads[champion][0] is not ends:
        yield heads[champion][1]
        heads[champion] = next(feeds[champion])
        node = (champion + k) // 2
        while node:
            if beats(losers[node], champion):
                losers[node], champion = champion, losers[node]
            node //= 2


def _merge(batches):
    """One range at a time: its pieces of the runs, merged."""
    def emit(runs):
        rows = []
        for x in loser_tree(runs, _order):
            rows.append(x)
            if len(rows) == 4096:
                yield rows
                rows = []
        if rows:
            yield rows

    def frames(runs):
        for rows in emit(runs):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)],
                                             names=CAPTURE.names)

    part, runs, last = None, [], None
    for b in batches:
        cols = [b.column(n).to_pylist() for n in CAPTURE.names]
        for r, *row in zip(b.column("range").to_pylist(), *cols):
            if r != part:
                if runs:
                    yield from frames(runs)
                part, runs, last = r, [], None
            if row[7] != last:
                runs.append([])
                last = row[7]
            runs[-1].append(tuple(row))
    if runs:
        yield from frames(runs)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives under ``folder`` in global order of
    (url key, timestamp, page id)."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    captures = stored(files.select("path", "content").mapInArrow(_runs, CAPTURE), "capture-runs")
    key = F.struct("url_key", "timestamp", F.coalesce(F.col("page_id"), F.lit(-(2 ** 63))).alias("page_id"))
    picked = captures.select(key.alias("k")).orderBy(F.xxhash64("k")).limit(SAMPLE * n)
    # range bounds: at most SAMPLE keys for each range, for balance only
    got = sorted({tuple(r.k) for r in picked.collect()})
    bounds = sorted({got[len(got) * i // n] for i in range(1, n)}) if got else []
    cut = F.array(*[F.struct(F.lit(u).alias("url_key"), F.lit(t).alias("timestamp"), F.lit(i).cast("long").alias("page_id"))
                    for u, t, i in bounds]) if bounds else None
    return _dealt(captures, key, cut, len(bounds), n).mapInArrow(_merge, CAPTURE)


def _dealt(captures, key, cut, n_bounds, n):
    steps = [1 << i for i in reversed(range(max(1, n_bounds).bit_length()))]
    at = F.lit(0) if cut is None else F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when(
            (lo + s <= n_bounds) & (F.get(cut, lo + s - 1) <= key), lo + s).otherwise(lo))
    return (captures.withColumn("range", at).repartitionByRange(n, "range")
            .sortWithinPartitions("range", "archive", "url_key", "timestamp",
                                  F.col("page_id").isNotNull(), "page_id", "offset"))


def round_trip(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Archives written from the pages, and the merged index read back."""
    spark = pages.sparkSession
    if folder is None:
        from ..session import checkpoint_dir
        folder = os.path.join(checkpoint_dir(spark), f"warc-{uuid.uuid4().hex}")
    write_archives(spread(pages), folder, **columns)
    return read_index(spark, folder)
