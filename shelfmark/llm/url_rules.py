"""URL allow and block rules by a sort-merge range join (operator 4).

A host is written with its labels reversed, each ending in a dot
(``www.example.com`` -> ``com.example.www.``). A rule's host and all its
subdomains are then one interval of keys, and such intervals nest or are
disjoint. Urls and rules are dealt out over the same key ranges, sorted, and
one sweep per range keeps a stack of the rules whose interval is open; the
longest one whose path the url's path starts with decides.

Range bounds come from a bounded sample and serve balance only. A url's sort
key ends in its id, so a hot host or a repeated url is split over ranges. A
rule is copied to each range that its interval meets (short prefixes to
many, most rules to one): no broadcast and no limit on rules.

Defined results: null or '://'-less urls have empty host and path and fit
only a rule with an empty host (which fits every url); of rules of equal
(host, path) the block wins; of equally long ones the greater text wins;
null rule fields count as empty; rows with equal ids are judged one by one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower

#: Sampled keys per range, from which the bounds are taken.
SAMPLE = 20
END = "\U0010FFFF" * 4

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"),
         ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("net", "/fr/", "block")]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first '://' up to '/', '?', '#' or the end,
    lower-cased; then up to '?', '#' or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substr({0}, {1} + 3)".format("url", "instr(url, '://')"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*(/[^?#]*)", 1)
    return ascii_lower(host), path


def host_key(host: Column) -> Column:
    """Labels reversed, each ending in a dot; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def rule_frame(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _range_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds are at most ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    b = F.array(*[F.lit(x) for x in bounds])
    n, steps = len(bounds), []
    step = 1 << (n.bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when(
        (lo + s <= n) & (F.get(b, lo + s - 1) <= key), lo + s).otherwise(lo))


def _sweep(schema: T.StructType, default: str):
    """Rows of one or more ranges in order of (range, key, kind): rules open
    intervals, urls look at those that are open."""
    def run(batches):
        stack: list[tuple] = []   # (end, path, host, verdict), outermost first
        now = None
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in ("range", "key", "is_url", "host", "path", "verdict", "end")}
            keep, rule, verdict = [], [], []
            for i, (part, key, is_url) in enumerate(zip(cols["range"], cols["key"], cols["is_url"])):
                if part != now:
                    stack, now = [], part
                while stack and stack[-1][0] <= key:
                    stack.pop()
                if not is_url:
                    stack.append((cols["end"][i], cols["path"][i], cols["host"][i], cols["verdict"][i]))
                    continue
                path, best = cols["path"][i], None
                for _, p, h, v in stack:
                    if path.startswith(p):
                        size = (len(h) + len(p), h, p, v == "block")
                        if best is None or size > best[0]:
                            best = (size, h + p, v)
                keep.append(i)
                rule.append(best and best[1])
                verdict.append(best[2] if best else default)
            got = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [got.column("id"), got.column("host"), got.column("path"),
                 pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=schema.names)
    return run


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of each row;
    ``default`` is the verdict where no rule fits."""
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = split_url(F.col("url"))
    urls = src.select("id", host.alias("host"), path.alias("path"))
    # the host's own key, then bytes below any label: inside every interval
    # of the host's rules; the path and the id deal a hot host out further
    urls = urls.withColumn("key", F.concat(
        host_key(F.col("host")), F.lit("\u0000"), F.col("path"), F.lit("\u0000"),
        F.coalesce(F.col("id").cast("string"), F.lit(""))))

    picked = [r[0] for r in urls.select("key").orderBy(F.xxhash64("key")).limit(SAMPLE * n).collect()]
    picked = sorted(set(picked), key=lambda s: s.encode("utf-8"))
    bounds = sorted({picked[len(picked) * i // n] for i in range(1, n)} if picked else set(),
                    key=lambda s: s.encode("utf-8"))

    r = rules.select(ascii_lower(F.coalesce(F.col("host"), F.lit(""))).alias("host"),
                     F.coalesce(F.col("path"), F.lit("")).alias("path"),
                     F.coalesce(F.col("verdict"), F.lit(default)).alias("verdict"))
    r = r.groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict"))["verdict"].alias("verdict"))
    start = host_key(F.col("host"))
    r = r.withColumn("key", start).withColumn(
        # the least text that no longer starts with the key: '.' becomes '/'
        "end", F.when(F.col("host") == "", F.lit(END)).otherwise(
            F.concat(F.expr("substr(key, 1, length(key) - 1)"), F.lit("/"))))
    r = r.select(F.explode(F.sequence(_range_of(F.col("key"), bounds), _range_of(F.col("end"), bounds))).alias("range"),
                 "key", "end", "host", "path", "verdict")

    kind = src.schema["id"].dataType
    both = r.select("range", "key", F.lit(False).alias("is_url"), F.lit(None).cast(kind).alias("id"),
                    "host", "path", "verdict", "end").unionByName(
        urls.select(_range_of(F.col("key"), bounds).alias("range"), "key", F.lit(True).alias("is_url"), "id",
                    "host", "path", F.lit(None).cast("string").alias("verdict"),
                    F.lit(None).cast("string").alias("end")))
    dealt = both.repartition(n, "range").sortWithinPartitions("range", "key", "is_url", F.length("path"))
    schema = T.StructType([T.StructField("page_id", kind), T.StructField("host", T.StringType()),
                           T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()),
                           T.StructField("verdict", T.StringType())])
    return dealt.mapInArrow(_sweep(schema, default), schema)
