"""Column functions: paths, extensions, sizes, display, enum domains."""

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas as S
from shelfmark.functions import formats, paths
from shelfmark.operators import listing

# (object path, dataset, partition) — the reference's unit pairs plus edge cases
PATHS = [
    ("some_dataset/2020/03/25/some_partition.pb.tar.gz", "some_dataset",
     "2020/03/25/some_partition.pb.tar.gz"),
    ("o7hrlkjbasd/___pattern-1/23456/some_partition.pb.tar.gz", "o7hrlkjbasd",
     "___pattern-1/23456/some_partition.pb.tar.gz"),
    ("w/1_1__1___1_____1---3343-:some_partition.pb.tar.gz", "w",
     "1_1__1___1_____1---3343-:some_partition.pb.tar.gz"),
    ("__r34-d--de-fsine3/s", "__r34-d--de-fsine3", "s"),
    ("some_dataset", "some_dataset", None),
    ("o7hrlkjbasd", "o7hrlkjbasd", None),
    ("a/a/x.csv", "a", "x.csv"),
    ("a/", "a", ""),
    ("a/a", "a", None),
    ("a/dd.json", "a", None),
    ("a/s/dd.json", "a", "s/dd.json"),
    ("a//b", "a", "/b"),
    ("a.b/a.b/c", "a.b", "c"),
    ("x\\E/x\\E/y", "x\\E", "y"),
    ("/x", "/", "/x"),
    ("", None, None),
]


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p, _, _ in PATHS], "path string")
    got = {r.path: (r.ds, r.part) for r in df.select(
        "path", paths.dataset_of("path").alias("ds"), paths.partition_of("path").alias("part")).collect()}
    for p, ds, part in PATHS:
        assert got[p] == (ds, part), p


@pytest.mark.parametrize("fmt,comp,ext", [
    ("protobuf", "uncompressed", "pb"), ("csv", "gzip", "csv.tar.gz"), ("plaintext", "zip", "txt.zip"),
    ("ndjson", "uncompressed", "ndjson")])
def test_expected_ext(spark, fmt, comp, ext):
    row = spark.range(1).select(formats.expected_ext(F.lit(fmt), F.lit(comp)).alias("e")).first()
    assert row.e == ext


SIZES = [(0, "0B"), (1, "1B"), (1023, "1023B"), (1024, "1KB"), (1536, "1.5KB"), (1100, "1.07KB"),
         (1048575, "1024KB"), (1048576, "1MB"), (5 * 1024 ** 3 + 1, "5GB"), (1234567890123, "1.12TB"),
         (3 * 1024 ** 5, "3PB"), (10 ** 18, "888.18PB")]


def test_human_size(spark):
    df = spark.createDataFrame([(n,) for n, _ in SIZES], "n long")
    got = dict(df.select("n", formats.human_size("n").alias("h")).collect())
    assert got == dict(SIZES)


def test_display_ts(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'2020-03-25 07:08:09' AS t").select(
        formats.display_ts("t").alias("d")).first()
    assert row.d == "03/25/2020 07:08:09 UTC"


def test_generated_name(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'2021-02-03 04:05:06.789' AS t").select(
        formats.generated_name(F.lit("some_dataset"), F.lit(7), F.col("t")).alias("n")).first()
    assert row.n == "some_dataset_7_20210203_040506_789000_UTC"


def test_email_in_domain(spark):
    df = spark.createDataFrame([("abc@registry.test",), ("abc@other.org",),
                                ("x@registry.test.evil.org",)], "e string")
    got = [r.ok for r in df.select(formats.email_in_domain("e", "registry.test").alias("ok")).collect()]
    assert got == [True, False, True]  # a substring test, as in the reference
    assert df.select(formats.email_in_domain("e", None).alias("ok")).where("ok").count() == 3


def test_attribute_variants(spark):
    rows = [("csv", "zip", "public"), ("csv", "gzip", "public"), ("json", "zip", "internal")]
    ds = spark.createDataFrame(rows, "dataset_format string, dataset_compression string, dataset_classification string")
    got = {r.kind: dict(zip(r.variants.split(","), map(int, r.datasets.split(",")))) for r in
           listing.attribute_variants(ds).collect()}
    assert {k: list(v) for k, v in got.items()} == {
        "format": S.FORMATS, "compression": S.COMPRESSIONS, "classification": S.CLASSIFICATIONS}
    assert got["format"]["csv"] == 2 and got["format"]["tsv"] == 0 and got["classification"]["internal"] == 1
    kinds = {r.kind: r.n for r in listing.domain_table(spark).groupBy("kind").agg(
        F.count("*").alias("n")).collect()}
    assert kinds == {"format": 6, "compression": 3, "classification": 4}


def test_dataframe_wrappers(spark):
    from shelfmark.functions.paths import parse_paths
    from shelfmark.operators.mutations import generate_n_datasets
    df = parse_paths(spark.createDataFrame([("a/a/x.csv",)], "object_name string"))
    assert df.select("dataset_name", "partition_name").first() == ("a", "x.csv")
    tpl = {"name": "some_dataset", "classification": "public", "compression": "zip",
           "format": "protobuf", "description": "d", "schema": {"id": "integer"}}
    rows = generate_n_datasets(spark, tpl, 50, "2020-01-01 00:00:00").collect()
    assert len(rows) == 50 and rows[0].name.startswith("some_dataset_1_20200101_000000")
