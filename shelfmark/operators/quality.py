"""Constraint reports (C2-C6): the database's constraints as set-based
checks. Detail functions give ``(rule, key, reason)`` rows; the report
counts violations per rule, zero included, in one aggregate per table plus
one per unique key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.sizing import small_side
from ..sources import registry as R
from ..sources.registry import Registry
from .lookup import orphans

UNIQUE = {
    "managers": [["manager_email"], ["api_key"]],
    "datasets": [["dataset_name"]],
    "partitions": [["dataset_id", "partition_name"]],
}
LENGTH = {
    "managers": {"manager_email": S.MAX_EMAIL},
    "datasets": {"dataset_name": S.MAX_NAME},
    "partitions": {"partition_name": S.MAX_NAME, "partition_url": S.MAX_URL},
}
DOMAIN = {
    "dataset_format": S.FORMATS,
    "dataset_compression": S.COMPRESSIONS,
    "dataset_classification": S.CLASSIFICATIONS,
}


def _rules(table: str) -> dict[str, Column]:
    """Per-row predicates that flag a violation, by rule name."""
    rules = {}
    for f in S.TABLES[table].fields:
        if not f.nullable:
            rules[f"{table}.{f.name} not null"] = F.col(f.name).isNull()
    for c, n in LENGTH.get(table, {}).items():
        rules[f"{table}.{c} length <= {n}"] = F.length(c) > n
    if table == "datasets":
        for c, dom in DOMAIN.items():
            rules[f"datasets.{c} in domain"] = ~F.col(c).isin(*dom)
    return rules


def _unique_name(table: str, cols: list[str]) -> str:
    return f"{table} unique({', '.join(cols)})"


def _held(cols: list[str]) -> Column:
    """Rows that a unique key concerns: SQL lets NULLs repeat."""
    out = F.col(cols[0]).isNotNull()
    for c in cols[1:]:
        out = out & F.col(c).isNotNull()
    return out


def unique_violations(reg: Registry) -> DataFrame:
    """Keys held by more than one row (a key with a NULL never is)."""
    out = []
    for table, keys in UNIQUE.items():
        df = getattr(reg, table)
        for cols in keys:
            dup = df.where(_held(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
            # of two columns the first is a number: the first '/' parts them
            out.append(dup.select(F.lit(_unique_name(table, cols)).alias("rule"),
                                  F.concat_ws("/", *[F.col(c).cast("string") for c in cols]).alias("key"),
                                  F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("reason")))
    return reduce(DataFrame.unionByName, out)


def row_violations(reg: Registry, kind: str | None = None) -> DataFrame:
    """Not-null, length and domain rules, one row per broken rule;
    ``kind`` ('not null', 'length', 'in domain') selects one family. Each
    table is read once: a row carries the list of the rules it breaks."""
    out = []
    ids = {"managers": "manager_id", "datasets": "dataset_id", "partitions": "partition_id"}
    for table in S.TABLES:
        rules = {r: bad for r, bad in _rules(table).items() if not kind or kind in r}
        if rules:
            broken = F.array_compact(F.array(*[F.when(bad, F.lit(r)) for r, bad in rules.items()]))
            out.append(getattr(reg, table).select(
                F.explode(broken).alias("rule"), F.col(ids[table]).cast("string").alias("key"),
                F.lit("violated").alias("reason")))
    return reduce(DataFrame.unionByName, out)


def commit_violations(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """C2-C6 for one commit of a stored registry: the violations that its rows
    make, as in the detail functions. Only the commit's own rows are read,
    and of the other tables the buckets that hold their keys: a partition
    and its dataset lie in one bucket, a name in that of ``names`` (a dataset
    whose name belongs to another id there is the name's second row).
    Managers are few and read whole."""
    now = R.manifest(spark, root, version)
    before = R.manifest(spark, root, now.version - 1) if now.version else None

    def written(table: str) -> DataFrame:
        old = before.tables.get(table, R.Files()).writes() if before else set()
        files = now.tables.get(table, R.Files())
        new = R.Files({b: e for b, e in files.base.items() if e[0] not in old},
                      [d for d in files.deltas if d["write"] not in old])
        return R.load_table(spark, root, R.Manifest(now.version, now.buckets, {table: new}, {}, {}), table)

    rows = Registry(*(written(t) for t in S.TABLES))
    managers = R.load_table(spark, root, now, "managers")
    buckets = R.buckets_of(rows.partitions, "dataset_id", now)
    datasets, partitions = (R.load_table(spark, root, now, t, buckets) for t in R.BUCKETED)
    key = UNIQUE["partitions"][0]
    near = partitions.join(small_side(rows.partitions.select(*key).distinct()), key, "left_semi")
    names = R.load_table(spark, root, now, "names", R.buckets_of(rows.datasets, "dataset_name", now))
    taken = (rows.datasets.select("dataset_name", F.col("dataset_id").alias("_id")).join(names, "dataset_name")
             .where(F.col("_id") != F.col("dataset_id")).select("dataset_name").distinct())
    emails = [rows.managers.select(c[0]).distinct() for c in UNIQUE["managers"]]
    twice = [unique_violations(Registry(managers.join(e, e.columns[0], "left_semi"), rows.datasets.limit(0), near))
             .where(F.col("rule").contains(e.columns[0])) for e in emails]
    parts = unique_violations(Registry(managers.limit(0), rows.datasets.limit(0), near))
    second = taken.select(F.lit(_unique_name("datasets", ["dataset_name"])).alias("rule"),
                          F.col("dataset_name").alias("key"), F.lit("2 rows").alias("reason"))
    fk = orphans(Registry(managers, datasets.select("dataset_id", "manager_id"), rows.partitions)).where(
        F.col("rule") == "partitions.dataset_id").unionByName(
        orphans(Registry(managers, rows.datasets, rows.partitions.limit(0))))
    return reduce(DataFrame.unionByName, [row_violations(rows), *twice, parts, second, fk])


def constraint_report(reg: Registry) -> DataFrame:
    """Violations per rule (zero included) for every registry constraint."""
    parts = []
    for table in S.TABLES:
        df = getattr(reg, table)
        rules = _rules(table)
        sums = df.agg(*[F.sum(F.when(bad, 1).otherwise(0)).alias(f"c{i}")
                        for i, bad in enumerate(rules.values())])
        stack = ", ".join(f"'{r}', c{i}" for i, r in enumerate(rules))
        parts.append(sums.selectExpr(f"stack({len(rules)}, {stack}) AS (rule, violations)"))
        for cols in UNIQUE[table]:
            n = (df.where(_held(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
                 .agg(F.count(F.lit(1)).alias("violations")))
            parts.append(n.select(F.lit(_unique_name(table, cols)).alias("rule"), "violations"))
    fk = orphans(reg).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
    fk_rules = reg.managers.sparkSession.createDataFrame(
        [("datasets.manager_id",), ("partitions.dataset_id",)], "rule string")
    parts.append(fk_rules.join(fk, "rule", "left")
                 .select(F.concat(F.lit("foreign key "), F.col("rule")).alias("rule"),
                         F.coalesce("violations", F.lit(0)).alias("violations")))
    return reduce(DataFrame.unionByName, parts).select(
        "rule", F.coalesce(F.col("violations"), F.lit(0)).cast("long").alias("violations"))
