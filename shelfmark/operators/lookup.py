"""Set-at-a-time lookups.

The reference answers one request per SQL statement. Here a DataFrame of
requests is joined to the registry once: requests are left-joined so a
request without a match stays visible (``found = false``) where the
reference would return a not-found error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.formats import display_ts, human_size
from ..functions.sizing import broadcast_if_bounded, small_side
from ..session import materialise
from ..sources.derived import grams, name_grams
from ..sources.registry import Registry
from .listing import dataset_view, latest_partitions


def manager_public(managers: DataFrame) -> DataFrame:
    """The only manager columns that leave the registry."""
    return managers.select("manager_id", "manager_email", "api_key")


def find_managers(managers: DataFrame, requests: DataFrame, by: str = "api_key") -> DataFrame:
    """Managers by ``api_key`` (or ``manager_email``), public columns."""
    if by not in ("api_key", "manager_email"):
        raise ValueError(f"managers are found by api_key or manager_email, not {by}")
    hit = manager_public(managers).withColumn("found", F.lit(True))
    return (requests.select(by).join(hit, by, "left")
            .withColumn("found", F.coalesce("found", F.lit(False))))


def _narrow(table: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a registry table whose keys are requested: a map-side semi
    join against the request keys when they are proven small, so a left
    join from a small request set never shuffles the whole table. A large
    request set is joined as it is (narrowing would only add a shuffle)."""
    wanted = broadcast_if_bounded(requests.select(*keys).distinct())
    return table if wanted is None else table.join(wanted, keys, "left_semi")


def find_datasets(reg: Registry, requests: DataFrame) -> DataFrame:
    """Datasets (with manager email) by unique name."""
    req = requests.select("dataset_name")
    hit = _narrow(dataset_view(reg), req, ["dataset_name"]).withColumn("found", F.lit(True))
    return (req.join(hit, "dataset_name", "left")
            .withColumn("found", F.coalesce("found", F.lit(False))))


def find_partitions(reg: Registry, requests: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """P5: partitions by (dataset_name, partition_name); the name
    ``latest`` stands for the dataset's newest partition (W1), which
    ``newest`` may hold already."""
    requests = requests.select("dataset_name", "partition_name")
    ds = reg.datasets.select("dataset_id", "dataset_name")
    parts = reg.partitions
    wanted = broadcast_if_bounded(requests.select("dataset_name").distinct())
    if wanted is not None:
        # few datasets asked for: read only theirs, map-side
        ds = ds.join(wanted, "dataset_name", "left_semi")
        parts = parts.join(small_side(ds.select("dataset_id")), "dataset_id", "left_semi")
    req = requests.join(ds, "dataset_name", "left")
    cols = [c for c in S.PARTITION_COLUMNS if c not in ("dataset_id", "partition_name")]
    named = parts.select("dataset_id", "partition_name", *cols)
    # the newest partition only of the datasets asked for 'latest'
    asked = req.where(F.col("partition_name") == S.LATEST).select("dataset_id").distinct()
    if newest is None:
        newest = latest_partitions(parts.join(asked, "dataset_id", "left_semi"))
    newest = materialise(newest.select(
        "dataset_id", F.lit(S.LATEST).alias("partition_name"),
        F.col("partition_name").alias("resolved_name"), *cols))
    # a request without a name is not for the latest and finds nothing
    asks_latest = F.coalesce(F.col("partition_name") == S.LATEST, F.lit(False))
    by_name = (req.where(~asks_latest)
               .join(named, ["dataset_id", "partition_name"], "left")
               .withColumn("resolved_name", F.when(F.col("partition_id").isNotNull(),
                                                   F.col("partition_name"))))
    by_latest = (req.where(asks_latest)
                 .join(newest, ["dataset_id", "partition_name"], "left"))
    out_cols = ["dataset_name", "partition_name", "dataset_id", "resolved_name", *cols]
    return (by_name.select(*out_cols).unionByName(by_latest.select(*out_cols))
            .withColumn("found", F.col("partition_id").isNotNull()))


def partitions_by_name(reg: Registry, requests: DataFrame) -> DataFrame:
    """Every partition of the requested dataset names."""
    ds = reg.datasets.select("dataset_id", "dataset_name").join(
        requests.select("dataset_name").distinct(), "dataset_name", "left_semi")
    return reg.partitions.join(ds, "dataset_id")


def manager_datasets(reg: Registry, requests: DataFrame) -> DataFrame:
    """Datasets of the managers with the requested api keys, oldest
    first. The reference does not select the email here, so it is the
    empty string."""
    keys = reg.managers.join(requests.select("api_key").distinct(), "api_key", "left_semi")
    return (reg.datasets.join(keys.select("manager_id", "api_key"), "manager_id")
            .withColumn("manager_email", F.lit(""))
            .select("api_key", *S.DATASET_VIEW_COLUMNS)
            .orderBy("api_key", "created_at", "dataset_id"))


# ---------------------------------------------------------------------------
# Search (P7, J8, A3)
# ---------------------------------------------------------------------------

def like_pattern(term) -> Column:
    """``'%' || term || '%'`` as PostgreSQL reads it: ``%`` and ``_`` are
    wildcards, a backslash makes the next character match itself (also the
    closing ``%``, after a term that ends in one)."""
    t = F.col(term) if isinstance(term, str) else term
    return F.regexp_replace(F.concat(F.lit("%"), t, F.lit("%")), r"(\\[%_\\])|\\", "$1")


def _literal_run(t: Column) -> Column:
    """Longest wildcard-free piece of a normalised term (escapes resolved)."""
    tokens = F.regexp_extract_all(t, F.lit(r"(\\.|[%_]|[^%_\\]+)"), 1)
    text = F.array_join(F.transform(tokens, lambda x: F.when(x.isin("%", "_"), F.lit("\u0000"))
                                    .when(x.startswith("\\"), F.substring(x, 2, 1))
                                    .otherwise(x)), "")
    pieces = F.split(text, "\u0000")
    return F.aggregate(pieces, F.lit(""),
                       lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))


# Term sets up to this size are matched by a broadcast nested loop.
NESTED_LOOP_TERMS = 1_000


def search_terms(terms: DataFrame) -> DataFrame:
    """Distinct terms with their pattern and its longest literal piece."""
    t = terms.select("term", like_pattern("term").alias("_pat")).distinct()
    return t.withColumn("_run", _literal_run(F.col("_pat")))


def _matches() -> Column:
    """The LIKE; the literal piece is looked for first, since a pattern that
    differs from row to row is compiled for each."""
    return F.expr("instr(dataset_name, _run) > 0 AND dataset_name LIKE _pat")


def search_datasets(reg: Registry, terms: DataFrame, max_broadcast: int | None = None) -> DataFrame:
    """Every (term, dataset) with ``dataset_name LIKE '%' || term || '%'``.

    Small term sets are broadcast to a nested-loop join; beyond the bound
    terms meet candidate names through their grams (``search_by_grams``).
    """
    view = dataset_view(reg)
    t = search_terms(terms)
    # the nested loop meets every (name, term) pair, so its bound is about
    # work, not only broadcast size
    small = broadcast_if_bounded(t, NESTED_LOOP_TERMS if max_broadcast is None else max_broadcast)
    if small is not None:
        return view.join(small, _matches()).drop("_pat", "_run")
    names = view.select("dataset_id", "dataset_name")
    return search_by_grams(view, lambda wanted: grams(names), t)


def search_by_grams(view: DataFrame, index, t: DataFrame) -> DataFrame:
    """Terms meet names through an equi-join on the rarest gram of their
    longest literal piece: three characters, or the whole piece where it has
    one or two. ``index(wanted)`` gives rows (gram, dataset_id, dataset_name)
    that hold all of the wanted grams. The rows have the name, so that the
    LIKE decides at once and only matches are joined to their datasets.
    Patterns without any literal ask for no more than a length: at least n
    characters. Names meet these by their length.
    """
    literal = t.where(F.length("_run") > 0)
    own = F.when(F.length("_run") < 3, F.array("_run")).otherwise(name_grams(F.col("_run"), (3,)))
    term_grams = materialise(literal.select("term", "_pat", "_run", F.explode(own).alias("gram")))
    wanted = small_side(term_grams.select("gram").distinct())
    # the wanted grams' rows, once: for how common each is, and to be met; a
    # stored index has them in the order of the grams, of which few are common
    rows = materialise(index(wanted).join(wanted, "gram", "left_semi").repartition("dataset_id"))
    freq = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    # a gram absent from every name means the term cannot match at all
    pick = (term_grams.join(freq, "gram", "left").fillna(0, ["_n"])
            .groupBy("term", "_pat", "_run").agg(F.min_by("gram", F.struct("_n", "gram")).alias("gram")))
    # a short gram may be in every name, so that rows aren't dealt out by it
    found = rows.join(small_side(materialise(pick)), "gram").where(_matches()).select("term", "dataset_id")
    by_gram = found.join(view, "dataset_id").select("term", *view.columns)
    # only wildcards: the pattern matches every name of at least as many
    # characters as it has underscores. Each length is met by equality.
    least = F.length(F.regexp_replace("_pat", "%", ""))
    blank = t.where(F.length("_run") == 0).select("term", least.alias("_least"))
    lengths = view.select(F.length("dataset_name").alias("_length")).distinct()
    # a few lengths hold most names, so that names aren't dealt out by them
    wide = small_side(materialise(blank.join(lengths, F.col("_least") <= F.col("_length")).select("term", "_length")))
    by_length = view.withColumn("_length", F.length("dataset_name")).join(wide, "_length")
    return by_gram.unionByName(by_length.select(*by_gram.columns))


def search_counts(reg: Registry, terms: DataFrame) -> DataFrame:
    """A3: hits per term, 0 for a term without hits."""
    hits = search_datasets(reg, terms).groupBy("term").agg(F.count("*").alias("hits"))
    return (terms.select("term").distinct().join(hits, "term", "left")
            .select("term", F.coalesce("hits", F.lit(0)).cast("long").alias("hits")))


# ---------------------------------------------------------------------------
# Views
# ---------------------------------------------------------------------------

def partition_view(partitions: DataFrame) -> DataFrame:
    """Partitions as the dataset page shows them: a latest
    badge, a human-readable size and a UTC display time."""
    # one row a dataset, materialised: the join below is of two plain
    # shuffles then, and AQE can split a dataset with very many partitions
    newest = materialise(latest_partitions(partitions).select("dataset_id", F.col("partition_id").alias("_latest")))
    return (partitions.join(newest, "dataset_id", "left")
            .withColumn("is_latest", F.coalesce(F.col("partition_id") == F.col("_latest"), F.lit(False)))
            .withColumn("size_display", human_size("partition_size"))
            .withColumn("created_display", display_ts("created_at"))
            .drop("_latest"))


def storage_uri(datasets: DataFrame, buckets: DataFrame) -> DataFrame:
    """``gs://<bucket of the classification>/<dataset>/``. The bucket
    map has one row per classification (four), so it is broadcast."""
    b = F.broadcast(buckets.select(F.col("classification").alias("dataset_classification"), "bucket"))
    return (datasets.join(b, "dataset_classification", "left")
            .select("dataset_id", "dataset_name", "dataset_classification", "bucket",
                    F.concat(F.lit("gs://"), F.col("bucket"), F.lit("/"),
                             F.col("dataset_name"), F.lit("/")).alias("storage_uri")))


def orphans(reg: Registry) -> DataFrame:
    """Rows whose foreign key has no parent."""
    ds = reg.datasets.join(reg.managers.select("manager_id"), "manager_id", "left_anti").select(
        F.lit("datasets.manager_id").alias("rule"), F.col("dataset_id").cast("string").alias("key"),
        F.concat(F.lit("no manager "), F.col("manager_id").cast("string")).alias("reason"))
    parts = reg.partitions.join(reg.datasets.select("dataset_id"), "dataset_id", "left_anti").select(
        F.lit("partitions.dataset_id").alias("rule"), F.col("partition_id").cast("string").alias("key"),
        F.concat(F.lit("no dataset "), F.col("dataset_id").cast("string")).alias("reason"))
    return ds.unionByName(parts)
