"""Object path → (dataset, partition) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CONFIG_FILE


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dataset_of(path) -> Column:
    """First path component: ``a/b/c`` → ``a``; an absolute path → ``/``;
    the empty path has no component → NULL (a dead letter upstream)."""
    p = _c(path)
    return (
        F.when(p == "", F.lit(None).cast("string"))
        .when(p.startswith("/"), F.lit("/"))
        .otherwise(F.substring_index(p, "/", 1))
    )


def regex_quote(s: Column) -> Column:
    """Column form of ``java.util.regex.Pattern.quote``."""
    return F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def partition_of(path, dataset=None) -> Column:
    """Path with every leading ``<dataset>/`` removed (``a/a/x`` → ``x``).

    NULL when what is left is the dataset name itself or the config file
    name: the object stands for the dataset, not for a partition.
    ``a/`` gives the empty name, which is a partition name.
    """
    p = _c(path)
    ds = dataset_of(p) if dataset is None else _c(dataset)
    pattern = F.concat(F.lit("^(?:"), regex_quote(F.concat(ds, F.lit("/"))), F.lit(")+"))
    rest = F.regexp_replace(p, pattern, F.lit(""))
    return F.when((rest == ds) | (rest == CONFIG_FILE), F.lit(None).cast("string")).otherwise(rest)


def is_config_object(path) -> Column:
    """The object name ends with the config file name (a plain suffix test)."""
    return _c(path).endswith(CONFIG_FILE)


def parse_paths(df, col: str = "object_name"):
    """F1/F2 on a DataFrame: adds ``dataset_name`` and ``partition_name``."""
    return (df.withColumn("dataset_name", dataset_of(col))
            .withColumn("partition_name", partition_of(col)))
