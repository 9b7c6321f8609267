"""Every registered query against its DuckDB oracle on the smallest tables,
and the driver's smoke entry."""

import os
import sys

import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import digest, duck  # noqa: E402

from shelfmark.plans.catalog import QUERIES as OWN  # noqa: E402

# the corpus operators have tests of their own in tests/llm
QUERIES = {k: v for k, v in E.queries().items() if k in OWN}
SQL = {k: v for k, v in E.oracle_sql().items() if k in OWN}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"dataset_id", "partition_id", "dataset_name", "manager_email"} <= set(df.columns)


def test_every_query_has_an_oracle():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = df.collect()
    cur = con.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]
