import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

from shelfmark.llm.common import prepare  # noqa: E402

SF = "/root/testdata/sf0.001"

#: Columns that documents may have besides their own, named like those the
#: operators use inside.
CLASHING = ["kept", "key", "node", "a", "n", "h", "doc", "t", "ws", "rule", "component", "band", "id", "path",
            "range", "score", "n_tokens", "dataset_id"]


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


def documents(spark, rows):
    """Documents from (doc_id, text) with clashing extra columns."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit("src1"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING})


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
EDGES = [(1, None), (2, ""), (3, " \n\t\x0b "), (4, "one"), (5, "one"), (6, "One two"), (7, "naïve 漢字 🙂 \x1c a\x85b"),
         (8, LONG), (9, LONG), (10, "x" * 30_000), (11, "same row"), (11, "same row"), (None, "no id at all"), (None, None)]
