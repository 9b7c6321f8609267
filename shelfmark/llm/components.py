"""Connected components of links between long ids, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least_parent(edges: DataFrame) -> DataFrame:
    """Every node and the least of itself and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # partial minima before the shuffle: a hot node sends one row a task
    return both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("x"), F.least("u", "m").alias("p"))


def _compressed(parent: DataFrame) -> DataFrame:
    """Pointer jumping until every node points at a root."""
    parent = stored(parent, "parents")
    while True:
        up = parent.select(F.col("x").alias("px"), F.col("p").alias("pp"))
        jumped = stored(parent.join(up, F.col("p") == F.col("px"), "left")
                        .select("x", F.coalesce("pp", "p").alias("p"), (F.col("pp") != F.col("p")).alias("moved")),
                        "parents")
        parent = jumped.select("x", "p")
        if not jumped.where("moved").limit(1).count():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(node, component: the least node it reaches) of all linked nodes.

    Each round hooks every node to its least neighbour, flattens the trees
    by pointer jumping and contracts the edges; rounds and jumps are few
    (logarithmic), and a star takes one. Tables between rounds are written,
    so that a lost executor costs no lineage and both sides of each join are
    plain scans whose hot keys Spark can split.
    """
    edges = edges.select("u", "v").where("u != v")
    label = None
    while True:
        parent = _compressed(_least_parent(edges))
        if label is None:
            label = parent.select(F.col("x").alias("node"), F.col("p").alias("component"))
        else:
            label = stored(label.join(parent, F.col("component") == F.col("x"), "left")
                           .select("node", F.coalesce("p", "component").alias("component")), "labels")
        a = parent.select(F.col("x").alias("u"), F.col("p").alias("pu"))
        b = parent.select(F.col("x").alias("v"), F.col("p").alias("pv"))
        edges = stored(edges.join(a, "u").join(b, "v").where("pu != pv")
                       .select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "edges")
        if not edges.limit(1).count():
            return label
