"""Connected components of a graph given as edges, by alternating large-star and small-star steps. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _stage


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour that is larger than a node is linked to the node's smallest neighbour (or to the node)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every neighbour that is smaller than a node, and the node, are linked to its smallest neighbour. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of edges (a, b) can reach. Nodes without an edge to another are left out.

    a and b are of one orderable type; null ends and loops are dropped, repeated edges count once. Rows with a hot node are
    pre-aggregated to its smallest neighbour, and meet it in a plain equi-join, which adaptive execution splits. Each round is
    written to the shared folder; the driver sees a count and a sum for each.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    # Tables, not checkpoints, between rounds: a checkpoint keeps its plan's size estimate, which multiplies with every join.
    e, before = _stage.stored(e, "edges"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before, last = now, e
        e = _stage.stored(_small(_large(e)), "edges")
        _stage.drop(last)
