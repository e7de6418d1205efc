"""Connected components by contraction: every node moves to its smallest neighbour, edges follow, until none is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b): component is the smallest node that they reach.

    A component's smallest node never moves, so it names the component when no edge is left; each
    round at least halves the nodes of a component that still moves.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    placed = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
        if placed is None:
            placed = moves
        else:
            step = moves.select(F.col("node").alias("component"), F.col("component").alias("next"))
            placed = written(placed.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")))
        to = moves.select(F.col("node").alias("a"), F.col("component").alias("x"))
        moved = edges.join(to, "a").join(to.select(F.col("a").alias("b"), F.col("x").alias("y")), "b")
        edges = written(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if edges.isEmpty():
            return placed
