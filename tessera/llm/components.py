"""Connected components by alternating large-star and small-star steps, each an aggregation and a join on edges.

Edges shrink to stars around the smallest node of each component in about log(n) rounds; nothing is collected, and each
round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of a node joins the smallest around it. Small: every smaller one, and the node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else both.where("b < a")
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = around.join(least, "a")
    moved = (joined.where("b > a") if large else joined).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root) of every node on an edge, root the smallest node of its component. Loops and repeats are allowed."""
    edges = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        large = cut(_star(edges, True), "edges")
        after_both = cut(_star(large, False), "edges")
        discard(edges, large)
        edges = after_both
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
