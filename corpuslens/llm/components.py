"""Connected components of a large graph by alternating star contraction, on edge tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to its smallest neighbour (itself included)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours and itself to the smallest of them. Edges are (a, b) with a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    moved = joined.filter("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
    return moved.union(least.select(F.col("m").alias("x"), F.col("b").alias("y"))).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each larger end has one edge and is no smaller end: then every edge leads to its component's smallest node."""
    n, ends = edges.agg(F.count("*"), F.count_distinct("b")).first()
    return n == ends and not edges.select(F.col("a").alias("x")).join(edges.select(F.col("b").alias("x")), "x", "left_semi").limit(1).count()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b), a < b, a stored table, to a table (node, root) of every node that has an edge; root is the component's smallest node.

    Alternates the two star operations until what is left are stars around their smallest nodes. A node's neighbours
    are only aggregated and joined, never gathered. Each round is a table in the shared folder.
    """
    now, own = edges.select("a", "b"), False
    while not _is_star_forest(now):
        new = scratch.table(_small_star(_large_star(now)))
        if own:
            scratch.drop(now)
        now, own = new, True
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
