"""Connected components of a link table by alternating star contraction.

A large star links every greater neighbour of a node to the node's least
neighbour; a small star does the same with the lesser ones. Both keep
components as they are and end in one star per component. Groups are met by
partial aggregation and joins that Spark may split, never in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    onward = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return onward.union(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link, to a node without any: then each component is a star."""
    upper = edges.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    return upper.join(edges.select(F.col("b").alias("a"), F.lit(2).alias("r")).distinct(), "a", "left").filter(
        "c > 1 or r = 2").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges(a, b)``; the component is its least node.

    Self links, repeated links and either direction are allowed; an empty
    table gives an empty one. Nodes without links are not listed.
    """
    edges = settle(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(),
        "edges")
    while not _settled(edges):
        edges = settle(_small_star(_large_star(edges)), "stars")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
