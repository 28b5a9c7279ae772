"""Connected components of an edge table by alternating large and small stars.

Every round is two passes over the edges, each written to the shared folder;
the number of rounds grows with the logarithm of the longest path.  A node with
many edges is only ever a join key beside one row, which the runtime can split;
nothing gathers a neighbourhood.  Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.llm.tables import written


def _checksum(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least node around it."""
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    least = _least(both).select("a", F.least("a", "least").alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of a node, and the node, to the least of them."""
    least = _least(edges)
    others = edges.join(least, "a").filter("b <> least").select("b", "least")
    return least.union(others).toDF("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges ``a > b``; component: its least node."""
    edges = written(edges.select("a", "b").distinct())
    before = None
    while (now := _checksum(edges)) != before and now[0]:
        before = now
        edges = written(_small_star(written(_large_star(edges))))
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
