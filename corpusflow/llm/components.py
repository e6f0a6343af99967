"""Connected components of a graph of any size, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for each node of an edge.

    edges has columns a and b of one ordered type. Each round links the
    neighbours of a node to the least of them: first those above it, then those
    below. The number of edges never grows; rounds grow with the logarithm of
    the longest path. Loops (a = b) are left out.
    """
    current = staged(_oriented(edges.select("a", "b")), "edges")
    while not _stars(current):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = _oriented(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        middle = staged(large, "edges")
        least = middle.groupBy("a").agg(F.min("b").alias("m"))
        small = middle.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        following = staged(_oriented(small), "edges")
        drop_staged(current)
        drop_staged(middle)
        current = following
    ends = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(ends.select("component", "component")).groupBy("node").agg(F.min("component").alias("component"))


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node is either linked to one smaller node or the smallest."""
    nodes = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    counts = nodes.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    return counts.where("ups > 1 OR ups = 1 AND n > 1").agg(F.count("*")).first()[0] == 0
