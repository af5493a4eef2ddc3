"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stay_analytics.session import written_once

#: Edges that one task writes, about: a few thousand edges shouldn't be dealt over all partitions of the session in every round.
EDGES_PER_TASK = 1 << 16


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (two columns of longs): root is the smallest node of its component.

    Every round replaces the edges of a node by edges to its smallest
    neighbour; rounds grow with the logarithm of the longest path. Edges are
    written to the checkpoint folder after each round. Self-loops and repeated
    edges do no harm; a node with only a self-loop is left out.
    """
    a, b = edges.columns
    edge = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    edge, before = written_once(edge), None
    while True:
        now = edge.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edge.union(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edge = written_once(small.union(least).distinct().coalesce(-(-now[0] // EDGES_PER_TASK)))
    return edge.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edge.select(F.col("b"), F.col("b")).distinct())
