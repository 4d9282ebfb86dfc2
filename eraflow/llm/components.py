"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation to the least neighbour (combined before the shuffle)
and a join back. The least neighbours are stored first, so the join reads two plain
shuffles and a node with very many neighbours is split over tasks.

The steps go on until all edges form stars, which one aggregation by node tells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, stored


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least node of its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or a smaller and a larger one: the edges aren't stars yet."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up")).union(edges.select(F.col("b").alias("id"), F.lit(0).alias("up")))
    node = ends.groupBy("id").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return bool(node.agg(F.expr("bool_or(up > 1 or up = 1 and least = 0)")).first()[0])


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): the least node reachable.

    Null ends and loops are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    with releasing(spark) as keep_last:
        edges = stored(edges.where("a is not null and b is not null and a <> b").select("a", "b"), "edges")
        while True:
            with releasing(spark) as keep:
                edges = keep(stored(_small(stored(_large(edges), "large")), "small"))
            if not _unfinished(edges):
                break
        keep_last(edges)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
