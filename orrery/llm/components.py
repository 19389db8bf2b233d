"""Connected components of a graph given as edges, by alternating large-star and small-star rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import delete_tree, scratch_dir


def connected_components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge; edges has columns a and b of one orderable type.

    Each round rewrites edges so that they point to ever smaller nodes, until every edge is (node, component). Group minima are taken with
    partial sums before the shuffle; each round's edges are written, so lineage stays short. Rounds grow with the logarithm of the longest
    path; parts bounds each round's files. An empty edge table gives no rows; self-loops and repeated or null-ended edges are ignored."""
    spark = edges.sparkSession
    schema = None
    current = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    previous = None
    while True:
        path = scratch_dir(spark, "components")
        (current if parts is None else current.coalesce(parts)).write.parquet(path)
        schema = schema or current.schema
        written = spark.read.schema(schema).parquet(path)
        if previous is not None:
            delete_tree(spark, previous)
        previous = path
        # Done when no node is both a child and a parent, and each child has one parent.
        inner = written.join(written.select(F.col("b").alias("parent")).distinct(), F.col("a") == F.col("parent"), "left_semi").select("a")
        torn = written.groupBy("a").count().where("count > 1").select("a")
        if inner.union(torn).isEmpty():
            return written.select(F.col("a").alias("node"), F.col("b").alias("component")).union(written.select(F.col("b"), F.col("b")).distinct())
        current = _small_star(_large_star(written))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
