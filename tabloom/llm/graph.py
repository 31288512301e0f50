"""Connected components of an undirected graph that is only ever held as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabloom.session import durable


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(
        F.struct(F.col("child").alias("u"), F.col("parent").alias("v")),
        F.struct(F.col("parent").alias("u"), F.col("child").alias("v")))).alias("e")).select("e.u", "e.v")


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.where("child <> parent").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    least = durable(_both_ways(edges).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    linked = edges.join(least.withColumnRenamed("u", "parent"), "parent")
    return _distinct(linked.select("child", F.col("m").alias("parent")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = durable(edges.groupBy("child").agg(F.min("parent").alias("m")), "least")
    linked = edges.join(least, "child")
    return _distinct(linked.select(F.col("parent").alias("child"), F.col("m").alias("parent"))
                     .unionByName(least.select("child", F.col("m").alias("parent"))))


def _settled(edges: DataFrame) -> bool:
    """Whether every child has one parent that is no child itself: each component is a star then."""
    again = edges.groupBy("child").agg(F.count("*").alias("n")).where("n > 1")
    chained = edges.select("parent").join(edges.select("child"), F.col("parent") == F.col("child"), "left_semi")
    return again.isEmpty() and chained.isEmpty()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, root)`` of every node with an edge; the root is the smallest node of its component.

    Large-star and small-star steps in turn until every node hangs directly on
    its root. Each step is a minimum (summed up in each task first) and an
    equi-join of written tables, so adaptive execution can split a hub's rows;
    no adjacency list is ever built.
    """
    now = durable(_distinct(edges.select(
        F.greatest(left, right).alias("child"), F.least(left, right).alias("parent"))), "edges")
    while not _settled(now):
        now = durable(_small_star(durable(_large_star(now), "large-star")), "small-star")
    stars = now.select(F.col("child").alias("node"), F.col("parent").alias("root"))
    return stars.unionByName(now.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct())
