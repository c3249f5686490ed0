"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobi.llm.common import saved


def _distinct(df: DataFrame) -> DataFrame:
    return df.where("u != v").groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Every neighbour larger than a node moves to the node's smallest one."""
    return (_both(edges).join(low.select("u", "m"), "u").where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, move to the smallest one."""
    low = saved(edges.groupBy("u").agg(F.min("v").alias("m")), "stars")
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _distinct(moved.unionAll(low.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of each node of ``edges`` (u, v: long), a written table;
    the component is its smallest node.  The rounds grow with the logarithm of the
    longest path.  They end with stars around smallest nodes: no node with a smaller
    neighbour has another one, and of this the driver sees one row at most."""
    now = saved(_distinct(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), name)
    while True:
        # written first: the join then reads two plain shuffles, and Spark splits a
        # node with very many neighbours
        low = saved(_both(now).groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")), "stars")
        if low.where("m < u and m < most").isEmpty():
            return low.select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
        now = saved(_small_star(_large_star(now, low)), name)
