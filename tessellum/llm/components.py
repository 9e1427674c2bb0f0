"""Distributed union-find: connected components by alternating large-star and small-star rounds.

A round needs two grouped minima (combined before the shuffle) and two joins on the same keys, which Spark
can split where a hub has many edges; no group is ever gathered. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut


def _linked(edges: DataFrame) -> DataFrame:
    """Edges as (hi, lo), without loops and repeats."""
    return edges.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), F.least("u", "m").alias("m"))
    return both.join(least, both.u == least.u2).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "hi2")
    joined = edges.join(least, edges.hi == least.hi2)
    return joined.select("hi", F.col("m").alias("lo")).unionByName(joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")))


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): every node that has an edge to another one, with the least node of its component.

    Edges may repeat, point either way or be loops; edges with a null end are ignored. Nodes without an edge
    are not listed: a left join gives them themselves. An empty edge table gives an empty result.
    """
    now = Cut(_linked(edges.select(F.col(left).alias("hi"), F.col(right).alias("lo")).dropna()), "edges")
    while True:
        ends = now.df.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            now.df.select(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        unfinished = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
        if unfinished.isEmpty():
            break
        after = Cut(_linked(_small_star(_linked(_large_star(now.df)))), "edges")
        now.drop()
        now = after
    members = now.df.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return members.unionByName(now.df.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
