"""Hierarchies and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ancestors(edges: DataFrame, most: int = 32) -> DataFrame:
    """edges: child, parent. node, ancestor, depth over all ways up, at most so many steps; a join a step, until none leads on."""
    level = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    out = level
    for depth in range(2, most + 1):
        level = level.join(edges, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def descendants(edges: DataFrame, most: int = 32) -> DataFrame:
    return ancestors(edges, most).select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "depth")


def hops(seeds: DataFrame, edges: DataFrame, most: int = 2) -> DataFrame:
    """seeds: query_id, node; edges: a, b. query_id, node, hops: what is within so many steps, by the fewest."""
    seen = seeds.select("query_id", "node", F.lit(0).alias("hops"))
    front = seen
    for n in range(1, most + 1):
        step = front.join(edges, front["node"] == edges["a"]).select("query_id", F.col("b").alias("node")).distinct()
        front = step.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("hops", F.lit(n))
        seen = seen.unionByName(front)
    return seen
