"""Comparison within groups, hot ones split, and components of the links that come of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim, written


def within_groups(members: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame | None], pd.DataFrame], schema: str, block: int = 512) -> DataFrame:
    """compare() sees all pairs of members (key, id, ...) of a group, once or, in several groups, more often.

    A group of more than about block members is split by a hash of their ids; each pair of its blocks is a task of its
    own, so that no task holds more than two blocks. compare(a, None) is about the pairs within a block, compare(a, b)
    about those between two.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    split = members.join(sizes, "key").withColumn("blocks", F.ceil(F.col("size") / block)).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
    tasks = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tasks = tasks.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("size", "blocks", "other")

    def groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for frame in frames:
            marks = frame[["key", "i", "j"]].to_numpy()
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1), len(frame)]
            for a, b in zip(cuts, cuts[1:]):
                if kept and not (kept[-1][["key", "i", "j"]].to_numpy()[-1] == marks[a]).all():
                    yield pd.concat(kept)
                    kept = []
                kept.append(frame.iloc[a:b])
        if kept:
            yield pd.concat(kept)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            for g in groups(f for f in frames if len(f)):
                i, j = g["i"].iloc[0], g["j"].iloc[0]
                out = compare(g, None) if i == j else compare(g[g["mine"] == i], g[g["mine"] == j])
                if len(out):
                    yield out
        finally:
            trim()

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated: rows are few, but each stands for many comparisons
    return tasks.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id").mapInPandas(run, schema)


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id that can be reached) for the ends of links (a, b).

    Alternating large and small stars: in each round, every node's larger, then smaller, neighbours are hung on the least
    of its neighbours. Only sums and minima are gathered by node, so that a hub is no burden. The rounds, few even for long
    chains, end when the links don't change.
    """
    links = links.where("a <> b")
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(down.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = written(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.groupBy("id").agg(F.min("component").alias("component")).unionByName(ends.select(F.col("component").alias("id"), "component").distinct()).groupBy("id").agg(F.min("component").alias("component"))
