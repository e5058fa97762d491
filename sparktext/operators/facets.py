"""Facets over all matches, and agreement of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def categorical(matched: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, count: one pass for all fields; absent values aren't counted."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    return matched.select(each.alias("x")).select("x.*").where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count("*").alias("count"))


def ranges(matched: DataFrame, field: str, boundaries: list[float]) -> DataFrame:
    """bucket, low, high, count of [low, high) between ascending boundaries; empty buckets, too. Values outside, or that are no numbers, aren't counted."""
    if any(b <= a for a, b in zip(boundaries, boundaries[1:])) or len(boundaries) < 2:
        raise ValueError("boundaries must rise")
    v = F.col(field).cast("double")
    counts = matched.agg(*(F.count_if((v >= a) & (v < b)).alias(f"b{i}") for i, (a, b) in enumerate(zip(boundaries, boundaries[1:]))))
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("bucket"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"), F.col(f"b{i}").alias("count")) for i, (a, b) in enumerate(zip(boundaries, boundaries[1:])))))
    return counts.select(rows.alias("x")).select("x.*")


def histogram(matched: DataFrame, field: str, buckets: int = 10) -> DataFrame:
    """bucket, low, high, count: equal widths from the least to the largest value, which is in the last; one bucket if they are equal."""
    values = matched.select(F.col(field).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    ends = values.agg(F.min("v").alias("least"), F.max("v").alias("most"))
    width = (F.col("most") - F.col("least")) / buckets
    place = F.when(F.col("most") == F.col("least"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("least")) / width), F.lit(buckets - 1))).cast("int")
    counted = values.crossJoin(F.broadcast(ends)).groupBy(place.alias("bucket"), "least", "most").agg(F.count("*").alias("count"))  # one row
    low = F.col("least") + F.col("bucket") * width
    high = F.when(F.col("most") == F.col("least"), F.col("most")).otherwise(low + width)
    return counted.select("bucket", low.alias("low"), high.alias("high"), "count")


def unparseable(matched: DataFrame, field: str) -> DataFrame:
    """How many values are there but are no numbers, thousands' commas aside (A4)."""
    v = F.col(field).cast("string")
    return matched.agg(F.count_if(v.isNotNull() & F.regexp_replace(F.trim(v), ",", "").try_cast("double").isNull()).alias("unparseable"))


def agreement(runs: DataFrame, strong: float = 0.5) -> DataFrame:
    """runs: source, query_id, doc_id, score. How far sources agree on each result (A5): a source's vote is strong if its score is at least that share of its best."""
    best = F.max("score").over(Window.partitionBy("source", "query_id"))
    strength = F.when(best > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / best))).otherwise(0.0)
    total = runs.groupBy("query_id").agg(F.countDistinct("source").alias("sources"))
    out = runs.withColumn("strength", strength).groupBy("query_id", "doc_id").agg(F.count("*").alias("found"), F.count_if(F.col("strength") >= strong).alias("strong")).join(total, "query_id")
    verdict = (
        F.when(F.col("found") == 1, "single_source").when(F.col("strong") == 0, "lukewarm").when((F.col("strong") == F.col("found")) & (F.col("found") == F.col("sources")), "unanimous").otherwise("disputed")
    )
    return out.withColumn("verdict", verdict)


def agreement_summary(judged: DataFrame) -> DataFrame:
    return judged.groupBy("verdict").agg(F.count("*").alias("count"))


def stage_metrics(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Calls, total, least and largest value by engine and stage."""
    return events.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
