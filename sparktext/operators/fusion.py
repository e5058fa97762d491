"""Fusion of result lists (F1-F9, J12). runs: engine, query_id, doc_id, score (and rank, where ranks count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LIST = ["engine", "query_id"]


def _weight(weights: dict[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.create_map(*(F.lit(x) for e, w in weights.items() for x in (e, float(w))))[F.col("engine")], F.lit(1.0))


def ranked(runs: DataFrame) -> DataFrame:
    return runs.withColumn("rank", F.row_number().over(Window.partitionBy(*_LIST).orderBy(F.desc("score"), "doc_id")))


def reciprocal_rank(runs: DataFrame, k: float = 60.0, weights: dict[str, float] | None = None) -> DataFrame:
    """Sum of weight / (k + best rank) (F1)."""
    best = (runs if "rank" in runs.columns else ranked(runs)).groupBy("engine", "query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return best.groupBy("query_id", "doc_id").agg(F.sum(_weight(weights) / (k + F.col("rank"))).alias("score"))


def _finite(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))


def normalized(runs: DataFrame, how: str = "max") -> DataFrame:
    """Scores of each list by its largest, by least to largest, by its sum, or as they are (F5); positive, finite scores count."""
    w, s = Window.partitionBy(*_LIST), F.col("score")
    good = F.when(_finite(s) & (s > 0), s)
    most, least, total = F.max(good).over(w), F.min(good).over(w), F.sum(good).over(w)
    value = {
        "none": s, "max": s / most, "sum": s / total,
        "minmax": F.when(most == least, s / most).otherwise((s - least) / (most - least)),
    }[how]
    return runs.where(_finite(s)).withColumn("normal", value)


def weighted(runs: DataFrame, how: str = "max", weights: dict[str, float] | None = None) -> DataFrame:
    """Sum of weighted, normalised scores; what is not positive goes (F2)."""
    return normalized(runs, how).groupBy("query_id", "doc_id").agg(F.sum(_weight(weights) * F.col("normal")).alias("score")).where("score > 0")


def comb_sum(runs: DataFrame) -> DataFrame:
    return runs.where(_finite(F.col("score")) & (F.col("score") > 0)).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def comb_mnz(runs: DataFrame) -> DataFrame:
    """The sum, times how many lists have the document."""
    return runs.where(_finite(F.col("score")) & (F.col("score") > 0)).groupBy("query_id", "doc_id").agg((F.sum("score") * F.count("*")).alias("score"))


def bayesian(runs: DataFrame, engines: int | None = None) -> DataFrame:
    """runs: score is a probability. Product of odds, as a probability; a list without the document has odds of 1."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("score")))
    return runs.groupBy("query_id", "doc_id").agg((1 / (1 + F.exp(-F.sum(F.log(p) - F.log(1 - p))))).alias("score"))


def contributions(runs: DataFrame, how: str = "max", weights: dict[str, float] | None = None) -> DataFrame:
    """What each list adds to a document's fused score, and the scale it was brought to."""
    w = Window.partitionBy(*_LIST)
    return normalized(runs, how).select(*_LIST, "doc_id", "score", "normal", _weight(weights).alias("weight"), (_weight(weights) * F.col("normal")).alias("contribution"), F.max("score").over(w).alias("scale"))


def pool(runs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """The part of each list that a hybrid search fuses: offset + max(limit, 50) results (F8)."""
    return ranked(runs).where(F.col("rank") <= offset + max(limit, 50))
