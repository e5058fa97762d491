"""What a plan did (A7, A8, M18): counts taken along the way, and checks of the physical plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """df, and the rows it will have had once an action has run: no pass of its own."""
    seen = Observation(stage)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> dict[str, int]:
    """How often exchanges, joins and Python are in a plan."""
    text = physical(df)
    names = ("Exchange", "BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "ArrowEvalPython", "MapInPandas", "MapInArrow", "Window", "Sort")
    return {n: text.count(n) for n in names if n in text}
