"""Retrieval and classification measures, comparison and tuning.

runs: config, query_id, doc_id, score or rank; qrels: query_id, doc_id, grade.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import TextIndex
from .scoring import Scorer, best, bm25, bm25_l, bm25_plus

_KEYS = ["config", "query_id"]


def _log2(x: Column) -> Column:
    return F.log(x) / math.log(2)


def _gain(grade: Column, linear: bool) -> Column:
    return grade if linear else F.pow(F.lit(2.0), grade) - 1


def measures(runs: DataFrame, qrels: DataFrame, k: int = 10, linear: bool = False) -> DataFrame:
    """config, query_id, precision, recall, f1, rr, ap, ndcg_binary, ndcg at k (M1-M5), for each judged query of each config that ran.

    Of a document retrieved twice the first place counts, and places close up. Precision divides by k, average precision by
    all relevant documents. Documents of grade 0 or less aren't relevant.
    """
    first = runs.groupBy(*_KEYS, "doc_id").agg(F.min("rank").alias("rank"))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy(*_KEYS).orderBy("rank", "doc_id"))).where(F.col("rank") <= k)
    relevant = qrels.where("grade > 0").groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))
    hits = first.join(relevant, ["query_id", "doc_id"], "left")
    is_hit = F.col("grade").isNotNull()
    order = Window.partitionBy(*_KEYS).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.sum(is_hit.cast("int")).over(order)
    per = hits.withColumn("so_far", so_far).groupBy(*_KEYS).agg(
        F.count_if(is_hit).alias("found"), F.min(F.when(is_hit, F.col("rank"))).alias("first"), F.sum(F.when(is_hit, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        F.sum(F.when(is_hit, 1 / _log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg_binary"), F.sum(F.when(is_hit, _gain(F.col("grade"), linear) / _log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    # only the best k places of a query are sorted; how many there are is counted
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))
    first_k = relevant.select("query_id", "grade").withColumn("place", place).where(F.col("place") <= k)
    ideal = first_k.groupBy("query_id").agg(F.sum(1 / _log2(F.col("place") + 1)).alias("ideal_binary"), F.sum(_gain(F.col("grade"), linear) / _log2(F.col("place") + 1)).alias("ideal"))
    ideal = ideal.join(relevant.groupBy("query_id").agg(F.count("*").alias("relevant")), "query_id")
    p, r = F.col("found") / k, F.col("found") / F.col("relevant")
    out = per.join(ideal, "query_id")
    return out.select(
        *_KEYS, p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        (F.col("ap_sum") / F.col("relevant")).alias("ap"), (F.col("dcg_binary") / F.col("ideal_binary")).alias("ndcg_binary"), (F.col("dcg") / F.col("ideal")).alias("ndcg"),
    )


def summary(measured: DataFrame) -> DataFrame:
    """Means by config (M7, M8)."""
    names = [c for c in measured.columns if c not in _KEYS]
    return measured.groupBy("config").agg(F.count("*").alias("queries"), *(F.avg(n).alias(n) for n in names))


def tie_aware_ndcg(runs: DataFrame, qrels: DataFrame, k: int = 10, linear: bool = False) -> DataFrame:
    """config, query_id, expected, least, most: nDCG at k over all orders of documents of equal score (M6).

    In a class of equals over places a..b, each place holds the class's mean gain in expectation; the largest gains come
    first at best, last at worst.
    """
    relevant = qrels.where("grade > 0").groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))
    graded = runs.join(relevant, ["query_id", "doc_id"], "left").withColumn("gain", F.when(F.col("grade").isNull(), 0.0).otherwise(_gain(F.col("grade"), linear)))
    best = Window.partitionBy(*_KEYS).orderBy(F.desc("score"), F.desc("gain"))
    worst = Window.partitionBy(*_KEYS).orderBy(F.desc("score"), "gain")
    mean = F.avg("gain").over(Window.partitionBy(*_KEYS, "score"))
    placed = graded.withColumn("mean", mean).withColumn("up", F.row_number().over(best)).withColumn("down", F.row_number().over(worst))

    def dcg(value: str, place: str) -> Column:
        return F.sum(F.when(F.col(place) <= k, F.col(value) / _log2(F.col(place) + 1)).otherwise(0.0))

    per = placed.groupBy(*_KEYS).agg(dcg("mean", "up").alias("e"), dcg("gain", "down").alias("l"), dcg("gain", "up").alias("m"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))
    ideal = relevant.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.sum(_gain(F.col("grade"), linear) / _log2(F.col("place") + 1)).alias("ideal"))
    return per.join(ideal, "query_id").select(*_KEYS, *((F.col(x) / F.col("ideal")).alias(n) for x, n in (("e", "expected"), ("l", "least"), ("m", "most"))))


def compare(measured: DataFrame, baseline: str, candidate: str, metric: str = "ndcg", epsilon: float = 1e-9) -> DataFrame:
    """query_id, baseline, candidate, delta, verdict (M9): a query missing on one side counts 0 there."""
    a = measured.where(F.col("config") == baseline).select("query_id", F.col(metric).alias("baseline"))
    b = measured.where(F.col("config") == candidate).select("query_id", F.col(metric).alias("candidate"))
    both = a.join(b, "query_id", "full_outer").select("query_id", F.coalesce("baseline", F.lit(0.0)).alias("baseline"), F.coalesce("candidate", F.lit(0.0)).alias("candidate"))
    delta = F.col("candidate") - F.col("baseline")
    return both.withColumn("delta", delta).withColumn("verdict", F.when(delta > epsilon, "improved").when(delta < -epsilon, "degraded").otherwise("unchanged"))


def golden(runs: DataFrame, old: DataFrame, tolerance: float = 5e-5) -> DataFrame:
    """Both: query_id, doc_id, score, rank. match, tie_reordered or changed for each query."""
    both = runs.select("query_id", "doc_id", F.col("score").alias("new"), F.col("rank").alias("rank")).join(old.select("query_id", "doc_id", F.col("score").alias("was"), F.col("rank").alias("before")), ["query_id", "doc_id"], "full_outer")
    moved = ~F.col("rank").eqNullSafe(F.col("before"))
    other = F.col("new").isNull() | F.col("was").isNull() | (F.abs(F.col("new") - F.col("was")) > tolerance)
    # places that changed hands are a matter of ties if the lists' scores agree place by place
    by_place = runs.select("query_id", "rank", F.col("score").alias("s")).join(old.select("query_id", "rank", F.col("score").alias("t")), ["query_id", "rank"], "full_outer").groupBy("query_id").agg(F.max(F.coalesce((F.abs(F.col("s") - F.col("t")) > tolerance).cast("int"), F.lit(1))).alias("shifted"))
    out = both.groupBy("query_id").agg(F.max(moved.cast("int")).alias("moved"), F.max(other.cast("int")).alias("other")).join(by_place, "query_id")
    return out.select("query_id", F.when((F.col("moved") == 0) & (F.col("other") == 0), "match").when((F.col("shifted") == 0), "tie_reordered").otherwise("changed").alias("verdict"))


def tune_bm25(index: TextIndex, queries: DataFrame, qrels: DataFrame, k1: list[float], b: list[float], k: int = 10, kind: str = "bm25", delta: list[float] = (0.0,)) -> DataFrame:
    """config, k1, b, delta and mean measures of every point of the grid (M12, M13); kind: bm25, plus or l.

    Documents are scored at all points of the grid at once, which is as wide as it is stated.
    """
    make = {"bm25": lambda x, y, z: bm25(x, y), "plus": bm25_plus, "l": bm25_l}[kind]
    return tune_scorers(index, queries, {f"k1={x} b={y} d={z}": make(float(x), float(y), float(z)) for x, y, z in product(k1, b, delta)}, qrels, k)


def tune_scorers(index: TextIndex, queries: DataFrame, scorers: dict[str, Scorer], qrels: DataFrame, k: int = 10) -> DataFrame:
    """Mean measures of each scorer."""
    return summary(measures(best(index, queries, scorers, k), qrels, k))


def bootstrap(differences: DataFrame, rounds: int = 1000, low: float = 0.025, high: float = 0.975, seed: int = 7) -> DataFrame:
    """differences: query_id, delta. mean and percentile interval over resampled queries.

    Each query is drawn a Poisson(1) number of times in each round, by a hash of query and round: no sample is gathered.
    """
    u = F.pmod(F.xxhash64("query_id", "round", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    cumulative, total = [], 0.0
    for i in range(8):
        total += math.exp(-1) / math.factorial(i)
        cumulative.append(total)
    times = sum(((u >= x).cast("int") for x in cumulative), F.lit(0))
    drawn = differences.select("query_id", "delta", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("times", times)
    means = drawn.groupBy("round").agg((F.sum(F.col("times") * F.col("delta")) / F.greatest(F.sum("times"), F.lit(1))).alias("mean"))
    return means.agg(F.avg("mean").alias("mean"), F.percentile("mean", F.lit(low)).alias("low"), F.percentile("mean", F.lit(high)).alias("high"))


def adjusted(p_values: list[float], method: str = "holm") -> list[float]:
    """Holm's step-down, or Benjamini and Hochberg's step-up, adjustment."""
    n, order = len(p_values), sorted(range(len(p_values)), key=p_values.__getitem__)
    out = [0.0] * n
    if method == "holm":
        worst = 0.0
        for k, i in enumerate(order):
            worst = max(worst, min(1.0, (n - k) * p_values[i]))
            out[i] = worst
    else:
        best = 1.0
        for k in range(n - 1, -1, -1):
            best = min(best, p_values[order[k]] * n / (k + 1))
            out[order[k]] = best
    return out


def mcnemar(baseline_only: int, candidate_only: int) -> float:
    """Exact two-sided p value of discordant pairs."""
    n, least = baseline_only + candidate_only, min(baseline_only, candidate_only)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(least + 1)) / 2**n)


def confusion(predicted: DataFrame) -> DataFrame:
    """predicted: actual, predicted."""
    return predicted.groupBy("actual", "predicted").agg(F.count("*").alias("count"))


def classification(predicted: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support; accuracy and macro F1 follow from these."""
    pair = F.explode(F.array(F.struct(F.col("actual").alias("label"), F.lit(1).alias("is"), F.lit(0).alias("said"), (F.col("actual") == F.col("predicted")).cast("int").alias("hit")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("is"), F.lit(1).alias("said"), F.lit(0).alias("hit"))))
    per = predicted.select(pair.alias("x")).select("x.*").where("label IS NOT NULL").groupBy("label").agg(F.sum("is").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    p, r = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0), F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    return per.select("label", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "support")


def coverage(predicted: DataFrame, steps: int = 10) -> DataFrame:
    """predicted: actual, predicted, confidence. Accuracy among the rows of at least each confidence."""
    levels = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i / steps))
    return predicted.select("*", levels.alias("level")).where("confidence >= level").groupBy("level").agg(F.count("*").alias("covered"), F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"))


def held_out(key: Column, fraction: float, buckets: int = 1000) -> Column:
    """Whether a row is held out, by a hash of its key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(buckets)) < round(fraction * buckets)


def analysis_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: doc_id, term, tf of two tokenizers. Terms of a document that one makes and the other doesn't, or not as often."""
    both = a.withColumnRenamed("tf", "before").join(b.withColumnRenamed("tf", "after"), ["doc_id", "term"], "full_outer")
    return both.where("coalesce(before, 0) <> coalesce(after, 0)").select("doc_id", "term", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def tie_summary(tie_aware: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """config, queries, those whose order within ties matters, and the mean and widest range."""
    width = F.col("most") - F.col("least")
    return tie_aware.groupBy("config").agg(F.count("*").alias("queries"), F.count_if(width > epsilon).alias("undecided"), F.avg(width).alias("mean_range"), F.max(width).alias("widest"))


def tune(configs: dict[str, DataFrame], qrels: DataFrame, k: int = 10) -> DataFrame:
    """configs: name and scores (query_id, doc_id, score) of any scorers, BM25-VA or BM25F of a grid for instance (M13). Mean measures of each, best nDCG first."""
    runs = None
    for name, scored in configs.items():
        rows = scored.select(F.lit(name).alias("config"), "query_id", "doc_id", F.round("score", 6).alias("score"))
        runs = rows if runs is None else runs.unionByName(rows)
    ranked = runs.withColumn("rank", F.row_number().over(Window.partitionBy(*_KEYS).orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    return summary(measures(ranked, qrels, k))
