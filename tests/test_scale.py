"""Searches of many queries over many rows: in blocks, with the rows that pairs of rows would give."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktext.functions.words import Tokenizer
from sparktext.operators import expand, rerank, scoring, vectors
from sparktext.operators.index import TextIndex
from sparktext.plans import catalog


def test_more_query_vectors_than_one_batch(spark):
    """(F16-F21) Before, more than 10,000 query vectors were an error, and a join of pairs."""
    n = 10_001
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0, None]), (6, [0.0, 0.0]), (7, [1.0])], "id long, v array<float>")
    q = spark.range(n).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id") % 2 * 3.0).alias("q"))
    found = vectors.dense(v, q, 2, digits=6).groupBy(F.col("query_id") % 2, "rank").agg(F.min("id"), F.max("id"), F.count("*")).collect()
    assert sorted(map(tuple, found)) == [(0, 1, 1, 1, n // 2 + 1), (0, 2, 3, 3, n // 2 + 1), (1, 1, 2, 2, n // 2), (1, 2, 3, 3, n // 2)]


@pytest.mark.parametrize("metric", ["cosine", "inner", "l2"])
def test_dense_ranks_rounded_scores(spark, metric):
    """Scores that are equal as they are shown go by id, as in SQL; the tenth place is not left to what is rounded away."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=4)
    near = [(i, [float(x) for x in base + rng.normal(size=4) * 1e-9]) for i in range(40)] + [(100 + i, [float(x) for x in rng.normal(size=4)]) for i in range(3000)]
    v = spark.createDataFrame(near, "id long, v array<double>")
    q = spark.createDataFrame([(0, [float(x) for x in base])], "query_id long, q array<double>")
    found = [(r.id, r.score) for r in vectors.dense(v, q, 10, metric, digits=6).orderBy("rank").collect()]

    def score(a):
        a = np.array(a)
        return {"cosine": a @ base / np.linalg.norm(a) / np.linalg.norm(base), "inner": a @ base, "l2": 1 / (1 + np.linalg.norm(a - base))}[metric]

    want = sorted(((i, round(float(score(a)), 6)) for i, a in near), key=lambda x: (-x[1], x[0]))[:10]
    assert [i for i, _ in found] == [i for i, _ in want] and np.allclose([s for _, s in found], [s for _, s in want])


SCORERS = {
    "bm25": scoring.bm25(), "aggressive": scoring.bm25(*scoring.BM25_PRESETS["aggressive"]), "no constant": scoring.bm25(saturation_constant=False), "single": scoring.bm25(single_precision=True), "plus": scoring.bm25_plus(), "l": scoring.bm25_l(),
    "va": scoring.bm25_va(), "tfidf": scoring.tf_idf(), "both": scoring.combined([(scoring.bm25(), 0.7), (scoring.tf_idf(), 0.3), (scoring.bm25_l(), 0.0)]),
}


@pytest.mark.parametrize("name", SCORERS)
@pytest.mark.parametrize("weighting", [False, True])
def test_best_is_the_page_of_scores(spark, monkeypatch, name, weighting):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(60)] + ["été", "Straße"])
    texts = [(f"d{i}", " ".join(words[rng.zipf(1.4, rng.integers(0, 40)) % len(words)])) for i in range(300)] + [("e1", None), ("e2", ""), ("e3", "nothing known")]
    index = TextIndex(spark.createDataFrame(texts, "doc_id string, text string").repartition(3))
    queries = spark.createDataFrame([("d7", "w1 w2 w2 w9 ete"), ("q2", "w3 w30 w30 missing"), ("q3", "unknown"), ("q4", " ".join(words))], "query_id string, text string")
    monkeypatch.setattr(scoring.blocks, "CELLS", 100)  # several blocks
    monkeypatch.setattr(scoring, "MOST_QUERY_TERMS", 20)  # several batches of queries
    want = scoring.page(scoring.score(index, queries, SCORERS[name], weighting).where("query_id <> doc_id"), 7, digits=6).select("query_id", "rank", "doc_id", "score").collect()
    found = scoring.best(index, queries, {name: SCORERS[name]}, 7, query_weighting=weighting, others=True).select("query_id", "rank", "doc_id", "score").collect()
    assert len(want) == 21 and sorted(map(tuple, found)) == sorted(map(tuple, want))


def test_shared_terms(spark):
    index = TextIndex(spark.createDataFrame([(1, "a1 b2 b2"), (2, "b2 c3 d4"), (3, None), (4, "x9")], "doc_id long, text string"))
    terms = spark.createDataFrame([(7, "a1"), (7, "b2"), (7, "b2"), (8, "c3"), (8, "d4"), (9, "q0")], "query_id long, term string")
    assert sorted(map(tuple, scoring.shared(index, terms).collect())) == [(7, 1, 2), (7, 2, 1), (8, 2, 2)]
    assert sorted(map(tuple, scoring.shared(index, terms, 2).collect())) == [(7, 1, 2), (8, 2, 2)]


@pytest.mark.parametrize("name", ["golden_baseline", "source_agreement", "tune_bm25", "tune_bm25_va", "tie_summary", "weighted_composite", "weighted_minmax"])
def test_postings_are_not_shuffled(spark, sf_dir, name):
    """(F2, F4-F7, F14, F15, F22-F35) Before, each term of a document was a row of an exchange, once for each query that has it."""
    tracker = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = {s.stageId() for s in _stages(tracker)}
    assert catalog.QUERIES[name](spark, sf_dir).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert max(s.shuffleWriteRecords() for s in _stages(tracker) if s.stageId() not in seen) < 6_000  # 9,252 or more before


def _stages(tracker):
    found = tracker.stageList(None, False, False, getattr(tracker, "stageList$default$4")(), getattr(tracker, "stageList$default$5")())
    return [found.apply(i) for i in range(found.size())]


@pytest.mark.parametrize("name", ["trigram_search", "bm25_f", "bm25_f_scoped", "scoped_search"])
def test_documents_are_not_broadcast(spark, sf_dir, name):
    """(F11-F13) Before, a file of few distinct words passed for the smaller side of a join, and all its terms went through the driver."""
    lines = str(catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan()).split("\n")
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            source = next(x for x in lines[i + 1 :] if "Aggregate(" in x or "Scan" in x)
            assert "keys=[doc_id" not in source and "part.parquet" not in source, source


def test_max_sim_over_all_documents(spark):
    """Before, each query vector met each vector in a row of its own; the pairs of documents to compare had to be rows, too."""
    rng = np.random.default_rng(9)
    rows = [(i, f"d{i % 7}", [float(x) for x in rng.normal(size=5)]) for i in range(200)] + [(200, "d9", [0.0] * 5), (201, "d9", None), (202, "d8", None), (203, "d8", [1.0, None])]
    v = spark.createDataFrame(rows, "part int, doc_id string, v array<float>")
    q = v.where("part % 10 = 0").select(F.col("doc_id").alias("query_id"), "part", "v")
    every = q.select("query_id").distinct().crossJoin(v.select("doc_id").distinct())
    want = rerank.max_sim(q, v.select("doc_id", "v").join(every, "doc_id")).select("query_id", "doc_id", F.round("score", 9)).collect()
    found = rerank.max_sim(q, v.select("doc_id", "v")).select("query_id", "doc_id", F.round("score", 9)).collect()
    known = {tuple(r) for r in want if r[2] is not None}
    assert known and {tuple(r) for r in found if r[2] is not None} == known
    assert {tuple(r[:2]) for r in found} == {tuple(r[:2]) for r in want}


@pytest.mark.parametrize("window", [2, 3, 8])
def test_co_occurrence_counts_windows(spark, window):
    """Before, every window made a row of each pair of its terms, even for the pairs of a few terms."""
    rng = np.random.default_rng(4)
    texts = [[f"t{x}" for x in rng.integers(10, 18, n)] for n in (0, 1, 2, 5, 7, 8, 9, 30, 60)] + [["été", "zz", "t10", "été"]]
    windows = [set(t[i : i + window]) for t in texts if t for i in range(max(len(t) - window, 0) + 1)]
    n, single = Counter(p for w in windows for p in combinations(sorted(w), 2)), Counter(x for w in windows for x in w)
    index = TextIndex(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id int, text string"), tokenizer=Tokenizer(fold_diacritics=False))
    found = {(r.a, r.b): (r.n, r.na, r.nb) for r in expand.co_occurrence(index, window, 1, 1, 1.0, -100.0).collect()}
    assert found == {p: (k, single[p[0]], single[p[1]]) for p, k in n.items()}
    some = {(r.a, r.b): (r.n, r.na, r.nb) for r in expand.co_occurrence(index, window, 1, 1, 1.0, -100.0, among=["t11", "absent"]).collect()}
    assert some == {p: x for p, x in found.items() if "t11" in p}


def test_classifier_shuffles_terms_once(spark, sf_dir):
    """Before, terms of documents were shuffled by document, by term for each table of the model, and by document again, once for each lane of a blend."""
    tracker = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = {s.stageId() for s in _stages(tracker)}
    assert catalog.QUERIES["blended_classifier"](spark, sf_dir).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sum(s.shuffleWriteBytes() for s in _stages(tracker) if s.stageId() not in seen) < 3_500_000  # 5.6 MB before
