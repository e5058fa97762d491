"""Queries and operators over the whole of their job: nothing of a text is left out."""

from __future__ import annotations

import duckdb
import pytest

from sparktext.plans import catalog


@pytest.mark.parametrize("name", ["decision_tree", "random_forest", "linear_classifier"])
def test_classifiers_read_whole_documents(spark, tmp_path, name):
    rows = [(i, " ".join(["same"] * 70 + [f"{lang}word", f"{lang}other", f"{lang}third"]), lang) for i in range(40) for lang in [("en", "de")[i // 4 % 2]]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: lang for i, _, lang in rows if i % 4 == 0}
    found = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    said = {r.doc_id: r.category for r in found if r.probability > 0.5}
    assert said == want


# queries of the engine


WHOLE = {"all_term_positions": ("term_positions", " WHERE length(term) = 5"), "all_ngrams": ("stop_words_and_ngrams", " HAVING count(*) > 3"), "all_naive_bayes_counts": ("naive_bayes_counts", " WHERE c > 5")}


@pytest.mark.parametrize("name", WHOLE)
def test_all_terms_and_counts(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    part, condition = WHOLE[name]
    assert condition in catalog.SQL[part]
    want = con.execute(catalog.SQL[part].replace(condition, ""))
    df = catalog.QUERIES[name](spark, sf_dir)
    assert sorted(map(tuple, df.select(*(d[0] for d in want.description)).collect())) == sorted(want.fetchall())


def test_expansion_learns_from_documents(spark, tmp_path):
    texts = ["quick brown fox", "quick brown dog", "slow green turtle", "slow green snail", "a red bird sings", "the blue fish swims", "quick brown cat"]
    spark.createDataFrame([(50 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)
    assert {(r.a, r.b, r.n) for r in catalog.QUERIES["co_occurrence_of_documents"](spark, sf).collect()} == {("brown", "quick", 3), ("green", "slow", 2)}
    assert catalog.QUERIES["expanded_index"](spark, sf).count() == len(texts)
    like = catalog.QUERIES["more_like_every_fiftieth"](spark, sf).collect()
    assert {(r.query_id, r.doc_id) for r in like if r.query_id == 100} == {(100, 150)}
    assert {r.doc_id for r in like if r.query_id == 0} == {50, 300}
