"""Queries against their SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from sparktext.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["bm25_top10", "bm25_va", "query_likelihood", "window_bm25", "bm25_f", "bm25_f_scoped", "scoped_search", "score_ties", "held_out_split", "phrase_search", "facets", "facet_histogram", "weighted_minmax", "retrieval_measures", "tie_aware_ndcg", "co_occurrence", "naive_bayes", "complement_naive_bayes", "dense_cosine", "more_like_this", "hierarchy"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(names, found):
    return sorted(repr([(n, float(v) if isinstance(v, float) else v) for n, v in sorted(zip(names, r))]) for r in found)


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    wanted = rows(names, want.fetchall())
    assert wanted and rows(df.columns, df.collect()) == wanted


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
