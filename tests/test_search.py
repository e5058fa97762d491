import math

import pytest
from pyspark.sql import functions as F

from sparktext.functions.words import Tokenizer
from sparktext.operators import classify, evaluate, expand, facets, fusion, query, rerank, scoring, vectors
from sparktext.operators.index import TextIndex
from sparktext.plans.search import SearchIndex

TEXTS = ["quick brown fox jumps", "lazy dog sleeps in the sun", "quick dog quick dog", "", None, "the fox and the dog", "well-known fox tale"]


@pytest.fixture(scope="module")
def index(spark):
    return TextIndex(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).keep()


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def naive_bm25(text, k1=1.5, b=0.75):
    docs = [query.tokenize(t or "") for t in TEXTS]
    n, avg, out = len(docs), sum(map(len, docs)) / len(docs), {}
    for i, d in enumerate(docs):
        s = 0.0
        for t in set(query.tokenize(text)):
            df = sum(t in x for x in docs)
            if tf := d.count(t):
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avg))
        if s:
            out[i] = s
    return out


def test_bm25(spark, index):
    found = {r.doc_id: r.score for r in scoring.score(index, asked(spark, "quick dog"), scoring.bm25()).collect()}
    assert found == pytest.approx(naive_bm25("quick dog"))
    single = {r.doc_id: r.score for r in scoring.score(index, asked(spark, "quick dog"), scoring.bm25(single_precision=True)).collect()}
    assert single == pytest.approx(found, rel=1e-5)


def test_weights_and_rounding(spark, index):
    weights = spark.createDataFrame([(0, "quick", 0.0)], "query_id long, term string, weight double")
    found = {r.doc_id for r in scoring.score(index, asked(spark, "quick dog"), scoring.bm25(), weights=weights).collect()}
    assert found == {1, 2, 5}
    ties = spark.createDataFrame([(0, 1, 1.00001), (0, 2, 1.00002), (0, 3, 0.5)], "query_id long, doc_id long, score double")
    assert {r.doc_id: round(r.score, 6) for r in scoring.rounded(ties).collect()} == {2: 1.0, 1: 0.999999, 3: 0.5}


def test_parser():
    q = query.parse('fox +dog -cat "quick brown" -"lazy dog" fo* sunn~2 well-known title:fox', ("title",))
    assert q.terms == ["fox", "dog", "quick", "brown", "well", "known"] and q.required == [("", "dog")] and q.prohibited == [("", "cat")]
    assert [p.terms for p in q.phrases] == [("quick", "brown")] and [p.terms for p in q.prohibited_phrases] == [("lazy", "dog")]
    assert {(a.base, a.prefix, a.edits) for a in q.atoms} == {("fo", True, 0), ("sunn", False, 2)} and q.scoped == [("title", "fox")]
    assert query.parse("-cat").pure_negative and not query.parse("cat -dog").pure_negative
    assert query.parse("+a b*", syntax=False).features == set()
    with pytest.raises(NotImplementedError):
        query.ensure_supported(q, {"phrases"})
    with pytest.raises(ValueError):
        query.parse(" ".join(f"t{i}*" for i in range(40)))


@pytest.mark.parametrize("text, want", [('"quick brown"', {0}), ("fox -brown", {5, 6}), ("+fox dog", {0, 5, 6}), ("-fox", {1, 2, 3, 4}), ("slee*", {1}), ("qick~1", {0, 2}), ('"dog quick"', {2}), ('dog -"lazy dog"', {2, 5})])
def test_operators(index, text, want):
    assert {r.doc_id for r in query.search(index, text).collect()} == want


def test_metadata(spark):
    df = spark.createDataFrame([(1, "10", "a|b"), (2, "9", None), (3, None, "ab"), (4, "1,200", "")], "id int, n string, tags string")

    def ids(condition):
        return {r.id for r in df.where(condition).collect()}

    n, tags = F.col("n"), F.col("tags")
    assert ids(query.metadata(n, "greater", "9.5")) == {1, 4} and ids(query.metadata(n, "less", "10")) == {2}
    assert ids(query.metadata(n, "not_equal", "9")) == {1, 3, 4} and ids(query.metadata(tags, "equal", "b", "|")) == {1} and ids(query.metadata(tags, "contains", "a")) == {1, 3}
    with pytest.raises(ValueError):
        query.metadata(n, "like", "x")


def test_facade(spark):
    docs = spark.createDataFrame([(1, "red car", "en"), (2, "blue automobile", "fr"), (3, "green tree", "en")], "k long, body string, lang string")
    index = SearchIndex(docs, id="k", text="body", synonyms=(("car", "automobile"),))
    assert [r.doc_id for r in index.search("car").collect()] == [1, 2] or {r.doc_id for r in index.search("car").collect()} == {1, 2}
    assert {r.doc_id for r in index.search("car", where=F.col("lang") == "fr").collect()} == {2}
    page, counts = index.search_with_facets("red tree", ["lang"])
    assert page.count() == 2 and {(r.value, r["count"]) for r in counts.collect()} == {("en", 2)}
    assert index.cost("car red") == 2 and index.explain("car", 1).count() == 1 and index.describe("car zebra").where("absent").count() == 1
    context = SearchIndex(docs, id="k", text="body", context=("lang",))
    assert {r.doc_id for r in context.search("fr").collect()} == {2}


def test_fusion(spark):
    runs = spark.createDataFrame([("a", 0, 1, 3.0), ("a", 0, 2, 1.0), ("b", 0, 2, 5.0), ("b", 0, 3, float("nan")), ("b", 0, 4, -1.0)], "engine string, query_id long, doc_id long, score double")
    good = runs.where("NOT isnan(score)")
    assert {r.doc_id: r.score for r in fusion.reciprocal_rank(good).collect()} == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 4: 1 / 62})
    assert {r.doc_id: r.score for r in fusion.comb_sum(runs).collect()} == {1: 3.0, 2: 6.0} and {r.doc_id: r.score for r in fusion.comb_mnz(runs).collect()} == {1: 3.0, 2: 12.0}
    assert {r.doc_id: r.score for r in fusion.weighted(runs, "max").collect()} == pytest.approx({1: 1.0, 2: 1 / 3 + 1.0})


def test_rerank(spark):
    assert rerank.highlight("The Fox <b> saw a fox", {"fox"}, escape=True, whole=True) == ["The <em>Fox</em> &lt;b&gt; saw a <em>fox</em>"]
    text = " ".join(f"w{i}" for i in range(60)) + " fox " + " ".join(f"x{i}" for i in range(60))
    got = spark.createDataFrame([(text,)], "t string").select(rerank.compressed(F.col("t"), F.array(F.lit("fox")), 2).alias("c")).first().c
    assert got == "w58 w59 fox x0 x1"
    window = spark.range(1).select(rerank.tightest_window(F.array(F.array(F.lit(1), F.lit(10)), F.array(F.lit(4), F.lit(12)))).alias("w")).first().w
    assert window == 3
    page = spark.createDataFrame([(0, 1, 1.0, [1.0, 0.0]), (0, 2, 0.9, [1.0, 0.0]), (0, 3, 0.5, [0.0, 1.0])], "query_id long, doc_id long, score double, embedding array<double>")
    assert [r.doc_id for r in rerank.mmr(page).orderBy("rank").collect()] == [1, 3, 2]
    assert rerank.routed({"a": 0.4}, 0.5, "z") == "z" and rerank.cheapest_route({"a": 2, "b": 1}) == "b"
    with pytest.raises(Exception, match="negative"):
        rerank.boosted(page, F.lit(-1.0)).collect()


def test_expansion(spark, index):
    assert expand.damerau("abcd", "acbd") == 1 and expand.damerau("abc", "") == 3
    assert expand.damerau("cat", "cst", "qwerty") < expand.damerau("cat", "cpt", "qwerty")
    assert [t for t, _ in expand.text_rank(["a", "b", "a", "c", "a", "d"])][0] == "a"
    assert {r.term for r in expand.corrections(index.vocabulary, ["dgo"], 1.0).collect()} == {"dog"}


def test_facets(spark):
    rows = spark.createDataFrame([(1, "1"), (2, "2"), (9, "x"), (10, None)], "n int, s string")
    assert [(r.bucket, r["count"]) for r in facets.histogram(rows, "n", 3).orderBy("bucket").collect()] == [(0, 2), (2, 2)]
    assert [r["count"] for r in facets.ranges(rows, "n", [1, 2, 10]).orderBy("bucket").collect()] == [1, 2]
    assert facets.unparseable(rows, "s").first().unparseable == 1
    with pytest.raises(ValueError):
        facets.ranges(rows, "n", [2, 1])


def test_measures(spark):
    runs = spark.createDataFrame([("x", "q", d, 1.0, i + 1) for i, d in enumerate(["a", "b", "a", "c"])], "config string, query_id string, doc_id string, score double, rank int")
    qrels = spark.createDataFrame([("q", "b", 2.0), ("q", "c", 1.0), ("q", "z", 1.0), ("q", "a", 0.0)], "query_id string, doc_id string, grade double")
    m = evaluate.measures(runs, qrels, 3).first()
    assert (m.precision, m.recall, m.rr) == pytest.approx((2 / 3, 2 / 3, 1 / 2)) and m.ap == pytest.approx((1 / 2 + 2 / 3) / 3)
    ideal = 3 + 1 / math.log2(3) + 1 / 2
    assert m.ndcg == pytest.approx((3 / math.log2(3) + 1 / 2) / ideal)
    assert evaluate.mcnemar(0, 0) == 1 and evaluate.mcnemar(1, 9) == pytest.approx(0.021484375)
    assert evaluate.adjusted([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06]) and evaluate.adjusted([0.01, 0.04, 0.03], "bh") == pytest.approx([0.03, 0.04, 0.04])


def test_models():
    items = [{"a": 1.0}, {"a": 1.0, "b": 1.0}, {"b": 1.0}, {"c": 1.0}] * 5
    labels = ["x", "x", "y", "y"] * 5
    tree = classify.DecisionTree().train(items, labels)
    assert tree.root.question == ("a", None) and tree.predict({"a": 1.0})["x"] > 0.9
    before = tree.predict({"a": 1.0})
    tree.learn({"a": 1.0}, "y")
    tree.learn({"a": 1.0}, "y", -1)
    assert tree.predict({"a": 1.0}) == before
    for model in (classify.RandomForest(trees=9).train(items, labels), classify.LinearModel().train(items, labels)):
        assert max(model.predict({"a": 1.0}).items(), key=lambda x: x[1])[0] == "x"
    numeric = classify.DecisionTree(min_leaf=1).train([{"v": float(i)} for i in range(10)], ["lo"] * 5 + ["hi"] * 5, numeric=frozenset(["v"]))
    assert numeric.root.question == ("v", 5.0)
    assert classify.isotonic(__import__("numpy").array([1.0, 2.0, 3.0]), __import__("numpy").array([0, 1, 0])) == [(1.0, 0.0), (2.0, 0.5)]


def test_vectors(spark):
    assert vectors.fnv1a("") == 0xCBF29CE484222325
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id long, v array<double>")
    q = spark.createDataFrame([(0, [1.0, 1.0])], "query_id long, q array<double>")
    assert [(r.id, round(r.score, 6)) for r in vectors.dense(v, q).orderBy("rank").collect()] == [(1, 0.707107), (2, 0.707107)]


def test_folding_option(spark):
    docs = spark.createDataFrame([(1, "été")], "doc_id long, text string")
    assert TextIndex(docs, tokenizer=Tokenizer(fold_diacritics=False)).vocabulary.first().term == "été"


def test_scoped_terms_stay_in_their_field(spark):
    rows = [(1, "red gear", "plain"), (2, "plain gear", "red"), (3, "redder", "red red"), (4, "blue", "reddish green")]
    index = TextIndex(spark.createDataFrame(rows, "doc_id long, title string, text string"), fields=("title", "text"))

    def found(text):
        return {r.doc_id: r.score for r in query.search(index, text).collect()}

    assert found("title:red").keys() == {1}
    assert found("title:red*").keys() == {1, 3}
    assert found("+title:red gear").keys() == {1} and found("+title:gear* gear").keys() == {1, 2}
    assert found("text:red -title:red*").keys() == {2}
    assert found("-title:red*").keys() == {2, 4}
    # one term in one field: no other document's or field's length counts
    n, df, tf, length, average = 4, 2, 2, 2, 1.5
    corrected = tf / (0.25 + 0.75 * length / average)
    want = math.log(1 + (n - df + 0.5) / (df + 0.5)) * corrected * 2.2 / (1.2 * (0.25 + 0.75 * length / average) + corrected)
    assert abs(found("text:red")[3] - want) < 1e-9


def test_verdicts_of_score_ties(spark):
    lists = {1: [], 2: [3.0], 3: [2.0, 2.0], 4: [3.0, 2.0, 2.0], 5: [3.0, 3.0, 1.0], 6: [3.0, 2.0, 1.0, 1.0], 7: [2.0, 1.0]}
    hits = spark.createDataFrame([(q, i, x) for q, xs in lists.items() for i, x in enumerate(xs)], "query_id int, doc_id int, score double")
    asked = spark.createDataFrame([(q,) for q in lists], "query_id int")
    got = {r.query_id: r.verdict for r in scoring.discrimination(hits, 2, queries=asked).collect()}
    assert got == {1: "no_results", 2: "single_result", 3: "no_discrimination", 4: "tied_at_cut", 5: "tied_within_page", 6: "determined", 7: "determined"}
    assert scoring.discrimination(hits.where("query_id = 7"), 2, complete=False).first().verdict == "cut_unobserved"
