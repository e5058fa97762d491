"""Queries over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktext.functions.words import Tokenizer
from sparktext.operators import facets, query, scoring
from sparktext.operators.index import TextIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_indexes: dict[tuple, TextIndex] = {}


def documents_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of documents; its terms are kept for the session's other queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = TextIndex(read(spark, sf_dir, "documents")).keep()
    return _indexes[key]


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def literal_queries(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


# SQL building blocks

_RAW = r"regexp_extract_all(text, '[\p{L}\p{Nd}][\p{L}\p{Nd}\p{M}]*')"
_TERMS = f"list_transform(list_filter({_RAW}, lambda x: length(x) >= 2), lambda x: lower(strip_accents(x)))"
TOKENS = f"""t AS (SELECT doc_id, {_TERMS} AS toks FROM documents),
    dl AS (SELECT doc_id, len(toks)::DOUBLE AS dl, len(list_distinct(toks))::DOUBLE AS distinct_terms FROM t),
    tok AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM t),
    p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM tok GROUP BY ALL),
    v AS (SELECT term, count(*)::DOUBLE AS df, sum(tf)::DOUBLE AS cf FROM p GROUP BY ALL),
    s AS (SELECT count(*)::DOUBLE AS n, sum(dl) AS total, avg(dl) AS avgdl, avg(CASE WHEN dl > 0 THEN dl / distinct_terms END) AS avgv FROM dl)"""
BENCH = f"q AS (SELECT item_id AS query_id, term, count(*)::DOUBLE AS qtf FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL)"
IDF = "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"
NORM = "(1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl)"


def literal(*texts: str) -> str:
    rows = " UNION ALL ".join(f"SELECT {i}::BIGINT AS query_id, '{t}' AS term" for i, text in enumerate(texts) for t in dict.fromkeys(query.tokenize(text)))
    return f"q AS (SELECT query_id, term, 1.0::DOUBLE AS qtf FROM ({rows}))"


def scored_sql(weight: str, terms: str = BENCH, top: int = 10, least: str = "score <> 0") -> str:
    return f"""WITH {TOKENS}, {terms},
    r AS (SELECT query_id, doc_id, round(sum({weight}), 6) AS score FROM q JOIN p USING (term) JOIN v USING (term) JOIN dl USING (doc_id) CROSS JOIN s GROUP BY ALL)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE {least}) WHERE rank <= {top}"""


def top(scored: DataFrame, limit: int = 10) -> DataFrame:
    return scoring.page(scored, limit, digits=6).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25_sql(k1: float = 1.5, b: float = 0.75, factor: str = "") -> str:
    return f"{IDF} * tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * {NORM.format(b=b)}){factor}"


def _ranked(name: str, scorer: Callable[[], scoring.Scorer], weight: str, **options):
    @register(name, scored_sql(weight))
    def run(spark, sf_dir):
        rows = scoring.best(documents_index(spark, sf_dir), benchmark_queries(spark, sf_dir), {name: scorer()}, **options)
        return rows.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_ranked("bm25_top10", scoring.bm25, bm25_sql())
_ranked("bm25_aggressive", lambda: scoring.bm25(*scoring.BM25_PRESETS["aggressive"]), bm25_sql(2.0, 1.0))
_ranked("bm25_no_constant", lambda: scoring.bm25(saturation_constant=False), f"{IDF} * tf / (tf + 1.5::DOUBLE * {NORM.format(b=0.75)})")
_ranked("bm25_query_frequency", scoring.bm25, bm25_sql(factor=" * qtf"), query_weighting=True)
_ranked("bm25_plus", scoring.bm25_plus, f"{IDF} * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * {NORM.format(b=0.75)}) + 1)")
_ranked("bm25_l", scoring.bm25_l, f"{IDF} * 2.5::DOUBLE * (tf / {NORM.format(b=0.75)} + 0.5::DOUBLE) / (1.5::DOUBLE + tf / {NORM.format(b=0.75)} + 0.5::DOUBLE)")
_ranked("bm25_va", scoring.bm25_va, f"{IDF} * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE * (dl / distinct_terms) / avgv + 0.75::DOUBLE * dl / avgdl))")
_ranked("tf_idf", scoring.tf_idf, "tf * (ln((n + 1) / (df + 1)) + 1)")


@register("vocabulary", f"WITH {TOKENS} SELECT term, df::BIGINT AS df, cf::BIGINT AS cf FROM v")
def _(spark, sf_dir):
    return documents_index(spark, sf_dir).vocabulary


@register("index_statistics", f"WITH {TOKENS} SELECT n::BIGINT AS n, total::BIGINT AS total, round(avgdl, 6) AS avgdl, round(avgv, 6) AS avgv FROM s")
def _(spark, sf_dir):
    return documents_index(spark, sf_dir).statistics.select("n", "total", F.round("avgdl", 6).alias("avgdl"), F.round("avgv", 6).alias("avgv"))


@register("document_lengths", f"WITH {TOKENS} SELECT doc_id, dl::BIGINT AS dl FROM dl")
def _(spark, sf_dir):
    return documents_index(spark, sf_dir).terms.select("doc_id", "dl")


@register("term_positions", f"WITH {TOKENS} SELECT doc_id, term, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tok WHERE length(term) = 5 GROUP BY ALL")
def _(spark, sf_dir):
    rows = documents_index(spark, sf_dir).tokens.where(F.length("term") == 5).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("p"))
    return rows.select("doc_id", "term", "tf", F.array_join(F.col("p").cast("array<string>"), ",").alias("positions"))


@register("all_term_positions")
def _(spark, sf_dir):
    rows = documents_index(spark, sf_dir).tokens.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("p"))
    return rows.select("doc_id", "term", "tf", F.array_join(F.col("p").cast("array<string>"), ",").alias("positions"))


@register("candidate_documents", f"WITH {TOKENS} SELECT DISTINCT doc_id FROM p WHERE term IN ('loser', 'trash', 'license')")
def _(spark, sf_dir):
    return documents_index(spark, sf_dir).candidates(["loser", "trash", "license"])


@register("describe_query", f"""WITH {TOKENS}, {BENCH} SELECT query_id, term, coalesce(df, 0)::BIGINT AS df, n::BIGINT AS n, round(ln(1 + (n - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE)), 6) AS idf,
    round(coalesce(df, 0) / n, 6) AS share, df IS NULL AS absent FROM q LEFT JOIN v USING (term) CROSS JOIN s""")
def _(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    terms = scoring.query_terms(index, benchmark_queries(spark, sf_dir)).select("query_id", "term")
    return index.describe(terms).withColumn("idf", F.round("idf", 6)).withColumn("share", F.round("share", 6))


_AND_OR = ("the with license", "idiot clown", "und der")


def _boolean_sql(every: bool) -> str:
    having = "HAVING count(*) = any_value(qlen)" if every else ""
    return f"WITH {TOKENS}, {literal(*_AND_OR)}, k AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS qlen FROM q) SELECT query_id, doc_id, 1.0::DOUBLE AS score FROM k JOIN p USING (term) GROUP BY query_id, doc_id {having}"


@register("boolean_and", _boolean_sql(True))
def _(spark, sf_dir):
    return scoring.boolean(documents_index(spark, sf_dir), literal_queries(spark, *_AND_OR), True)


@register("boolean_or", _boolean_sql(False))
def _(spark, sf_dir):
    return scoring.boolean(documents_index(spark, sf_dir), literal_queries(spark, *_AND_OR), False)


@register("query_likelihood", f"""WITH {TOKENS}, {BENCH}, k AS (SELECT query_id, term, cf FROM q JOIN v USING (term)),
    d AS (SELECT DISTINCT query_id, doc_id FROM k JOIN p USING (term)),
    r AS (SELECT query_id, doc_id, round(sum(ln(0.8::DOUBLE * coalesce(tf, 0) / dl + 0.2::DOUBLE * cf / total)), 6) AS score FROM d JOIN k USING (query_id) LEFT JOIN p USING (doc_id, term) JOIN dl USING (doc_id) CROSS JOIN s GROUP BY ALL)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""")
def _(spark, sf_dir):
    return top(scoring.query_likelihood(documents_index(spark, sf_dir), benchmark_queries(spark, sf_dir)))


@register("spread_bm25", f"""WITH {TOKENS}, {BENCH}, sp AS (SELECT doc_id, term, count(*)::DOUBLE AS tf0, count(DISTINCT pos // 8)::DOUBLE AS spread FROM tok GROUP BY ALL), e AS (SELECT doc_id, term, sqrt(tf0) * sqrt(spread) AS tf FROM sp),
    r AS (SELECT query_id, doc_id, round(sum({bm25_sql()}), 6) AS score FROM q JOIN e USING (term) JOIN v USING (term) JOIN dl USING (doc_id) CROSS JOIN s GROUP BY ALL)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score <> 0) WHERE rank <= 10""")
def _(spark, sf_dir):
    return top(scoring.spread_bm25(documents_index(spark, sf_dir), benchmark_queries(spark, sf_dir)))


_WINDOWED = ("idiot clown scum", "license version")


@register("window_bm25", f"""WITH {TOKENS}, {literal(*_WINDOWED)}, m AS (SELECT query_id, doc_id, term, pos, df, n, dl FROM q JOIN tok USING (term) JOIN v USING (term) JOIN dl USING (doc_id) CROSS JOIN s),
    w AS (SELECT *, unnest(range(greatest(floor((pos - 50) / 25.0::DOUBLE)::BIGINT + 1, 0), least(pos // 25, greatest(dl::BIGINT - 50 + 24, 0) // 25) + 1)) AS w FROM m),
    tfw AS (SELECT query_id, doc_id, w, term, df, n, count(*)::DOUBLE AS tf FROM w GROUP BY ALL),
    sw AS (SELECT query_id, doc_id, w, sum({IDF} * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE)) AS score FROM tfw GROUP BY ALL)
    SELECT query_id, doc_id, round(max(score), 6) AS score FROM sw GROUP BY query_id, doc_id""")
def _(spark, sf_dir):
    return scoring.window_bm25(documents_index(spark, sf_dir), literal_queries(spark, *_WINDOWED)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


_PART_QUERIES = ("small red ring", "large blue gear", "brand#12 hot bolt")
_PART_TERMS = _TERMS.replace("text", "txt")
_PARTS = f"""t AS (SELECT p_partkey AS doc_id, field, {_PART_TERMS} AS toks FROM (SELECT p_partkey, 'p_name' AS field, p_name AS txt FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part)),
    l AS (SELECT doc_id, field, len(toks)::DOUBLE AS len FROM t), a AS (SELECT field, avg(len) AS avg FROM l GROUP BY field),
    p AS (SELECT doc_id, field, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, field, unnest(toks) AS term FROM t) GROUP BY ALL),
    s AS (SELECT count(*)::DOUBLE AS n FROM part)"""
_WEIGHTS = {"p_name": 2.0, "p_brand": 1.0, "p_type": 0.5}


def parts_index(spark, sf_dir) -> TextIndex:
    return TextIndex(read(spark, sf_dir, "part"), id="p_partkey", text="p_name", fields=tuple(_WEIGHTS))


_PART_WEIGHT = "(CASE field WHEN 'p_name' THEN 2.0::DOUBLE WHEN 'p_brand' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)"


def _bm25f_sql(condition: str = "true") -> str:
    """A term's weighted frequency t, each field's by its length, saturates against k1, by the weighted length d of the fields with the term over that of all (here: all that the condition leaves)."""
    return f"""WITH {_PARTS}, {literal(*_PART_QUERIES)},
    tt AS (SELECT doc_id, term, sum({_PART_WEIGHT} * tf / (0.25::DOUBLE + 0.75::DOUBLE * len / avg)) AS t, sum({_PART_WEIGHT} * len) AS d FROM p JOIN l USING (doc_id, field) JOIN a USING (field) WHERE {condition} GROUP BY ALL),
    v AS (SELECT term, count(*)::DOUBLE AS df FROM tt GROUP BY term), z AS (SELECT sum({_PART_WEIGHT} * avg) AS base FROM a WHERE {condition}),
    r AS (SELECT query_id, doc_id, round(sum({IDF} * t * 2.2::DOUBLE / (1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / base) + t)), 6) AS score FROM q JOIN tt USING (term) JOIN v USING (term) CROSS JOIN s CROSS JOIN z GROUP BY ALL)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10"""


@register("bm25_f", _bm25f_sql())
def _(spark, sf_dir):
    return top(scoring.bm25_f(parts_index(spark, sf_dir), literal_queries(spark, *_PART_QUERIES), _WEIGHTS))


@register("bm25_f_scoped", _bm25f_sql("field = 'p_type'"))
def _(spark, sf_dir):
    return top(scoring.bm25_f(parts_index(spark, sf_dir), literal_queries(spark, *_PART_QUERIES), _WEIGHTS, only_field="p_type"))


@register("weighted_composite", scored_sql(f"0.7::DOUBLE * ({bm25_sql()}) + 0.3::DOUBLE * (tf * (ln((n + 1) / (df + 1)) + 1))"))
def _(spark, sf_dir):
    index, q = documents_index(spark, sf_dir), benchmark_queries(spark, sf_dir)
    rows = scoring.best(index, q, {"composite": scoring.combined([(scoring.bm25(), 0.7), (scoring.tf_idf(), 0.3)])})
    return rows.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@register("length_ratio", f"WITH {TOKENS} SELECT doc_id, round(dl / avgdl, 6) AS score FROM dl CROSS JOIN s")
def _(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return index.terms.crossJoin(F.broadcast(index.statistics)).select("doc_id", F.round(scoring.length_ratio().weight(), 6).alias("score"))


@register("explain_scores", f"""WITH {TOKENS}, {literal("idiot license")} SELECT query_id, doc_id, term, tf::BIGINT AS tf, df::BIGINT AS df, round({IDF}, 6) AS idf, round({bm25_sql()}, 6) AS contribution FROM q JOIN p USING (term) JOIN v USING (term) JOIN dl USING (doc_id) CROSS JOIN s""")
def _(spark, sf_dir):
    rows = scoring.explain(documents_index(spark, sf_dir), literal_queries(spark, "idiot license"), scoring.bm25())
    return rows.withColumn("idf", F.round("idf", 6)).withColumn("contribution", F.round("contribution", 6))


@register("page_with_offset", scored_sql(bm25_sql()).replace("rank <= 10", "rank > 5 AND rank <= 12"))
def _(spark, sf_dir):
    rows = scoring.best(documents_index(spark, sf_dir), benchmark_queries(spark, sf_dir), {"bm25": scoring.bm25()}, 12).where("rank > 5")
    return rows.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@register("score_ties", f"""WITH {TOKENS}, {BENCH}, r AS (SELECT query_id, doc_id, round(sum({bm25_sql()}), 2) AS score FROM q JOIN p USING (term) JOIN v USING (term) JOIN dl USING (doc_id) CROSS JOIN s GROUP BY ALL),
    o AS (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) <= 10 AS on_page FROM r WHERE score <> 0),
    e AS (SELECT query_id, score, count(*) AS size, count(*) FILTER (on_page) AS shown FROM o GROUP BY ALL),
    w AS (SELECT query_id, sum(size)::BIGINT AS results, count(*) AS distinct_scores, max(size)::BIGINT AS largest_tie, bool_or(shown > 0 AND size > shown) AS cut_straddled, bool_or(shown > 1) AS page_tied FROM e GROUP BY query_id)
    SELECT *, CASE WHEN results = 1 THEN 'single_result' WHEN distinct_scores = 1 THEN 'no_discrimination' WHEN cut_straddled THEN 'tied_at_cut' WHEN page_tied THEN 'tied_within_page' ELSE 'determined' END AS verdict FROM w""")
def _(spark, sf_dir):
    hits = scoring.score(documents_index(spark, sf_dir), benchmark_queries(spark, sf_dir), scoring.bm25()).withColumn("score", F.round("score", 2)).where("score <> 0")
    return scoring.discrimination(hits)


@register("rare_term_gate", f"""WITH {TOKENS}, {BENCH}, k AS (SELECT query_id, term, df, sum(df) OVER (PARTITION BY query_id ORDER BY df, term ROWS UNBOUNDED PRECEDING) <= 100 AS fits FROM q JOIN v USING (term)), g AS (SELECT *, bool_or(fits) OVER (PARTITION BY query_id) AS has_any FROM k)
    SELECT query_id, term, df::BIGINT AS df FROM g WHERE fits OR NOT has_any""")
def _(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    terms = scoring.query_terms(index, benchmark_queries(spark, sf_dir)).join(index.vocabulary, "term").select("query_id", "term", "df")
    return scoring.rare_terms(terms, 100)


# query language

_HIT = f"{IDF} * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * {NORM.format(b=0.75)})"


def _search_sql(terms: str, gate: str) -> str:
    return f"WITH {TOKENS}, {literal(terms)} SELECT doc_id, round(sum({_HIT}), 6) AS score FROM q JOIN p USING (term) JOIN v USING (term) JOIN dl USING (doc_id) CROSS JOIN s JOIN t USING (doc_id) WHERE {gate} GROUP BY doc_id"


def _searched(name: str, text: str, sql: str):
    @register(name, sql)
    def run(spark, sf_dir):
        return query.search(documents_index(spark, sf_dir), text).select("doc_id", F.round("score", 6).alias("score"))


_searched("phrase_search", 'released "mit license"', _search_sql("released mit license", "EXISTS (SELECT 1 FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.doc_id = t.doc_id AND a.term = 'mit' AND b.term = 'license')"))
_searched("required_prohibited", "the +idiot -clown with", _search_sql("the idiot with", "list_contains(toks, 'idiot') AND NOT list_contains(toks, 'clown')"))
_searched("pure_negative", "-the -der", f"WITH {TOKENS} SELECT doc_id, 1.0::DOUBLE AS score FROM t WHERE NOT list_contains(toks, 'the') AND NOT list_contains(toks, 'der')")
_EXPANDED = "SELECT doc_id, round(sum({hit}), 6) AS score FROM q JOIN p USING (term) JOIN v USING (term) JOIN dl USING (doc_id) CROSS JOIN s GROUP BY doc_id".format(hit=_HIT)
_searched("prefix_search", "licen*", f"WITH {TOKENS}, q AS (SELECT term FROM v WHERE starts_with(term, 'licen') ORDER BY df DESC, term LIMIT 64) {_EXPANDED}")
_searched("fuzzy_search", "idiat~1", f"WITH {TOKENS}, q AS (SELECT term FROM v WHERE levenshtein(term, 'idiat') <= 1 ORDER BY levenshtein(term, 'idiat'), df DESC, term LIMIT 64) {_EXPANDED}")


@register("scoped_search", f"""WITH {_PARTS}, q AS (SELECT 'p_name' AS field, 'red' AS term UNION SELECT * FROM (SELECT field, term FROM p WHERE field = 'p_name' AND starts_with(term, 'ge') GROUP BY ALL ORDER BY count(*) DESC, term LIMIT 64)),
    v AS (SELECT field, term, count(*)::DOUBLE AS df FROM p GROUP BY ALL),
    h AS (SELECT doc_id, {IDF} * (tf / (0.25::DOUBLE + 0.75::DOUBLE * len / avg)) * 2.2::DOUBLE / (1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg) + tf / (0.25::DOUBLE + 0.75::DOUBLE * len / avg)) AS score FROM q JOIN p USING (field, term) JOIN v USING (field, term) JOIN l USING (doc_id, field) JOIN a USING (field) CROSS JOIN s
        UNION ALL SELECT doc_id, {IDF} * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg)) FROM p JOIN v USING (field, term) JOIN l USING (doc_id, field) JOIN a USING (field) CROSS JOIN s WHERE field = 'p_name' AND term = 'widget')
    SELECT doc_id, round(sum(score), 6) AS score FROM h WHERE doc_id IN (SELECT doc_id FROM p WHERE field = 'p_name' AND term = 'red')
    AND doc_id NOT IN (SELECT doc_id FROM p WHERE field = 'p_type' AND term = 'small') GROUP BY doc_id""")
def _(spark, sf_dir):
    return query.search(parts_index(spark, sf_dir), "+p_name:red -p_type:small p_name:ge* widget").select("doc_id", F.round("score", 6).alias("score"))


def _filter(name: str, condition: Callable[[], F.Column], sql: str):
    @register(name, f"SELECT doc_id FROM documents WHERE {sql}")
    def run(spark, sf_dir):
        return read(spark, sf_dir, "documents").where(condition()).select("doc_id")


_filter("filter_equal", lambda: query.metadata(F.col("lang"), "equal", "fr"), "lang = 'fr'")
_filter("filter_not_equal", lambda: query.metadata(F.col("lang"), "not_equal", "en"), "lang IS NULL OR lang <> 'en'")
_filter("filter_contains", lambda: query.metadata(F.col("source"), "contains", "c1"), "contains(source, 'c1')")
_filter("filter_greater", lambda: query.metadata(F.col("n_chars").cast("string"), "greater", "1,500"), "n_chars > 1500")
_filter("filter_less_text", lambda: query.metadata(F.col("source"), "less", "src15"), "source < 'src15'")
_filter("filter_any_value", lambda: query.metadata(F.concat_ws("|", "lang", "source"), "equal", "src3", "|"), "source = 'src3'")


@register("excluded_documents", f"WITH {TOKENS} SELECT DISTINCT doc_id FROM p WHERE term = 'the' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf_dir):
    return query.without(documents_index(spark, sf_dir).candidates(["the"]), read(spark, sf_dir, "labels").select("doc_id"))


# facets


def _matched(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").join(documents_index(spark, sf_dir).candidates(["idiot", "license"]), "doc_id", "left_semi")


_MATCHED = f"WITH {TOKENS}, m AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM p WHERE term IN ('idiot', 'license')))"


@register("facets", f"{_MATCHED} SELECT 'lang' AS field, lang AS value, count(*) AS count FROM m GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM m GROUP BY source")
def _(spark, sf_dir):
    return facets.categorical(_matched(spark, sf_dir), ["lang", "source"])


@register("facet_ranges", f"""{_MATCHED} SELECT bucket::INTEGER AS bucket, low::DOUBLE AS low, high::DOUBLE AS high, (SELECT count(*) FROM m WHERE n_chars >= low AND n_chars < high) AS count FROM (VALUES (0, 0, 1000), (1, 1000, 2000), (2, 2000, 8000), (3, 8000, 100000)) x(bucket, low, high)""")
def _(spark, sf_dir):
    return facets.ranges(_matched(spark, sf_dir), "n_chars", [0, 1000, 2000, 8000, 100000])


@register("facet_histogram", f"""{_MATCHED}, e AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM m), b AS (SELECT least(floor((n_chars - lo) / ((hi - lo) / 8)), 7)::INTEGER AS bucket, lo, hi FROM m CROSS JOIN e)
    SELECT bucket, round(lo + bucket * ((hi - lo) / 8), 4) AS low, round(lo + bucket * ((hi - lo) / 8) + (hi - lo) / 8, 4) AS high, count(*) AS count FROM b GROUP BY bucket, lo, hi""")
def _(spark, sf_dir):
    return facets.histogram(_matched(spark, sf_dir), "n_chars", 8).withColumn("low", F.round("low", 4)).withColumn("high", F.round("high", 4))


@register("facet_unparseable", "SELECT count(*) AS unparseable FROM part WHERE try_cast(replace(p_brand, ',', '') AS DOUBLE) IS NULL AND p_brand IS NOT NULL")
def _(spark, sf_dir):
    return facets.unparseable(read(spark, sf_dir, "part"), "p_brand")


@register("stage_metrics", "SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def _(spark, sf_dir):
    return facets.stage_metrics(read(spark, sf_dir, "events"), ["event_type"], "value").withColumn("total", F.round("total", 4))


# fusion

from sparktext.operators import classify, evaluate, expand, fusion, rerank, vectors  # noqa: E402
from sparktext.functions import similarity  # noqa: E402


def _runs(spark, sf_dir) -> DataFrame:
    """The first 50 results of two engines, for the benchmark's texts as queries."""
    index, q = documents_index(spark, sf_dir), benchmark_queries(spark, sf_dir)
    return scoring.best(index, q, {"bm25": scoring.bm25(), "tfidf": scoring.tf_idf()}, 50).withColumnRenamed("config", "engine")


def _list_sql(name: str, weight: str) -> str:
    return f"""SELECT '{name}' AS engine, * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
    (SELECT query_id, doc_id, round(sum({weight}), 6) AS score FROM q JOIN p USING (term) JOIN v USING (term) JOIN dl USING (doc_id) CROSS JOIN s GROUP BY ALL) WHERE score <> 0) WHERE rank <= 50"""


_TFIDF = "tf * (ln((n + 1) / (df + 1)) + 1)"
RUNS = f"WITH {TOKENS}, {BENCH}, runs AS ({_list_sql('bm25', bm25_sql())} UNION ALL {_list_sql('tfidf', _TFIDF)})"


def _fused(name: str, fuse: Callable[[DataFrame], DataFrame], sql: str):
    @register(name, f"{RUNS} {sql}")
    def run(spark, sf_dir):
        return fuse(_runs(spark, sf_dir)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


_fused("reciprocal_rank_fusion", lambda r: fusion.reciprocal_rank(r), "SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM runs GROUP BY ALL")
_fused("weighted_rank_fusion", lambda r: fusion.reciprocal_rank(r, 10, {"bm25": 0.7, "tfidf": 0.3}), "SELECT query_id, doc_id, round(sum((CASE engine WHEN 'bm25' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END) / (10 + rank)), 6) AS score FROM runs GROUP BY ALL")
_fused("comb_sum", fusion.comb_sum, "SELECT query_id, doc_id, round(sum(score), 6) AS score FROM runs WHERE score > 0 GROUP BY ALL")
_fused("comb_mnz", fusion.comb_mnz, "SELECT query_id, doc_id, round(sum(score) * count(*), 6) AS score FROM runs WHERE score > 0 GROUP BY query_id, doc_id")
_OVER = "OVER (PARTITION BY engine, query_id)"
for _how, _normal in (("max", f"score / max(score) {_OVER}"), ("sum", f"score / sum(score) {_OVER}"), ("minmax", f"CASE WHEN max(score) {_OVER} = min(score) {_OVER} THEN 1.0 ELSE (score - min(score) {_OVER}) / (max(score) {_OVER} - min(score) {_OVER}) END")):
    _fused(f"weighted_{_how}", lambda r, h=_how: fusion.weighted(r, h, {"bm25": 2.0}), f"SELECT query_id, doc_id, round(sum(w * normal), 6) AS score FROM (SELECT *, {_normal} AS normal, CASE engine WHEN 'bm25' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM runs WHERE score > 0) GROUP BY query_id, doc_id HAVING sum(w * normal) > 0")


@register("bayesian_fusion", f"{RUNS}, b AS (SELECT *, least(greatest(score / (max(score) {_OVER} + 1), 1e-12), 1 - 1e-12) AS pr FROM runs) SELECT query_id, doc_id, round(1 / (1 + exp(-sum(ln(pr) - ln(1 - pr)))), 6) AS score FROM b GROUP BY ALL")
def _(spark, sf_dir):
    from pyspark.sql import Window

    runs = _runs(spark, sf_dir).withColumn("score", F.col("score") / (F.max("score").over(Window.partitionBy("engine", "query_id")) + 1))
    return fusion.bayesian(runs).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@register("source_agreement", f"""{RUNS}, x AS (SELECT *, greatest(0, least(1, score / max(score) {_OVER})) AS strength FROM runs), a AS (SELECT query_id, doc_id, count(*) AS found, count(*) FILTER (strength >= 0.5) AS strong FROM x GROUP BY ALL)
    SELECT query_id, doc_id, found, strong, CASE WHEN found = 1 THEN 'single_source' WHEN strong = 0 THEN 'lukewarm' WHEN strong = found AND found = 2 THEN 'unanimous' ELSE 'disputed' END AS verdict FROM a""")
def _(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumnRenamed("engine", "source")
    return facets.agreement(runs).select("query_id", "doc_id", "found", "strong", "verdict")


@register("merge_contributions", f"{RUNS} SELECT engine, query_id, doc_id, round(score / max(score) {_OVER}, 6) AS contribution FROM runs WHERE score > 0")
def _(spark, sf_dir):
    return fusion.contributions(_runs(spark, sf_dir)).select("engine", "query_id", "doc_id", F.round("contribution", 6).alias("contribution"))


@register("boosted_search", f"WITH {TOKENS}, {BENCH}, r AS (SELECT query_id, doc_id, sum({bm25_sql()}) AS score FROM q JOIN p USING (term) JOIN v USING (term) JOIN dl USING (doc_id) CROSS JOIN s GROUP BY ALL) SELECT query_id, doc_id, round(score * (CASE WHEN lang = 'en' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) + 0.25::DOUBLE, 5) AS score FROM r JOIN documents USING (doc_id) WHERE score <> 0")
def _(spark, sf_dir):
    hits = scoring.score(documents_index(spark, sf_dir), benchmark_queries(spark, sf_dir), scoring.bm25()).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rerank.boosted(hits, F.when(F.col("lang") == "en", 1.5).otherwise(1.0), 0.25).select("query_id", "doc_id", F.round("score", 5).alias("score"))


@register("proximity_rerank", f"""WITH {TOKENS}, {literal("license version")}, h AS (SELECT doc_id, round(sum({bm25_sql()}), 9) AS score FROM q JOIN p USING (term) JOIN v USING (term) JOIN dl USING (doc_id) CROSS JOIN s GROUP BY ALL),
    w AS (SELECT a.doc_id, min(abs(a.pos - b.pos) + 1) AS w FROM tok a JOIN tok b USING (doc_id) WHERE a.term = 'license' AND b.term = 'version' GROUP BY a.doc_id)
    SELECT 0::BIGINT AS query_id, doc_id, round(CASE WHEN w IS NULL THEN score ELSE score * greatest(1 - 0.5::DOUBLE * (1 - 2.0::DOUBLE / w), 0.5::DOUBLE) END, 6) AS score FROM h LEFT JOIN w USING (doc_id)""")
def _(spark, sf_dir):
    index, q = documents_index(spark, sf_dir), literal_queries(spark, "license version")
    terms = scoring.query_terms(index, q)
    from sparktext.operators.index import idf

    matched = scoring.matches(index, terms, positions=True).withColumn("idf", idf(F.col("df"), F.col("n")))
    return rerank.proximity(matched, scoring.score(index, q, scoring.bm25())).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@register("term_overlap", f"WITH {TOKENS}, {literal('released under the license idiot')} SELECT doc_id, count(*) / 5.0::DOUBLE AS overlap FROM q JOIN p USING (term) GROUP BY doc_id")
def _(spark, sf_dir):
    q = F.array(*map(F.lit, query.tokenize("released under the license idiot")))
    return documents_index(spark, sf_dir).terms.select("doc_id", similarity.overlap(q, F.col("terms")).alias("overlap")).where("overlap > 0")


@register("context_compression")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", rerank.compressed(F.col("text"), F.array(F.lit("license"), F.lit("idiot"))).alias("context")).where("context <> ''")


@register("highlight")
def _(spark, sf_dir):
    hits = documents_index(spark, sf_dir).candidates(["license", "idiot"])
    return rerank.highlighted(read(spark, sf_dir, "documents").join(hits, "doc_id", "left_semi"), ["license", "idiot"])


@register("feedback_boost", """WITH c AS (SELECT conv_id, turn, role, text FROM conversations)
    SELECT role AS query, conv_id AS doc_id, sum(CASE WHEN length(text) > 200 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END) AS weight FROM c GROUP BY ALL""")
def _(spark, sf_dir):
    from sparktext.streaming import incremental

    return incremental.feedback(read(spark, sf_dir, "conversations").select(F.col("role").alias("query"), F.col("conv_id").alias("doc_id"), F.when(F.length("text") > 200, 1.0).otherwise(-0.5).alias("weight")))


@register("feedback_search")
def _(spark, sf_dir):
    index, q = documents_index(spark, sf_dir), literal_queries(spark, "idiot clown", "license version")
    history = index.terms.where(F.array_contains("terms", "idiot") | F.array_contains("terms", "license")).select(F.filter("terms", lambda t: t.isin("idiot", "license", "clown")).alias("terms"), "doc_id", F.lit(1.0).alias("weight"))
    strength = rerank.feedback_strength(history.withColumn("terms", F.array_sort(F.array_distinct("terms"))), q.select("query_id", index.tokenizer.terms(F.col("text")).alias("terms")))
    return rerank.with_feedback(scoring.score(index, q, scoring.bm25()), strength)


# vectors

_COSINE = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
_VECTORS = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _nearest_sql(score: str, vectors_: str = _VECTORS) -> str:
    return f"""WITH {vectors_}, r AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({score}, 6) AS score FROM e a CROSS JOIN e b WHERE a.vec_id % 50 = 0)
    SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r WHERE score > 0) WHERE rank <= 10"""


@register("dense_cosine", _nearest_sql(_COSINE))
def _(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return vectors.dense(v, q, digits=6).select("query_id", "id", "score")


@register("dense_l2", _nearest_sql("1 / (1 + sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))))"))
def _(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return vectors.dense(v, q, metric="l2", digits=6).select("query_id", "id", "score")


@register("dense_inner", _nearest_sql("list_dot_product(a.v, b.v)"))
def _(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return vectors.dense(v, q, metric="inner", digits=6).select("query_id", "id", "score")


@register("dense_int8")
def _(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return vectors.dense(v, q, quantize=True, digits=6).select("query_id", "id", "score")


@register("sparse_search", f"""WITH {TOKENS}, {BENCH}, r AS (SELECT query_id, doc_id AS id, round(sum(qtf * tf), 6) AS score FROM q JOIN p USING (term) GROUP BY ALL)
    SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 10""")
def _(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    d = index.postings.select(F.col("doc_id").alias("id"), "term", F.col("tf").cast("double").alias("w"))
    q = scoring.query_terms(index, benchmark_queries(spark, sf_dir)).select("query_id", "term", F.col("qtf").cast("double").alias("w"))
    return vectors.sparse(d, q).withColumn("rank", F.col("rank").cast("long"))


@register("mean_vectors", f"WITH {_VECTORS}, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL) SELECT label, i::INTEGER AS i, round(x, 6) AS x FROM m")
def _(spark, sf_dir):
    m = vectors.mean_vectors(read(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("v")), "label")
    return m.select("label", F.posexplode("v").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@register("hashed_embeddings")
def _(spark, sf_dir):
    return vectors.hashed_embeddings(documents_index(spark, sf_dir).tokens.select("doc_id", "term")).select("doc_id", F.explode("v").alias("place", "w"))


@register("max_sim", f"""WITH {_VECTORS}, b AS (SELECT a.label AS query_id, b.label AS doc_id, a.vec_id AS part, max({_COSINE}) AS best FROM e a CROSS JOIN e b WHERE a.vec_id % 50 = 0 GROUP BY ALL)
    SELECT query_id, doc_id, round(sum(best), 6) AS score FROM b GROUP BY ALL""")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("label").alias("query_id"), F.col("vec_id").alias("part"), F.col("embedding").alias("v"))
    return rerank.max_sim(q, e.select(F.col("label").alias("doc_id"), F.col("embedding").alias("v"))).withColumn("score", F.round("score", 6))


@register("mmr_rerank")
def _(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    page = vectors.dense(v, q, 50).join(v.withColumnRenamed("v", "embedding"), "id").select("query_id", F.col("id").alias("doc_id"), "score", "embedding")
    return rerank.mmr(page)


# similarity, keywords, expansion


@register("levenshtein_names", "SELECT p_partkey AS doc_id, levenshtein(p_name, p_type)::INTEGER AS distance FROM part")
def _(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.levenshtein("p_name", "p_type").alias("distance"))


_PAIRS = f"""WITH {TOKENS}, u AS (SELECT doc_id, list_distinct(toks) AS u FROM t), x AS (SELECT a.doc_id, a.u AS a, b.u AS b FROM u a JOIN u b ON b.doc_id = a.doc_id + 1)"""


def _next_terms(spark, sf_dir) -> DataFrame:
    t = documents_index(spark, sf_dir).terms
    return t.select("doc_id", F.col("terms").alias("a")).join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("terms").alias("b")), "doc_id")


@register("jaccard_neighbours", f"{_PAIRS} SELECT doc_id, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS score FROM x")
def _(spark, sf_dir):
    return _next_terms(spark, sf_dir).select("doc_id", F.round(similarity.jaccard(F.col("a"), F.col("b")), 6).alias("score"))


@register("dice_neighbours", f"{_PAIRS} SELECT doc_id, round(2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS score FROM x")
def _(spark, sf_dir):
    return _next_terms(spark, sf_dir).select("doc_id", F.round(similarity.dice(F.col("a"), F.col("b")), 6).alias("score"))


_GRAMS = "list_distinct(list_transform(range(1, length('  ' || {0} || '  ') - 1), lambda i: substr('  ' || {0} || '  ', i, 3)))"


@register("trigram_names", f"WITH g AS (SELECT p_partkey AS doc_id, {_GRAMS.format('p_name')} AS a, {_GRAMS.format('p_type')} AS b FROM part) SELECT doc_id, round(2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS score FROM g")
def _(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.round(similarity.trigram_dice(F.col("p_name"), F.col("p_type")), 6).alias("score"))


@register("trigram_search")
def _(spark, sf_dir):
    texts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return vectors.trigram_search(texts, literal_queries(spark, "large brass", "stel widget"), 0.2).withColumn("score", F.round("score", 6))


@register("tf_idf_keywords", f"""WITH {TOKENS}, f AS (SELECT doc_id, term, count(*)::DOUBLE AS tf, min(pos) AS first FROM tok GROUP BY ALL), r AS (SELECT doc_id, term, first, round(tf * (ln((n + 1) / (df + 1)) + 1), 6) AS score FROM f JOIN v USING (term) CROSS JOIN s)
    SELECT doc_id, term, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) AS rank FROM r) WHERE rank <= 10""")
def _(spark, sf_dir):
    return expand.tf_idf_keywords(documents_index(spark, sf_dir))


@register("text_rank_keywords")
def _(spark, sf_dir):
    return expand.text_rank_keywords(documents_index(spark, sf_dir))


@register("co_occurrence", f"""WITH {TOKENS.replace('FROM documents)', "FROM (SELECT item_id AS doc_id, text FROM benchmark))")}, w AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(toks) - 7, 1) + 1), lambda i: list_distinct(toks[i:i + 7]))) AS w FROM t WHERE len(toks) > 0),
    wn AS (SELECT row_number() OVER () AS id, w FROM w), sg AS (SELECT id, unnest(w) AS term FROM wn), c AS (SELECT term, count(*) AS n FROM sg GROUP BY term), tot AS (SELECT count(*) AS w FROM wn),
    pr AS (SELECT a.term AS a, b.term AS b, count(*) AS n FROM sg a JOIN sg b ON a.id = b.id AND a.term < b.term GROUP BY ALL HAVING count(*) >= 2)
    SELECT a, b, pr.n AS n, x.n AS na, y.n AS nb, round(ln(pr.n * tot.w / (x.n::DOUBLE * y.n)), 6) AS pmi FROM pr JOIN c x ON x.term = a JOIN c y ON y.term = b CROSS JOIN tot
    WHERE x.n BETWEEN 2 AND 0.5 * tot.w AND y.n BETWEEN 2 AND 0.5 * tot.w AND ln(pr.n * tot.w / (x.n::DOUBLE * y.n)) > 0""")
def _(spark, sf_dir):
    index = TextIndex(read(spark, sf_dir, "benchmark"), id="item_id")
    return expand.co_occurrence(index).withColumn("pmi", F.round("pmi", 6))


@register("co_occurrence_of_documents")
def _(spark, sf_dir):
    return expand.co_occurrence(documents_index(spark, sf_dir)).withColumn("pmi", F.round("pmi", 6))


@register("expanded_terms")
def _(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    terms = scoring.query_terms(index, literal_queries(spark, "the erth with", "ing heon")).select("query_id", "term")
    pairs = expand.co_occurrence(index, among=[r.term for r in terms.select("term").distinct().collect()])  # a stated set
    return expand.expansions(pairs, terms).withColumn("weight", F.round("weight", 6))


@register("saturating_weights", f"WITH {BENCH}, w AS (SELECT query_id, term, 9.0::DOUBLE * qtf / (8 + qtf) AS w FROM q) SELECT query_id, term, round(w / max(w) OVER (PARTITION BY query_id), 6) AS weight FROM w")
def _(spark, sf_dir):
    return expand.saturating_weights(scoring.query_terms(documents_index(spark, sf_dir), benchmark_queries(spark, sf_dir))).withColumn("weight", F.round("weight", 6))


@register("corrections", f"WITH {TOKENS} SELECT g AS given, term, df::BIGINT AS df, damerau_levenshtein(term, g)::DOUBLE AS distance, round(1 / (1 + damerau_levenshtein(term, g)::DOUBLE), 6) AS weight FROM v CROSS JOIN (VALUES ('idoit'), ('lisence')) x(g) WHERE damerau_levenshtein(term, g) <= 1")
def _(spark, sf_dir):
    return expand.corrections(documents_index(spark, sf_dir).vocabulary, ["idoit", "lisence"], 1.0).withColumn("weight", F.round("weight", 6))


@register("more_like_this", f"""WITH {TOKENS}, i AS (SELECT item_id AS query_id FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents)), k AS (SELECT doc_id AS query_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS r FROM p WHERE doc_id IN (SELECT query_id FROM i)), q AS (SELECT query_id, term FROM k WHERE r <= 25),
    r AS (SELECT query_id, doc_id, round(sum({bm25_sql()}), 6) AS score FROM q JOIN p USING (term) JOIN v USING (term) JOIN dl USING (doc_id) CROSS JOIN s WHERE query_id <> doc_id GROUP BY ALL)
    SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score <> 0) WHERE rank <= 10""")
def _(spark, sf_dir):
    ids = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return expand.more_like_this(documents_index(spark, sf_dir), ids).select("query_id", "doc_id", "score")


@register("more_like_every_fiftieth")
def _(spark, sf_dir):
    ids = read(spark, sf_dir, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"))
    return expand.more_like_this(documents_index(spark, sf_dir), ids).select("query_id", "doc_id", "score")


@register("feedback_terms")
def _(spark, sf_dir):
    index, q = documents_index(spark, sf_dir), literal_queries(spark, "license version", "idiot clown")
    seeds = scoring.page(scoring.score(index, q, scoring.bm25()), 10, digits=6).select("query_id", "doc_id", "score")
    return expand.feedback_terms(index, seeds, scoring.query_terms(index, q).select("query_id", "term"), read(spark, sf_dir, "documents").select("doc_id", "text"))


@register("stop_words_and_ngrams", rf"""WITH t AS (SELECT doc_id, list_filter({_TERMS}, lambda x: x NOT IN ('the', 'of', 'and', 'to', 'in')) AS toks FROM documents),
    g AS (SELECT doc_id, CASE WHEN len(toks) < 2 THEN toks ELSE list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) END AS g FROM t), c AS (SELECT unnest(g) AS term, doc_id FROM g)
    SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM c GROUP BY term HAVING count(*) > 3""")
def _(spark, sf_dir):
    index = TextIndex(read(spark, sf_dir, "documents"), tokenizer=Tokenizer(stop_words=("the", "of", "and", "to", "in"), ngram_max=2))
    return index.vocabulary.where("cf > 3")


@register("all_ngrams")
def _(spark, sf_dir):
    return TextIndex(read(spark, sf_dir, "documents"), tokenizer=Tokenizer(stop_words=("the", "of", "and", "to", "in"), ngram_max=2)).vocabulary


@register("stemmed_vocabulary")
def _(spark, sf_dir):
    from sparktext.functions.stemmers import stemmed

    return stemmed(documents_index(spark, sf_dir).vocabulary.select("term", "cf"), "english").groupBy("stem").agg(F.sum("cf").alias("cf"))


# measures


def _judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Runs of two configurations, and relevance: documents that hold a benchmark item's first 40 characters, graded 2, or share four of its terms of more than 9 letters, graded 1."""
    index, q = documents_index(spark, sf_dir), benchmark_queries(spark, sf_dir)
    runs = scoring.best(index, q, {"bm25": scoring.bm25(), "tfidf": scoring.tf_idf()}, 20)
    long = scoring.shared(index, scoring.query_terms(index, q).where(F.length("term") > 9), 2)
    qrels = long.select("query_id", "doc_id", F.when(F.col("shared") >= 4, 2.0).otherwise(1.0).alias("grade"))
    return runs, qrels


def _judged_sql() -> str:
    lists = RUNS.replace("engine", "config").replace("rank <= 50", "rank <= 20")
    return f"""{lists}, g AS (SELECT query_id, doc_id, count(*) AS shared FROM q JOIN p USING (term) WHERE length(term) > 9 GROUP BY ALL HAVING count(*) >= 2),
    rel AS (SELECT query_id, doc_id, CASE WHEN shared >= 4 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS grade FROM g), hit AS (SELECT r.*, grade FROM runs r LEFT JOIN rel USING (query_id, doc_id) WHERE rank <= 10),
    ideal AS (SELECT query_id, count(*) AS relevant, sum(1 / log2(pl + 1)) FILTER (pl <= 10) AS ib, sum((2 ** grade - 1) / log2(pl + 1)) FILTER (pl <= 10) AS ig FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS pl FROM rel) GROUP BY query_id),
    sf AS (SELECT *, count(grade) OVER (PARTITION BY config, query_id ORDER BY rank) AS so_far FROM hit),
    m AS (SELECT config, query_id, count(grade) / 10.0::DOUBLE AS precision, count(grade)::DOUBLE / any_value(relevant) AS recall, coalesce(1.0::DOUBLE / min(rank) FILTER (grade IS NOT NULL), 0) AS rr,
        coalesce(sum(so_far::DOUBLE / rank) FILTER (grade IS NOT NULL), 0) / any_value(relevant) AS ap, coalesce(sum(1 / log2(rank + 1)) FILTER (grade IS NOT NULL), 0) / any_value(ib) AS ndcg_binary,
        coalesce(sum((2 ** grade - 1) / log2(rank + 1)) FILTER (grade IS NOT NULL), 0) / any_value(ig) AS ndcg FROM sf JOIN ideal USING (query_id) GROUP BY ALL)"""


_MEASURES = ("precision", "recall", "f1", "rr", "ap", "ndcg_binary", "ndcg")


@register("retrieval_measures", f"{_judged_sql()} SELECT config, query_id, {', '.join(f'round({x}, 6) AS {x}' for x in _MEASURES if x != 'f1')}, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM m")
def _(spark, sf_dir):
    measured = evaluate.measures(*_judged(spark, sf_dir))
    return measured.select("config", "query_id", *(F.round(x, 6).alias(x) for x in _MEASURES))


@register("configuration_summary", f"{_judged_sql()} SELECT config, count(*) AS queries, round(avg(rr), 6) AS rr, round(avg(ap), 6) AS ap, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY config")
def _(spark, sf_dir):
    return evaluate.summary(evaluate.measures(*_judged(spark, sf_dir))).select("config", "queries", *(F.round(x, 6).alias(x) for x in ("rr", "ap", "ndcg")))


@register("configuration_diff", f"""{_judged_sql()}, a AS (SELECT query_id, round(ndcg, 9) AS baseline FROM m WHERE config = 'tfidf'), b AS (SELECT query_id, round(ndcg, 9) AS candidate FROM m WHERE config = 'bm25')
    SELECT query_id, round(coalesce(candidate, 0) - coalesce(baseline, 0), 6) AS delta, CASE WHEN coalesce(candidate, 0) - coalesce(baseline, 0) > 1e-8 THEN 'improved' WHEN coalesce(candidate, 0) - coalesce(baseline, 0) < -1e-8 THEN 'degraded' ELSE 'unchanged' END AS verdict FROM a FULL JOIN b USING (query_id)""")
def _(spark, sf_dir):
    measured = evaluate.measures(*_judged(spark, sf_dir)).withColumn("ndcg", F.round("ndcg", 9))
    return evaluate.compare(measured, "tfidf", "bm25", epsilon=1e-8).select("query_id", F.round("delta", 6).alias("delta"), "verdict")


@register("tie_aware_ndcg", f"""{_judged_sql()}, gr AS (SELECT r.config, r.query_id, round(r.score, 0) AS score, CASE WHEN grade IS NULL THEN 0 ELSE 2 ** grade - 1 END AS gain FROM runs r LEFT JOIN rel USING (query_id, doc_id)),
    pl AS (SELECT *, avg(gain) OVER (PARTITION BY config, query_id, score) AS mean, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, gain DESC) AS up, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, gain) AS down FROM gr)
    SELECT config, query_id, round(coalesce(sum(mean / log2(up + 1)) FILTER (up <= 10), 0) / any_value(ig), 6) AS expected, round(coalesce(sum(gain / log2(down + 1)) FILTER (down <= 10), 0) / any_value(ig), 6) AS least, round(coalesce(sum(gain / log2(up + 1)) FILTER (up <= 10), 0) / any_value(ig), 6) AS most FROM pl JOIN ideal USING (query_id) GROUP BY config, query_id""")
def _(spark, sf_dir):
    runs, qrels = _judged(spark, sf_dir)
    out = evaluate.tie_aware_ndcg(runs.withColumn("score", F.round("score", 0)), qrels)
    return out.select("config", "query_id", *(F.round(x, 6).alias(x) for x in ("expected", "least", "most")))


def _tuned(name: str, kind: str, weight: str, deltas: tuple[float, ...]):
    grid = ", ".join(f"({k1}::DOUBLE, {b}::DOUBLE, {d}::DOUBLE)" for k1 in (0.9, 1.5) for b in (0.4, 0.75) for d in deltas)
    base = _judged_sql().split(", runs AS (")[0]
    rest = _judged_sql()[_judged_sql().index(", g AS (") :]
    runs = f""", grid AS (SELECT 'k1=' || k1 || ' b=' || b || ' d=' || d AS config, * FROM (VALUES {grid}) x(k1, b, d)), sc AS (SELECT config, query_id, doc_id, round(sum({weight}), 6) AS score FROM q JOIN p USING (term) JOIN v USING (term) JOIN dl USING (doc_id) CROSS JOIN s CROSS JOIN grid GROUP BY ALL),
    runs AS (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""

    @register(name, f"{base}{runs}{rest} SELECT config, count(*) AS queries, round(avg(ndcg), 5) AS ndcg, round(avg(ap), 5) AS ap FROM m GROUP BY config")
    def run(spark, sf_dir):
        _, qrels = _judged(spark, sf_dir)
        out = evaluate.tune_bm25(documents_index(spark, sf_dir), benchmark_queries(spark, sf_dir), qrels, [0.9, 1.5], [0.4, 0.75], kind=kind, delta=list(deltas))
        return out.select("config", "queries", F.round("ndcg", 5).alias("ndcg"), F.round("ap", 5).alias("ap"))


_GRID_NORM = "(1 - b + b * dl / avgdl)"
_tuned("tune_bm25", "bm25", f"{IDF} * tf * (k1 + 1) / (tf + k1 * {_GRID_NORM})", (0.0,))
_tuned("tune_bm25_plus", "plus", f"{IDF} * (tf * (k1 + 1) / (tf + k1 * {_GRID_NORM}) + d)", (0.5, 1.0))
_tuned("tune_bm25_l", "l", f"{IDF} * (k1 + 1) * (tf / {_GRID_NORM} + d) / (k1 + tf / {_GRID_NORM} + d)", (0.5,))


@register("bootstrap_interval")
def _(spark, sf_dir):
    measured = evaluate.measures(*_judged(spark, sf_dir))
    return evaluate.bootstrap(evaluate.compare(measured, "tfidf", "bm25").select("query_id", "delta"))


@register("analysis_diff", f"""WITH {TOKENS}, o AS (SELECT doc_id, unnest(list_filter({_RAW}, lambda x: length(x) >= 2)) AS raw FROM documents), k AS (SELECT doc_id, lower(raw) AS term, count(*) AS tf FROM o GROUP BY ALL)
    SELECT doc_id, term, coalesce(p.tf, 0)::BIGINT AS before, coalesce(k.tf, 0) AS after FROM p FULL JOIN k USING (doc_id, term) WHERE coalesce(p.tf, 0) <> coalesce(k.tf, 0)""")
def _(spark, sf_dir):
    a = documents_index(spark, sf_dir).postings.select("doc_id", "term", "tf")
    b = TextIndex(read(spark, sf_dir, "documents"), tokenizer=Tokenizer(fold_diacritics=False)).postings.select("doc_id", "term", "tf")
    return evaluate.analysis_diff(a, b)


@register("golden_baseline")
def _(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return evaluate.golden(runs.where("engine = 'bm25'"), runs.where("engine = 'tfidf'"))


# classification: the language of documents, from their terms; every fourth document is held out

_FOLDS = f"""WITH {TOKENS}, d AS (SELECT doc_id, lang AS category, doc_id % 4 = 0 AS held FROM documents), tr AS (SELECT category, term, sum(tf) AS c FROM p JOIN d USING (doc_id) WHERE NOT held GROUP BY ALL),
    cl AS (SELECT category, count(*)::DOUBLE AS docs FROM d WHERE NOT held GROUP BY ALL), tt AS (SELECT category, sum(c) AS total FROM tr GROUP BY ALL), voc AS (SELECT DISTINCT term FROM tr), vs AS (SELECT count(*)::DOUBLE AS vsize FROM voc), al AS (SELECT sum(docs) AS alldocs FROM cl)"""


_rows: dict[tuple, DataFrame] = {}


def _labelled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _rows:  # a document's language is in its row: its terms needn't be shuffled to meet it
        _rows[key] = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), Tokenizer().terms(F.col("text")).alias("terms")).persist()
    rows = _rows[key]
    return rows.where("doc_id % 4 <> 0"), rows.where("doc_id % 4 = 0")


@register("naive_bayes_counts", f"{_FOLDS} SELECT category, term, c::BIGINT AS c FROM tr WHERE c > 5")
def _(spark, sf_dir):
    return classify.NaiveBayes.train(_labelled(spark, sf_dir)[0]).terms.where("c > 5")


@register("all_naive_bayes_counts")
def _(spark, sf_dir):
    return classify.NaiveBayes.train(_labelled(spark, sf_dir)[0]).terms


def _bayes_sql(term: str, prior: str, terms: str) -> str:
    return f"""{_FOLDS}, h AS (SELECT doc_id FROM d WHERE held), x AS (SELECT doc_id, term, tf FROM p JOIN h USING (doc_id) {terms}),
    sc AS (SELECT h.doc_id, cl.category, {prior} + coalesce(sum(tf * {term}), 0) AS score FROM h CROSS JOIN cl JOIN tt USING (category) CROSS JOIN vs CROSS JOIN al LEFT JOIN x ON x.doc_id = h.doc_id LEFT JOIN tr ON tr.term = x.term AND tr.category = cl.category LEFT JOIN (SELECT term, sum(c) AS g FROM tr GROUP BY term) gg ON gg.term = x.term GROUP BY h.doc_id, cl.category, docs, alldocs)
    SELECT doc_id, category, round(score, 4) AS score FROM sc"""


@register("naive_bayes", _bayes_sql("ln((coalesce(c, 0) + 1) / (total + vsize))", "ln(docs / alldocs)", ""))
def _(spark, sf_dir):
    train, held = _labelled(spark, sf_dir)
    return classify.NaiveBayes.train(train).predict(held).select("doc_id", "category", F.round("score", 4).alias("score"))


@register("complement_naive_bayes", _bayes_sql("-ln((g - coalesce(c, 0) + 1) / ((SELECT sum(total) FROM tt) - total + vsize))", "0.0::DOUBLE", "JOIN voc USING (term)"))
def _(spark, sf_dir):
    train, held = _labelled(spark, sf_dir)
    return classify.NaiveBayes.train(train, complement=True).predict(held).select("doc_id", "category", F.round("score", 4).alias("score"))


@register("classification_measures")
def _(spark, sf_dir):
    train, held = _labelled(spark, sf_dir)
    said = classify.best(classify.NaiveBayes.train(train).predict(held)).select("doc_id", F.col("category").alias("predicted"))
    return evaluate.classification(held.select("doc_id", F.col("category").alias("actual")).join(said, "doc_id"))


@register("telling_terms")
def _(spark, sf_dir):
    return classify.telling_terms(_labelled(spark, sf_dir)[0].select("category", "terms"), 3.0)


@register("centroid_classifier", f"""WITH {_VECTORS}, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e WHERE vec_id % 4 <> 0), m AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL) GROUP BY label),
    sc AS (SELECT a.vec_id AS doc_id, b.label AS category, {_COSINE} AS score FROM e a CROSS JOIN m b WHERE a.vec_id % 4 = 0) SELECT doc_id, category, round(score, 6) AS score, round(exp((score - max(score) OVER (PARTITION BY doc_id)) / 0.1::DOUBLE) / sum(exp(score / 0.1::DOUBLE)) OVER (PARTITION BY doc_id) * exp(max(score) OVER (PARTITION BY doc_id) / 0.1::DOUBLE), 5) AS probability FROM sc""")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("category"), F.col("embedding").alias("v"))
    out = classify.centroid_predict(e.where("doc_id % 4 = 0").select("doc_id", "v"), classify.centroids(e.where("doc_id % 4 <> 0")))
    return out.select("doc_id", "category", F.round("score", 6).alias("score"), F.round("probability", 5).alias("probability"))


_KNN = f"""WITH {_VECTORS}, r AS (SELECT a.vec_id AS doc_id, b.label AS category, b.vec_id AS neighbour, round({_COSINE}, 9) AS score FROM e a CROSS JOIN e b WHERE a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, neighbour) AS rank FROM r WHERE score > 0)"""


@register("nearest_neighbours", f"{_KNN}, w AS (SELECT doc_id, category, sum(score) AS w FROM k WHERE rank <= 5 GROUP BY ALL) SELECT doc_id, category, round(w / sum(w) OVER (PARTITION BY doc_id), 6) AS probability FROM w")
def _(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    labels = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("category"))
    near = vectors.dense(v.where("id % 50 <> 0"), q, 5, digits=9).join(labels, "id").select(F.col("query_id").alias("doc_id"), "category", F.col("id").alias("neighbour"), "score")
    return classify.neighbour_votes(near, 5).withColumn("probability", F.round("probability", 6))


@register("winner_margin", f"{RUNS} SELECT query_id, doc_id, round(CASE WHEN lead(score) OVER w IS NULL OR score <= 0 THEN 1 ELSE 1 - lead(score) OVER w / score END, 6) AS confidence FROM runs WHERE engine = 'bm25' WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id)")
def _(spark, sf_dir):
    return classify.winner_margin(_runs(spark, sf_dir).where("engine = 'bm25'")).select("query_id", "doc_id", F.round("confidence", 6).alias("confidence"))


@register("z_confidence", f"{RUNS}, z AS (SELECT query_id, doc_id, score, avg(score) OVER (PARTITION BY query_id) AS m, stddev_pop(score) OVER (PARTITION BY query_id) AS d FROM runs WHERE engine = 'bm25') SELECT query_id, doc_id, round(1 / (1 + exp(-(CASE WHEN d > 0 THEN (score - m) / d ELSE 0 END))), 6) AS confidence FROM z")
def _(spark, sf_dir):
    return classify.z_confidence(_runs(spark, sf_dir).where("engine = 'bm25'")).select("query_id", "doc_id", F.round("confidence", 6).alias("confidence"))


@register("youden_threshold", """WITH j AS (SELECT round(n_chars / 100.0, 0)::DOUBLE AS score, quality AS hit FROM documents JOIN labels USING (doc_id)), b AS (SELECT score, sum(hit) AS h, count(*) AS n FROM j GROUP BY score), t AS (SELECT sum(hit)::DOUBLE AS hh, count(*)::DOUBLE AS nn FROM j),
    c AS (SELECT score, round(sum(h) OVER w / hh - (sum(n) OVER w - sum(h) OVER w) / (nn - hh), 9) AS j FROM b CROSS JOIN t WINDOW w AS (ORDER BY score DESC)) SELECT score AS threshold, j FROM c ORDER BY j DESC, score DESC LIMIT 1""")
def _(spark, sf_dir):
    judged = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select(F.round(F.col("n_chars") / 100.0, 0).alias("score"), F.col("quality").alias("hit"))
    return classify.youden(judged)


@register("temperature")
def _(spark, sf_dir):
    train, held = _labelled(spark, sf_dir)
    scored = classify.NaiveBayes.train(train).predict(held).join(held.select("doc_id", F.col("category").alias("actual")), "doc_id")
    return classify.fit_temperature(scored.select("doc_id", "category", "score", "actual")).select("temperature", F.round("loss", 6).alias("loss"))


@register("blended_classifier")
def _(spark, sf_dir):
    train, held = _labelled(spark, sf_dir)
    a, b = (classify.NaiveBayes.train(train, complement=x).predict(held) for x in (False, True))
    return classify.blend([(a, 0.6), (b, 0.4)]).withColumn("probability", F.round("probability", 6))


def _model(name: str, make: Callable):
    @register(name)
    def run(spark, sf_dir):
        train, held = _labelled(spark, sf_dir)
        rows = classify.sample(train)
        model = make().train([classify.term_counts(r.terms) for r in rows], [r.category for r in rows])
        return classify.apply_model(held, model)


_model("decision_tree", classify.DecisionTree)
_model("random_forest", classify.RandomForest)
_model("linear_classifier", classify.LinearModel)


@register("divided_corpus")
def _(spark, sf_dir):
    return classify.divide(documents_index(spark, sf_dir).terms.select("doc_id", "terms"), 32, 3)


# hierarchy and graph


@register("hierarchy", """WITH RECURSIVE e AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
    a AS (SELECT child, parent, 1 AS depth FROM e UNION ALL SELECT a.child, e.parent, depth + 1 FROM a JOIN e ON a.parent = e.child) SELECT child AS node, parent AS ancestor, depth::INTEGER AS depth FROM a""")
def _(spark, sf_dir):
    from sparktext.operators.graph import ancestors

    nation, region, customer = (read(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    edges = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    edges = edges.unionByName(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("child"), F.col("n_name").alias("parent")))
    return ancestors(edges)


@register("graph_hops", """WITH e AS (SELECT o_custkey AS a, l_partkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey), k AS (SELECT DISTINCT b FROM e WHERE a = 7) SELECT 0::BIGINT AS query_id, b AS node, 1 AS hops FROM k
    UNION ALL SELECT 0, a, 2 FROM (SELECT DISTINCT -a AS a FROM e WHERE b IN (SELECT b FROM k) AND a <> 7)""")
def _(spark, sf_dir):
    from sparktext.operators.graph import hops

    e = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select((-F.col("o_custkey")).alias("a"), F.col("l_partkey").alias("b")).distinct()
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seeds = spark.createDataFrame([(0, -7)], "query_id long, node long")
    return hops(seeds, both, 2).where("hops > 0")


@register("cover_density", f"""WITH {TOKENS}, a AS (SELECT doc_id, pos FROM tok WHERE term = 'license'), b AS (SELECT doc_id, pos FROM tok WHERE term = 'version')
    SELECT 0::BIGINT AS query_id, doc_id, round(sum(1.0::DOUBLE / far), 6) AS score FROM (SELECT a.doc_id, a.pos, min(abs(a.pos - b.pos)) + 1 AS far FROM a JOIN b USING (doc_id) GROUP BY ALL) GROUP BY doc_id""")
def _(spark, sf_dir):
    return scoring.cover_density(documents_index(spark, sf_dir), literal_queries(spark, "license version")).withColumn("score", F.round("score", 6))


@register("reformulated_search")
def _(spark, sf_dir):
    return expand.reformulated(documents_index(spark, sf_dir), "lisence idoit")


@register("expanded_index")
def _(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return expand.expanded_index(index, expand.co_occurrence(index)).terms.select("doc_id", "dl")


@register("tie_summary")
def _(spark, sf_dir):
    runs, qrels = _judged(spark, sf_dir)
    return evaluate.tie_summary(evaluate.tie_aware_ndcg(runs.withColumn("score", F.round("score", 0)), qrels))


@register("tune_bm25_va")
def _(spark, sf_dir):
    index, q = documents_index(spark, sf_dir), benchmark_queries(spark, sf_dir)
    return evaluate.tune_scorers(index, q, {f"k1={k} b={b}": scoring.bm25_va(k, b) for k in (0.9, 1.5) for b in (0.4, 0.75)}, _judged(spark, sf_dir)[1])


@register("class_specific")
def _(spark, sf_dir):
    train, held = _labelled(spark, sf_dir)
    return classify.class_specific(train, held, 2.0).withColumn("probability", F.round("probability", 6))


#: By a polynomial over GF(2): CRC-32 of the id's digits, bit by bit.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END))"


@register("held_out_split", f"SELECT doc_id, xor({_CRC}, 4294967295::BIGINT) % 1000 < 250 AS held_out FROM documents")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", evaluate.held_out(F.col("doc_id"), 0.25).alias("held_out"))


@register("confusion", """SELECT quality AS actual, toxic AS predicted, count(*) AS count FROM labels GROUP BY ALL""")
def _(spark, sf_dir):
    return evaluate.confusion(read(spark, sf_dir, "labels").select(F.col("quality").alias("actual"), F.col("toxic").alias("predicted")))


@register("windowed_events", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS starts, event_type, count(*) AS count FROM events GROUP BY ALL")
def _(spark, sf_dir):
    from sparktext.streaming import incremental

    return incremental.windowed_counts(read(spark, sf_dir, "events")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("starts"), "event_type", "count")
