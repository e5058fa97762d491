"""Query expansion and correction."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import TextIndex, idf
from .scoring import Scorer, best, bm25, page, score


#: Terms whose pairs are counted at once.
BLOCK = 1 << 19


def _windows(lists: pa.Array, window: int, named: list[str] | None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of arrays of terms: distinct terms, in order; in how many windows each is; pairs of places in these (the smaller one first), and in how many windows both are. named: of pairs, those with one of these.

    A window that holds two terms counts for the last places of both in it. So two places count in the windows that begin
    after (later - window) and not after the earlier one, and end before either term comes again.
    """
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    by_name = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[by_name.to_numpy()] = np.arange(len(rank))
    code = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    latest = np.repeat(np.maximum(size - window, 0), size)
    order = np.lexsort((at, code, row))
    again = np.full(len(row), np.iinfo(np.int64).max)
    same = (code[order][1:] == code[order][:-1]) & (row[order][1:] == row[order][:-1])
    again[order[:-1][same]] = at[order[1:][same]]
    last = np.minimum(np.minimum(at, latest), again - window)  # begin of the last window in which a place is its term's last
    single = np.bincount(code, np.maximum(last - np.maximum(at - window + 1, 0) + 1, 0), len(rank)).astype(np.int64)
    terms = coded.dictionary.take(by_name)
    wanted = None if named is None else pc.is_in(terms, value_set=pa.array(named, terms.type)).to_numpy(zero_copy_only=False)
    keys, counts = [], []
    for d in range(1, window):
        x, y = code[:-d], code[d:]
        n = np.minimum(last[:-d], last[d:]) - np.maximum(at[d:] - window + 1, 0) + 1
        good = (row[:-d] == row[d:]) & (x != y) & (n > 0)
        if wanted is not None:
            good &= wanted[x] | wanted[y]
        x, y = x[good], y[good]
        keys.append(np.minimum(x, y) * len(rank) + np.maximum(x, y))
        counts.append(n[good])
    pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(place, np.concatenate(counts), len(pairs)).astype(np.int64)
    return terms, single, pairs // max(1, len(rank)), pairs % max(1, len(rank)), n


def _counted(window: int, named: list[str] | None, single: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        done = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(lists):
            end = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + BLOCK, "right")))
            terms, alone, a, b, n = _windows(lists.slice(first, end - first), window, [] if single else named)
            if single:
                yield pa.RecordBatch.from_arrays([terms, pa.array(alone)], names=["term", "n"])
            else:
                for i in range(0, len(n), 1 << 17):
                    part = slice(i, i + (1 << 17))
                    yield pa.RecordBatch.from_arrays([terms.take(pa.array(a[part])), terms.take(pa.array(b[part])), pa.array(n[part])], names=["a", "b", "n"])
            first = end


def co_occurrence(index: TextIndex, window: int = 8, least_pairs: int = 2, least_windows: int = 2, most_density: float = 0.5, least_pmi: float = 0.0, among: list[str] | None = None) -> DataFrame:
    """a, b, n (windows with both), na, nb, pmi = ln(n W / (na nb)), for a < b (E1). among: only pairs with one of these terms.

    Every window of so many consecutive terms counts each of its terms once. A task counts pairs of places, of which a term
    has as many as the window is long, and not pairs of windows; rare and ubiquitous terms are taken out at the end.
    """
    terms = index.terms.select("terms")
    single = terms.mapInArrow(partial(_counted, window, None, True), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total = terms.where(F.size("terms") > 0).agg(F.coalesce(F.sum(F.greatest(F.size("terms") - window + 1, F.lit(1))), F.lit(0)).alias("W"))
    pairs = terms.mapInArrow(partial(_counted, window, among, False), "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least_pairs)
    # one row of totals
    fit = single.crossJoin(F.broadcast(total)).where((F.col("n") >= least_windows) & (F.col("n") <= most_density * F.col("W")))
    left, right = fit.select(F.col("term").alias("a"), F.col("n").alias("na"), "W"), fit.select(F.col("term").alias("b"), F.col("n").alias("nb"))
    pmi = F.log(F.col("n") * F.col("W") / (F.col("na") * F.col("nb")))
    return pairs.join(left, "a").join(right, "b").withColumn("pmi", pmi).where(F.col("pmi") > least_pmi).select("a", "b", "n", "na", "nb", "pmi")


def expansions(pairs: DataFrame, terms: DataFrame, each: int = 3, most: int = 8, by: str = "n") -> DataFrame:
    """terms: query_id, term. query_id, term, weight: the best associated terms, each weighed by the largest."""
    both = pairs.select("a", "b", "n", "pmi").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "pmi"))
    found = terms.withColumnRenamed("term", "a").join(both, "a").join(terms.select("query_id", F.col("term").alias("b")), ["query_id", "b"], "left_anti")
    w = Window.partitionBy("query_id", "a").orderBy(F.desc(by), "b")
    found = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).groupBy("query_id", "b").agg(F.max(by).alias("value"))
    share = F.col("value") / F.max("value").over(Window.partitionBy("query_id"))
    kept = found.withColumn("weight", share).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), "b")))
    return kept.where(F.col("r") <= most).select("query_id", F.col("b").alias("term"), "weight")


def association_weights(pairs: DataFrame, terms: DataFrame, strength: float = 1.0, centrality: bool = False) -> DataFrame:
    """query_id, term, weight by how far a term goes with the query's others (E5): 1 / (1 + s r), or 1 + s r, over the largest."""
    both = pairs.select("a", "b", "pmi").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "pmi"))
    related = terms.withColumnRenamed("term", "a").join(both, "a").join(terms.select("query_id", F.col("term").alias("b")), ["query_id", "b"]).groupBy("query_id", "a").agg(F.sum(F.greatest("pmi", F.lit(0.0))).alias("r"))
    r = F.coalesce("r", F.lit(0.0))
    w = terms.join(related.withColumnRenamed("a", "term"), ["query_id", "term"], "left").withColumn("w", 1 + strength * r if centrality else 1 / (1 + strength * r))
    return w.select("query_id", "term", (F.col("w") / F.max("w").over(Window.partitionBy("query_id"))).alias("weight"))


def saturating_weights(terms: DataFrame, k3: float = 8.0) -> DataFrame:
    """terms: query_id, term, qtf."""
    w = (k3 + 1) * F.col("qtf") / (k3 + F.col("qtf"))
    return terms.select("query_id", "term", (w / F.max(w).over(Window.partitionBy("query_id"))).alias("weight"))


_ROWS = {"qwerty": ("qwertyuiop", "asdfghjkl", "zxcvbnm"), "azerty": ("azertyuiop", "qsdfghjklm", "wxcvbn"), "bepo": ("bépoèvdljz", "auiectsrnm", "àyxkqghf")}


def damerau(a: str, b: str, layout: str | None = None) -> float:
    """Optimal string alignment distance; by layout, a substitution costs by the way between keys: min(2, 1 + a quarter of it)."""
    keys = {c: (x, y) for y, row in enumerate(_ROWS[layout]) for x, c in enumerate(row)} if layout else {}

    def swap(x: str, y: str) -> float:
        if x == y:
            return 0
        if x in keys and y in keys:
            return min(2.0, 1 + 0.25 * (abs(keys[x][0] - keys[y][0]) + abs(keys[x][1] - keys[y][1]) - 1))
        return 2.0 if layout else 1

    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + swap(a[i - 1], b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def corrections(vocabulary: DataFrame, terms: list[str], most_distance: float = 2.0, layout: str | None = None) -> DataFrame:
    """given, term, df, distance, weight = 1 / (1 + distance): vocabulary terms near each given one, nearest first (E7-E9). The terms, of a query, are few; lengths are compared before distances."""

    @F.pandas_udf("array<struct<given:string,distance:double>>")
    def near(words: pd.Series) -> pd.Series:
        return words.map(lambda w: [(g, float(d)) for g in terms if abs(len(g) - len(w)) <= most_distance and (d := damerau(g, w, layout)) <= most_distance])

    band = vocabulary.where(F.length("term").between(min(map(len, terms)) - int(most_distance), max(map(len, terms)) + int(most_distance)))
    found = band.select("term", "df", F.explode(near("term")).alias("x")).select("x.given", "term", "df", "x.distance")
    return found.withColumn("weight", 1 / (1 + F.col("distance")))


def more_like_this(index: TextIndex, ids: DataFrame, terms: int = 25, limit: int = 10, scorer: Scorer | None = None) -> DataFrame:
    """ids: query_id (of documents). Each one's most frequent terms as a query; the document itself is left out."""
    asked = index.terms.join(ids.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi")
    counts = asked.select("doc_id", F.explode("terms").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("tf"), "term")
    q = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= terms).select(F.col("doc_id").alias("query_id"), "term", F.lit(1).alias("qtf"))
    q = q.withColumn("qlen", F.count("*").over(Window.partitionBy("query_id")))
    return best(index, ids, {"like": scorer or bm25()}, limit, terms=q, others=True).select("query_id", "doc_id", "score", "rank")


def feedback_terms(index: TextIndex, seeds: DataFrame, terms: DataFrame, texts: DataFrame, most: int = 20) -> DataFrame:
    """seeds: query_id, doc_id, score; terms: query_id, term; texts: doc_id, text. Terms to add to a query, from its best documents.

    Priority: (1 + ln tf) idf (1 + the most a sentence with the term has in idf of query terms) (0.5 + 0.5 score / best score).
    """
    stats = index.statistics.select("n")
    words = index.vocabulary.crossJoin(F.broadcast(stats)).select("term", idf(F.col("df"), F.col("n")).alias("idf"))  # one row
    best = F.max("score").over(Window.partitionBy("query_id"))
    seeds = seeds.withColumn("lift", 0.5 + 0.5 * F.col("score") / best)
    sentence = F.posexplode(F.split("text", r"[.!?\n]")).alias("sentence", "s")
    each = seeds.join(texts, "doc_id").select("query_id", "doc_id", "lift", sentence).select("query_id", "doc_id", "lift", "sentence", F.explode(index.tokenizer.terms(F.col("s"))).alias("term"))
    inside = each.join(terms, ["query_id", "term"]).select("query_id", "doc_id", "sentence", "term").distinct().join(words, "term").groupBy("query_id", "doc_id", "sentence").agg(F.sum("idf").alias("context"))
    near = each.join(inside, ["query_id", "doc_id", "sentence"], "left").groupBy("query_id", "doc_id", "lift", "term").agg(F.count("*").alias("tf"), F.max(F.coalesce("context", F.lit(0.0))).alias("context"))
    value = (1 + F.log("tf")) * F.col("idf") * (1 + F.col("context")) * F.col("lift")
    found = near.join(terms, ["query_id", "term"], "left_anti").join(words, "term").groupBy("query_id", "term").agg(F.max(value).alias("priority"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("priority"), "term"))).where(F.col("rank") <= most)


def tf_idf_keywords(index: TextIndex, limit: int = 10) -> DataFrame:
    """doc_id, term, score, rank; equals by first place."""
    first = index.tokens.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.min("pos").alias("first"))
    df = first.groupBy("term").agg(F.count("*").alias("df"))
    scored = first.join(df, "term").crossJoin(F.broadcast(index.statistics.select("n")))  # one row
    scored = scored.withColumn("score", F.round(F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1), 6))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "first"))).where(F.col("rank") <= limit).select("doc_id", "term", "score", "rank")


def text_rank(terms: list[str], limit: int = 10, window: int = 2, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> list[tuple[str, float]]:
    """PageRank over terms that are within window of each other."""
    first = {t: i for i, t in reversed(list(enumerate(terms)))}
    names = sorted(first, key=first.get)
    place = {t: i for i, t in enumerate(names)}
    at = np.fromiter(map(place.__getitem__, terms), np.int64, len(terms))
    edges = [np.stack([at[:-k], at[k:]]) for k in range(1, window) if len(at) > k] or [np.zeros((2, 0), np.int64)]
    a, b = np.concatenate([np.concatenate(edges, 1), np.concatenate(edges, 1)[::-1]], 1)
    apart = a != b
    ends = np.unique(np.stack([a[apart], b[apart]]), axis=1)
    degree = np.bincount(ends[0], minlength=len(names))
    rank = np.full(len(names), 1.0)
    for _ in range(rounds):
        new = (1 - damping) + damping * np.bincount(ends[1], (rank / np.maximum(degree, 1))[ends[0]], len(names))
        moved, rank = np.abs(new - rank).sum(), new
        if moved < tolerance:
            break
    order = sorted(range(len(names)), key=lambda i: (-round(rank[i], 9), i))[:limit]
    return [(names[i], float(rank[i])) for i in order]


def text_rank_keywords(index: TextIndex, limit: int = 10) -> DataFrame:
    """doc_id, term, score, rank."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, t, s, i + 1) for d, ts in zip(frame["doc_id"], frame["terms"]) for i, (t, s) in enumerate(text_rank(list(ts), limit))]
            yield pd.DataFrame(rows, columns=["doc_id", "term", "score", "rank"])

    return index.terms.select("doc_id", "terms").mapInPandas(run, "doc_id long, term string, score double, rank int")


def expanded_index(index: TextIndex, pairs: DataFrame, each: int = 3) -> TextIndex:
    """An index whose documents also hold the terms that go with theirs, most by associated pairs, up to so many."""
    both = pairs.select("a", "b", "n").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    have = index.terms.select("doc_id", F.explode(F.array_distinct("terms")).alias("a"))
    found = have.join(both, "a").join(have.select("doc_id", F.col("a").alias("b")), ["doc_id", "b"], "left_anti").groupBy("doc_id", "b").agg(F.sum("n").alias("n"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "b"))).where(F.col("r") <= each)
    more = best.groupBy("doc_id").agg(F.array_sort(F.collect_list("b")).alias("more"))
    out = TextIndex(index.documents, index.id, index.text, index.tokenizer, index.fields, index.text_column)
    terms = index.terms.join(more, "doc_id", "left").select("doc_id", F.concat("terms", F.coalesce("more", F.array().cast("array<string>"))).alias("terms"))
    out.__dict__["terms"] = terms.withColumn("dl", F.size("terms").cast("long"))
    return out


def reformulated(index: TextIndex, text: str, layout: str | None = None, k: float = 60.0, limit: int = 10) -> DataFrame:
    """doc_id, score: the query and one variant for each term that a vocabulary term corrects, fused by reciprocal ranks."""
    from .fusion import ranked, reciprocal_rank
    from .query import tokenize

    terms = tokenize(text)
    best = corrections(index.vocabulary, terms, 2.0, layout).where("distance > 0")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("given").orderBy("distance", F.desc("df"), "term"))).where("r = 1")
    fixes = {r.given: r.term for r in best.collect()}  # one for each term of the query
    variants = [text, *(" ".join(fixes[t] if x == t else x for x in terms) for t in dict.fromkeys(terms) if t in fixes)]
    spark = index.documents.sparkSession
    asked = spark.createDataFrame(list(enumerate(variants)), "query_id long, text string")
    hits = score(index, asked, bm25()).select(F.col("query_id").cast("string").alias("engine"), F.lit(0).alias("query_id"), "doc_id", "score")
    return page(reciprocal_rank(ranked(hits), k), limit, digits=9).select("doc_id", "score", "rank")
