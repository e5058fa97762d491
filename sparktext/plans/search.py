"""The facade: documents of any columns as a search index."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktext.functions.words import Tokenizer, enriched
from sparktext.operators import facets, query, scoring
from sparktext.operators.index import TextIndex


@dataclass
class SearchIndex:
    """A DataFrame as an index: which columns are the id, the text, fields with weights, and the context put before texts.

    synonyms: (term, other) adds other to queries with term, one step.
    """

    documents: DataFrame
    id: str = "doc_id"
    text: str = "text"
    tokenizer: Tokenizer = field(default_factory=Tokenizer)
    field_weights: dict[str, float] = field(default_factory=dict)
    context: tuple[str, ...] = ()
    synonyms: tuple[tuple[str, str], ...] = ()
    scorer: scoring.Scorer = field(default_factory=scoring.bm25)

    def __post_init__(self):
        column = enriched(F.col(self.text), [F.col(c) for c in self.context]) if self.context else None
        self.index = TextIndex(self.documents, self.id, self.text, self.tokenizer, tuple(self.field_weights), column)
        for a, b in self.synonyms:
            if len(query.tokenize(a)) != 1 or len(query.tokenize(b)) != 1:
                raise ValueError(f"a synonym is one term: {a}, {b}")

    def _widened(self, text: str) -> str:
        q = query.parse(text, tuple(self.field_weights))
        more = [b for a, b in self.synonyms if query.tokenize(a)[0] in q.terms and b not in q.terms]
        return " ".join([text, *more])

    def matches(self, text: str, where=None) -> DataFrame:
        """doc_id, score of all matches that pass a condition on the documents' columns."""
        if self.field_weights and not query.parse(text, tuple(self.field_weights)).features:
            one = self.documents.sparkSession.createDataFrame([(0, self._widened(text))], "query_id long, text string")
            hits = scoring.bm25_f(self.index, one, self.field_weights).select("doc_id", "score")
        else:
            hits = query.search(self.index, self._widened(text), None if self.field_weights else self.scorer, field_weights=self.field_weights)
        if where is not None:
            hits = hits.join(self.documents.where(where).select(F.col(self.id).alias("doc_id")), "doc_id", "left_semi")
        return hits

    def search(self, text: str, limit: int = 10, offset: int = 0, least: float | None = None, where=None) -> DataFrame:
        """The page, with the documents' columns: these are joined to the page alone."""
        page = scoring.page(self.matches(text, where).withColumn("query_id", F.lit(0)), limit, offset, least, digits=6).drop("query_id")
        return page.join(self.documents.withColumnRenamed(self.id, "doc_id"), "doc_id").orderBy("rank")

    def search_with_facets(self, text: str, fields: list[str], limit: int = 10) -> tuple[DataFrame, DataFrame]:
        """The page, and counts of fields over all matches."""
        hits = self.matches(text)
        matched = self.documents.join(hits.select(F.col("doc_id").alias(self.id)), self.id, "left_semi")
        return self.search(text, limit), facets.categorical(matched, fields)

    def explain(self, text: str, doc_id) -> DataFrame:
        one = self.documents.sparkSession.createDataFrame([(0, text)], "query_id long, text string")
        return scoring.explain(self.index, one, self.scorer).where(F.col("doc_id") == doc_id)

    def describe(self, text: str) -> DataFrame:
        one = self.documents.sparkSession.createDataFrame([(0, text)], "query_id long, text string")
        return self.index.describe(scoring.query_terms(self.index, one).select("query_id", "term"))

    def cost(self, text: str) -> int:
        """Postings that a query reads, for routing."""
        terms = query.parse(text).terms
        return self.index.vocabulary.where(F.col("term").isin(terms)).agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
