"""The inverted index as DataFrames: terms of documents, and the statistics on them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktext.functions.words import Tokenizer


@dataclass
class TextIndex:
    """Documents and their terms. All tables are lazy; keep() holds the terms, for an index that answers many queries.

    fields: text columns by name, for a scorer over several fields; the terms of text are under the name "".
    """

    documents: DataFrame
    id: str = "doc_id"
    text: str = "text"
    tokenizer: Tokenizer = field(default_factory=Tokenizer)
    fields: tuple[str, ...] = ()
    text_column: Column | None = None

    @cached_property
    def terms(self) -> DataFrame:
        """doc_id, terms (in order), dl."""
        text = self.text_column if self.text_column is not None else F.col(self.text)
        return self.documents.select(F.col(self.id).alias("doc_id"), self.tokenizer.terms(text).alias("terms")).withColumn("dl", F.size("terms").cast("long"))

    @cached_property
    def field_terms(self) -> DataFrame:
        """doc_id, field, terms, len."""
        each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), self.tokenizer.terms(F.col(f)).alias("terms")) for f in self.fields)))
        return self.documents.select(F.col(self.id).alias("doc_id"), each.alias("x")).select("doc_id", "x.field", "x.terms").withColumn("len", F.size("terms").cast("long"))

    def keep(self) -> TextIndex:
        self.__dict__["terms"] = self.terms.persist()
        return self

    @property
    def tokens(self) -> DataFrame:
        """doc_id, dl, pos (from 0, without gaps), term."""
        return self.terms.select("doc_id", "dl", F.posexplode("terms").alias("pos", "term"))

    @property
    def postings(self) -> DataFrame:
        """doc_id, dl, term, tf."""
        return self.terms.select("doc_id", "dl", F.explode("terms").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))

    @property
    def positions(self) -> DataFrame:
        """doc_id, dl, term, tf, positions."""
        return self.tokens.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))

    @property
    def vocabulary(self) -> DataFrame:
        """term, df, cf."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    @property
    def statistics(self) -> DataFrame:
        """One row: n (documents, empty ones too), total (terms), avgdl, avgv (mean of length by distinct terms, of documents that have any)."""
        distinct = F.size(F.array_distinct("terms"))
        return self.terms.agg(
            F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), F.avg("dl").alias("avgdl"), F.avg(F.when(F.col("dl") > 0, F.col("dl") / distinct)).alias("avgv")
        )

    @property
    def field_statistics(self) -> DataFrame:
        """field, avg (mean length over all documents)."""
        return self.field_terms.groupBy("field").agg(F.avg("len").alias("avg"))

    @property
    def field_postings(self) -> DataFrame:
        return self.field_terms.select("doc_id", "field", "len", F.explode("terms").alias("term")).groupBy("doc_id", "field", "len", "term").agg(F.count("*").alias("tf"))

    def postings_of_fields(self, wanted: DataFrame, *keys: str) -> DataFrame:
        """field_postings of the terms (or fields and terms) of a stated set of queries, which is sent to the tasks before anything is counted."""
        rows = self.field_terms.select("doc_id", "field", "len", F.explode("terms").alias("term")).join(F.broadcast(wanted), list(keys))
        return rows.groupBy("doc_id", "field", "len", "term").agg(F.count("*").alias("tf"))

    def field_vocabulary(self, field: str) -> DataFrame:
        """term, df, cf of one field."""
        return self.field_postings.where(F.col("field") == field).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def candidates(self, terms: list[str]) -> DataFrame:
        """Documents with any of the terms."""
        return self.terms.where(F.arrays_overlap("terms", F.array(*map(F.lit, terms)))).select("doc_id")

    def with_prefix(self, prefix: str) -> DataFrame:
        return self.vocabulary.where(F.col("term").startswith(prefix))

    def describe(self, terms: DataFrame) -> DataFrame:
        """terms: query_id, term. term, df, n, idf, share of the documents, absent."""
        found = terms.join(self.vocabulary, "term", "left").crossJoin(self.statistics.select("n"))
        df = F.coalesce("df", F.lit(0))
        return found.select("query_id", "term", df.alias("df"), "n", idf(df, F.col("n")).alias("idf"), (df / F.col("n")).alias("share"), F.col("df").isNull().alias("absent"))


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))
