"""A training-data pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktext.llm import bpe, decontaminate, minhash, suffix, toxicity
from sparktext.llm.common import table, unused, written
from sparktext.llm.queries import vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic. All labels may teach."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (a similarity of 0.8 or more), the document with the smallest doc_id."""
    gone = unused("gone", docs)
    copies = minhash.near_duplicates(docs, percent=80).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(copies, docs["doc_id"] == F.col(gone), "left_anti")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 bytes or more that an earlier one has."""
    return suffix.deduplicated(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, give or take its error budget."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.round_trip(docs, *vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmarks),
    ("byte_bpe", tokenized),
]

#: Neither nearest neighbours with calibrated votes nor near copies by sets of shingles, in chains, are for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, each written and read again."""
    return reduce(lambda docs, stage: written(stage[1](spark, docs, sf_dir)), STAGES, table(spark, sf_dir, "documents"))
