"""Incremental operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparktext.functions.words import Tokenizer
from sparktext.sources.store import SegmentStore


def index_stream(docs: DataFrame, store: SegmentStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Adds a stream of doc_id, text to a store; each batch is journalled and committed. A batch that runs again replaces its documents by themselves."""

    def batch(rows: DataFrame, _: int) -> None:
        store.add(rows.select("doc_id", "text"))
        store.commit()

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def class_counts(labelled: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Running counts by category and term of a stream of category, text and, if it is there, weight: -1 unlearns."""
    w = F.col("weight") if "weight" in labelled.columns else F.lit(1)
    terms = (tokenizer or Tokenizer()).terms(F.col("text"))
    return labelled.select("category", w.alias("w"), F.explode(terms).alias("term")).groupBy("category", "term").agg(F.sum("w").alias("c"))


def ledger(events: DataFrame) -> DataFrame:
    """Running reinforcement by key of a stream of key, weight; forgetting is the opposite weight."""
    return events.groupBy("key").agg(F.sum("weight").alias("weight"))


def feedback(events: DataFrame) -> DataFrame:
    """Running weights by query and document."""
    return events.groupBy("query", "doc_id").agg(F.sum("weight").alias("weight"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Counts by event-time window and key; what is later than late is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(F.count("*").alias("count"))


def prequential(batches: list[DataFrame], train: Callable[[DataFrame], object], predict: Callable[[object, DataFrame], DataFrame]) -> list[tuple[int, int, float]]:
    """Each batch (doc_id, category, terms) is predicted by what was learnt before it, then learnt: (batch, rows, accuracy)."""
    seen, out = None, []
    for i, rows in enumerate(batches):
        if seen is not None:
            said = predict(train(seen), rows.select("doc_id", "terms")).select("doc_id", F.col("category").alias("said"))
            n, hits = rows.join(said, "doc_id", "left").agg(F.count("*"), F.count_if(F.col("said") == F.col("category"))).first()
            out.append((i, n, hits / n if n else 0.0))
        seen = rows if seen is None else seen.unionByName(rows)
    return out
