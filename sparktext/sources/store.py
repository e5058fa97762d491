"""A store of documents and postings in segments, with a journal and tombstones.

A commit writes what was added as a segment of Parquet files, sorted by term, and then a manifest that names all segments
and what was removed; readers follow the latest manifest, so that they see a whole commit or none. What is newer than the
last commit is in the journal.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktext.functions.words import Tokenizer
from sparktext.operators.index import TextIndex

_DOCS = "doc_id long, text string"


class SegmentStore:
    def __init__(self, spark: SparkSession, path: str, tokenizer: Tokenizer | None = None):
        self.spark, self.path, self.tokenizer = spark, path.rstrip("/"), tokenizer or Tokenizer()
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs, self._path = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    # manifests

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def manifest(self) -> dict:
        """segments (name, first sequence), tombstones, sequence of the last commit."""
        if not self._exists("manifests"):
            return {"version": 0, "segments": [], "tombstones": [], "sequence": 0}
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/manifests"))]
        last = max(n for n in names if n.endswith(".json"))
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{last}").collect()))

    def _publish(self, manifest: dict) -> None:
        """Written aside, then renamed: a manifest is there whole or not at all, and of two writers one fails."""
        manifest["version"] += 1
        target, aside = self._path(f"{self.path}/manifests/{manifest['version']:012d}.json"), self._path(f"{self.path}/aside-{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(aside, target):
            raise RuntimeError("another writer has committed")

    # journal

    def _append(self, docs: DataFrame, kind: str) -> None:
        rows = docs.select("doc_id", (F.col("text") if kind == "add" else F.lit(None).cast("string")).alias("text"), F.lit(kind).alias("kind"), F.lit(self._sequence() + 1).cast("long").alias("sequence"))
        rows.write.mode("append").json(f"{self.path}/journal")

    def _sequence(self) -> int:
        pending = self.pending().agg(F.max("sequence")).first()[0]
        return max(self.manifest()["sequence"], pending or 0)

    def pending(self) -> DataFrame:
        """Journal entries after the last commit. A torn line, which holds no document, is passed over."""
        if not self._exists("journal"):
            return self.spark.createDataFrame([], _DOCS + ", kind string, sequence long")
        rows = self.spark.read.schema(_DOCS + ", kind string, sequence long").json(f"{self.path}/journal")
        return rows.where(F.col("doc_id").isNotNull() & (F.col("sequence") > self.manifest()["sequence"]))

    def add(self, docs: DataFrame) -> None:
        """Adds documents; those of an id that is there are replaced."""
        self._append(docs, "add")

    def remove(self, ids: DataFrame) -> None:
        self._append(ids, "remove")

    # segments

    def _read(self, names: list[str], part: str, schema: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{n}/{part}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def _overlay(self) -> DataFrame:
        from pyspark.sql import Window

        last = Window.partitionBy("doc_id").orderBy(F.desc("sequence"), F.col("kind"))
        return self.pending().withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")

    def documents(self) -> DataFrame:
        """Of all segments and the journal, what was not replaced or removed later."""
        m = self.manifest()
        base = self._read(m["segments"], "documents", _DOCS + ", sequence long")
        if m["tombstones"]:
            gone = self._read(m["tombstones"], "ids", "doc_id long, sequence long").groupBy("doc_id").agg(F.max("sequence").alias("gone"))
            base = base.join(gone, "doc_id", "left").where("gone IS NULL OR sequence >= gone").drop("gone")
        overlay = self._overlay()
        return base.join(overlay.select("doc_id"), "doc_id", "left_anti").select("doc_id", "text").unionByName(overlay.where("kind = 'add'").select("doc_id", "text"))

    def postings(self) -> DataFrame:
        """Committed postings of live documents: term, doc_id, dl, tf. A filter on term skips row groups, as segments are sorted by it."""
        m = self.manifest()
        live = self._read(m["segments"], "postings", "term string, doc_id long, dl long, tf long, sequence long")
        if m["tombstones"]:
            gone = self._read(m["tombstones"], "ids", "doc_id long, sequence long").groupBy("doc_id").agg(F.max("sequence").alias("gone"))
            live = live.join(gone, "doc_id", "left").where("gone IS NULL OR sequence >= gone").drop("gone")
        return live.drop("sequence")

    def index(self) -> TextIndex:
        return TextIndex(self.documents(), tokenizer=self.tokenizer)

    def commit(self) -> None:
        """Makes a segment of the journal's additions and a tombstone for all that it replaces or removes."""
        m, overlay = self.manifest(), self._overlay().persist()
        if overlay.isEmpty():
            return
        sequence, name = self._sequence(), uuid.uuid4().hex
        added = overlay.where("kind = 'add'").select("doc_id", "text", F.lit(sequence).cast("long").alias("sequence"))
        added.write.parquet(f"{self.path}/segment-{name}/documents")
        self._write_postings(added.select("doc_id", "text"), sequence, f"{self.path}/segment-{name}/postings")
        overlay.select("doc_id", F.lit(sequence).cast("long").alias("sequence")).write.parquet(f"{self.path}/tombstones-{name}/ids")
        overlay.unpersist()
        self._publish(m | {"segments": [*m["segments"], f"segment-{name}"], "tombstones": [*m["tombstones"], f"tombstones-{name}"], "sequence": sequence})

    def _write_postings(self, docs: DataFrame, sequence: int, path: str) -> None:
        rows = TextIndex(docs, tokenizer=self.tokenizer).postings.withColumn("sequence", F.lit(sequence).cast("long"))
        rows.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.parquet(path)

    def should_merge(self, share: float = 0.01) -> bool:
        """Whether more than this share of stored documents is dead."""
        m = self.manifest()
        stored = self._read(m["segments"], "documents", _DOCS).count()
        return bool(stored) and (stored - self.documents().count()) / stored > share

    def merge(self) -> None:
        """Rewrites all live documents as one segment."""
        self.commit()
        m, name = self.manifest(), uuid.uuid4().hex
        self.documents().withColumn("sequence", F.lit(m["sequence"]).cast("long")).write.parquet(f"{self.path}/segment-{name}/documents")
        self._write_postings(self.documents(), m["sequence"], f"{self.path}/segment-{name}/postings")
        self._publish(m | {"segments": [f"segment-{name}"], "tombstones": []})

    def info(self) -> dict:
        m = self.manifest()
        return {"segments": len(m["segments"]), "documents": self.documents().count(), "pending": self.pending().count(), "sequence": m["sequence"]}


def save_vectors(vectors: DataFrame, path: str, signature: str) -> None:
    """Vectors, and what made them."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame([(signature,)], "signature string").coalesce(1).write.mode("overwrite").json(f"{path}/signature")


def load_vectors(spark: SparkSession, path: str, signature: str, any_signature: bool = False) -> DataFrame:
    found = spark.read.json(f"{path}/signature").first().signature
    if found != signature and not any_signature:
        raise ValueError(f"vectors are of {found}, not {signature}")
    return spark.read.parquet(f"{path}/vectors")


def upserted(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """old, with the rows of new in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
