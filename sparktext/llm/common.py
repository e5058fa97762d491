"""Helpers shared by the operators: stable tables, Arrow batches, word hashes."""

from __future__ import annotations

import ctypes
import platform
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
SLICE = 512
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. The session names it; a folder of our own serves only where it doesn't, and all executors are on this machine."""
    if path := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='sparktext-')}")
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, it cuts the lineage and outlives executors. What was shuffled for it is dropped when it is there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def scratch(uri: str) -> tuple[FileSystem, str]:
    """A new folder in a shared one, of any file system that pyarrow knows, for what one task spills: (file system, path). The task deletes it; a task that is run again has another."""
    known, path = FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("file:///", "/", 1))
    path = f"{path}/scratch-{uuid.uuid4().hex}"
    known.create_dir(path, recursive=True)
    return known, path


class Kept(dict):
    """What a Python worker keeps for its next tasks, by key. trim() drops what no task has asked for since the last time."""

    every: list[Kept] = []

    def __init__(self):
        super().__init__()
        self.asked = set()
        Kept.every.append(self)

    def of(self, key, make: Callable):
        self.asked.add(key)
        if key not in self:
            self[key] = make()
        return self[key]

    def drop(self) -> None:
        for key in self.keys() - self.asked:
            del self[key]
        self.asked.clear()


def trim() -> None:
    """At the end of a task, gives memory back to the system, and what earlier operators kept: Python workers live on, and share an executor's memory."""
    for kept in Kept.every:
        kept.drop()
    pa.default_memory_pool().release_unused()
    if platform.libc_ver()[0] == "glibc":
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """One output batch for each slice of an Arrow batch: few texts are in memory as Python's at once. (Spark bounds an Arrow batch by its bytes.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, SLICE):
                    if (out := fn(batch.slice(i, SLICE))) is not None:
                        yield out
        finally:
            trim()

    return df.mapInArrow(run, schema)


def unused(stem: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case of letters."""
    taken, name = {c.lower() for f in frames for c in f.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def among(df: DataFrame, column: str, ids: DataFrame, n: int, most_words: int = 1 << 20) -> DataFrame:
    """The rows of df whose id may be among ids (one column, n rows or fewer), and about one in 16 of the others: what isn't wanted needn't be shuffled.

    A bitmap of hashes, 16 bits for an id, is broadcast as words of 64 bits; from 16 * n bits beyond most_words on, more of the others pass.
    """
    words = max(1, min(most_words, n // 4))
    word, bits = unused("word", df), unused("bits", df)

    def place(name: str):
        return F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(64 * words))

    def bit(name: str):
        return F.pmod(place(name), F.lit(64))

    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(ids.columns[0]).cast("int"))
    table_ = ids.groupBy(F.floor(place(ids.columns[0]) / 64).alias(word)).agg(F.bit_or(one).alias(bits))
    hit = F.call_function("shiftrightunsigned", F.col(bits), bit(column).cast("int")).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(table_), F.floor(place(column) / 64) == F.col(word)).where(hit).select(*(df[c] for c in df.columns))


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def as_docs(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator reads: what else the table has, and under which names, doesn't matter."""
    return docs.select(*(docs[c] for c in ("doc_id", *columns)))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def crc_of_id(name: str = "doc_id"):
    return F.crc32(F.col(name).cast("string").cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for those seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_POWERS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of runs of n words, sorted; of the whole sequence where it is shorter; none without words."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    k = len(hashes) - n + 1
    out = hashes[:k] * _POWERS[0]
    for i in range(1, n):
        out += mix64(hashes[i : i + k] + _POWERS[i])
        out *= _POWERS[i]
    return np.unique(mix64(out + U64(n)))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()
