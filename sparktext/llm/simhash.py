"""Document fingerprints: SimHash of 128 bits.

The terms of a text are its runs of two words (of a text of one word, that word), in lower case; a term that is there n
times weighs 1 + ln n. Each hashed term votes, with its weight, for each bit; a bit is set if more weight is for it than
against it. Texts without words have the fingerprint 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, as_docs, batch_of, map_batches, mix64, words_of, written

BITS = 128
_hashes = WordHashes()


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    h = _hashes.of(words_of(text))
    if len(h) > 1:
        h = mix64(h[:-1] * U64(0x9E3779B97F4A7C15) + mix64(h[1:]))
    found, times = np.unique(h, return_counts=True)
    return found, (1 + np.log(times)).astype(np.float32)


def fingerprint(text: str | None) -> int:
    found, weights = terms(text)
    votes = np.zeros(BITS, np.float64)
    for i in range(0, len(found), 4096):
        part, w = found[i : i + 4096], weights[i : i + 4096]
        lanes = np.stack([mix64(part), mix64(part + U64(0xD1B54A32D192ED03))], 1)
        bits = np.unpackbits(lanes.view(np.uint8), axis=1)
        votes += 2.0 * (w @ bits.astype(np.float32)) - w.sum()
    return int.from_bytes(np.packbits(votes > 1e-4).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def text_of(fp: int) -> str:
    return f"{fp:032x}"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (32 hex digits) of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(doc_id=batch.column(0), fingerprint=pa.array([text_of(fingerprint(t)) for t in batch.column(1).to_pylist()], pa.string()))

    return map_batches(as_docs(docs, "text"), run, "doc_id long, fingerprint string")


def _tables(radius: int) -> list[tuple[int, int]]:
    """(mask of the high, of the low 64 bits) of each table's key: a pair of the radius + 2 blocks."""
    n = radius + 2
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [((blocks[x] | blocks[y]) >> 64, (blocks[x] | blocks[y]) & ((1 << 64) - 1)) for x, y in combinations(range(n), 2)]


def _count(left: np.ndarray, right: np.ndarray | None, table: int, masks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of the others of a group each of its members is near to: (of left, of right), rows being (high, low). A pair counts in the first table in which it meets, and nowhere else."""
    other = left if right is None else right
    mine, theirs = np.zeros(len(left), np.int64), np.zeros(len(other), np.int64)
    step = max(1, (1 << 20) // max(1, len(other)))
    for i in range(0, len(left), step):
        apart = left[i : i + step, None, :] ^ other[None, :, :]
        a, b = np.nonzero(np.bitwise_count(apart).sum(2, dtype=np.uint8) <= radius)
        if right is None:
            a, b = a[(later := b > a + i)], b[later]
        bits = apart[a, b]
        first = np.ones(len(a), bool)
        for high, low in masks[:table]:
            first &= (bits[:, 0] & high | bits[:, 1] & low) != 0
        np.add.at(mine, a[first] + i, 1)
        np.add.at(theirs, b[first], 1)
    return (mine + theirs, theirs) if right is None else (mine, theirs)


def near(prints: DataFrame, radius: int = 6, block: int = 1 << 16) -> DataFrame:
    """fingerprint, representative (the least doc_id that has it), links: how many other fingerprints are at most radius bits apart.

    The bits are cut into radius + 2 blocks; two near fingerprints are equal in at least two of them, so each pair of
    blocks, permuted to the front, keys a table in which they meet. Each table holds a fingerprint once, however many
    documents have it, and a pair is counted in the first table in which it meets: no pairs leave a task. A key that a
    sample of the fingerprints shows to be hot is split into parts of about block fingerprints, each two of which are a
    task of their own. Null ids and fingerprints are left out.
    """
    spark = prints.sparkSession
    masks = np.array(_tables(radius), np.uint64)
    known = prints.where(F.col("doc_id").isNotNull() & F.col("fingerprint").isNotNull())
    first = written(known.groupBy("fingerprint").agg(F.min("doc_id").alias("representative")))
    total = first.count()
    signed = masks.view(np.int64).tolist()
    number = [F.conv(F.substring("fingerprint", i, 16), 16, -10).cast("long") for i in (1, 17)]
    halves = first.select(number[0].alias("high"), number[1].alias("low"))

    def keyed(df: DataFrame) -> DataFrame:
        tables = df.withColumn("t", F.explode(F.array(*(F.lit(i).cast("tinyint") for i in range(len(signed))))))
        high, low = (F.element_at(F.array(*(F.lit(m[i]) for m in signed)), F.col("t").cast("int") + 1) for i in (0, 1))
        return tables.withColumn("key", F.xxhash64("t", F.col("high").bitwiseAND(high), F.col("low").bitwiseAND(low)))

    # at most 1,000 keys of a table have a thousandth of the fingerprints: the list of hot keys is bounded, whatever the input
    sample = keyed(halves.where(F.pmod(F.xxhash64("low", "high"), F.lit(64)) == 0))
    least = max(block // 64, total // 64 // 1000, 1)
    hot = {r.key: -(-64 * r.n // block) for r in sample.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}
    rows = keyed(halves)
    if hot:
        sizes = spark.createDataFrame(list(hot.items()), "key long, parts long")
        rows = rows.join(F.broadcast(sizes), "key", "left").withColumn("mine", F.pmod(F.xxhash64("low", "high"), F.coalesce("parts", F.lit(1))))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
        rows = rows.select("high", "low", "t", F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).alias("key"), (F.col("mine") > F.col("other")).cast("int").alias("side"), (F.col("mine") != F.col("other")).cast("int").alias("two"))
    else:
        rows = rows.select("high", "low", "t", "key", F.lit(0).alias("side"), F.lit(0).alias("two"))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Whole groups of equal keys, many at a time: (key, side, two, table), (high, low)."""
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            high, low, t, key, side, two = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6))
            marks, bits = np.stack([key, side, two, t], 1), np.stack([high, low], 1).view(np.uint64)
            cut = np.searchsorted(key, key[-1]) if len(key) else 0
            if cut or kept and kept[-1][0][-1, 0] != key[0]:
                kept.append((marks[:cut], bits[:cut]))
                yield np.concatenate([m for m, _ in kept]), np.concatenate([b for _, b in kept])
                kept = []
            if len(key):
                kept.append((marks[cut:], bits[cut:]))
        if kept:
            yield np.concatenate([m for m, _ in kept]), np.concatenate([b for _, b in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, bits in groups(b for b in batches if b.num_rows):
            cuts = np.flatnonzero(np.concatenate([[True], marks[1:, 0] != marks[:-1, 0], [True]]))
            links = np.zeros(len(marks), np.int64)
            for a, b in zip(cuts[:-1][(several := np.diff(cuts) > 1)].tolist(), cuts[1:][several].tolist()):
                if marks[a, 2]:
                    middle = a + int(np.searchsorted(marks[a:b, 1], 1))
                    links[a:middle], links[middle:b] = _count(bits[a:middle], bits[middle:b], marks[a, 3], masks, radius)
                else:
                    links[a:b] = _count(bits[a:b], None, marks[a, 3], masks, radius)[0]
            hit = np.flatnonzero(links)
            if len(hit):
                yield batch_of(high=pa.array(bits[hit, 0].view(np.int64)), low=pa.array(bits[hit, 1].view(np.int64)), links=pa.array(links[hit]))

    parts = max(1, -(-total * len(signed) // 2_000_000), int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = rows.repartition(parts, "key").sortWithinPartitions("key", "side").mapInArrow(run, "high long, low long, links long")
    counts = counts.groupBy("high", "low").agg(F.sum("links").alias("links"))
    mine = first.withColumns({"high": number[0], "low": number[1]})
    return mine.join(counts, ["high", "low"], "left").select("fingerprint", "representative", F.coalesce("links", F.lit(0)).alias("links"))


def _edited(text: str, following: str) -> str:
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited texts: the last half of the code points gives way to the first as many (or all) of the next document's, by descending doc_id; the first document follows the last.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts are empty; null ids
    come last; rows of one id are in the order of their texts.

    Documents are exchanged once, by ranges of ids. What a range needs of the next one, its first document, is sent along:
    the driver sees two numbers for each range.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    keyed = as_docs(docs, "text").withColumn("at", F.coalesce("doc_id", F.lit(lowest)))
    parts = max(1, min(10_000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = sorted(set(keyed.approxQuantile("at", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    cuts = np.array(cuts, np.float64)

    def bucket(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.column(0).to_numpy(zero_copy_only=False)
        return batch_of(at=batch.column(0), bucket=pa.array(np.searchsorted(cuts, at.astype(np.float64), side="right"), pa.int32()))

    ends = map_batches(keyed.select("at"), bucket, "at long, bucket int").groupBy("bucket").agg(F.max("at").alias("most")).orderBy(F.desc("bucket")).collect()
    # the first document of each range follows the last one of the range before it, by descending id; the very first follows the very last
    follows = {r.most: ends[i - 1].bucket for i, r in enumerate(ends)}

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts, at = batch.column(0), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        texts_ = texts.to_pylist()
        prints = [text_of(fingerprint(t)) for t in texts_]
        buckets = np.searchsorted(cuts, at.astype(np.float64), side="right")
        copies = [i for i, x in enumerate(at.tolist()) if x in follows]
        rows = list(range(len(texts_))) + copies
        take = pa.array(rows, pa.int64())
        return batch_of(
            bucket=pa.array([*buckets.tolist(), *(follows[int(at[i])] for i in copies)], pa.int32()), extra=pa.array([0] * len(texts_) + [1] * len(copies), pa.int32()),
            at=batch.column(2).take(take), doc_id=ids.take(take), text=pa.array([texts_[i] or "" for i in rows], pa.string()), fingerprint=pa.array([prints[i] for i in rows], pa.string()),
        )

    placed = map_batches(keyed.select("doc_id", "text", "at"), place, "bucket int, extra int, at long, doc_id long, text string, fingerprint string")
    placed = placed.repartitionById(parts, "bucket") if hasattr(placed, "repartitionById") else placed.repartition(parts, "bucket")

    def row(doc: tuple, following: tuple) -> tuple:
        _, _, doc_id, text, mine = doc
        new = _edited(text, following[3])
        fp, changed, other = int(mine, 16), fingerprint(new), int(following[4], 16)
        return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), mine, text_of(changed), likeness(fp, changed), likeness(fp, other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last = None
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = []
                for doc in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns)):
                    if last and last[0] == doc[0]:
                        out.append(row(last, doc))
                    last = None if doc[1] else doc  # of the documents sent along, the first counts
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    ordered = placed.sortWithinPartitions("bucket", "extra", F.desc("at"), "text").select("bucket", "extra", "doc_id", "text", "fingerprint")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def linked(docs: DataFrame, radius: int = 6) -> DataFrame:
    """The rows of edited(), and for each: representative, the least doc_id with its fingerprint; links, how many other fingerprints are within the radius. Rows without an id have neither.

    One changed word moves more bits the shorter the text: of 50 to 150 words 7.7 on average (within 6 bits: 0.35 of such
    edits, within 12: 0.91), of 150 to 400 words 5.1 (0.73, 1.00), of more 2.9 (0.98, 1.00). A radius of 6 takes 28 tables
    with keys of 32 bits, one of 12 takes 91 with keys of 18, in which everything meets from some 10^5 fingerprints on.
    """
    rows = written(edited(docs))
    known = near(rows.select("doc_id", "fingerprint"), radius)
    has_id = F.col("doc_id").isNotNull()
    return rows.join(known, "fingerprint", "left").select(*rows.columns, F.when(has_id, F.col("representative")).alias("representative"), F.when(has_id, F.coalesce("links", F.lit(0))).alias("links"))
