"""MinHash near-deduplication with HyperMinHash registers.

A document's set holds its distinct shingles of five words. Each of 80 registers keeps the least of its own hash over the
set, compressed to 16 bits: the count of leading zeros (6) and the mantissa after them (10). Bands of four registers pick
candidates; the share of equal registers, corrected for chance collisions, sorts out the unlikely; the rest is confirmed on
the full sets.

Equal word sequences are one class, with its least doc_id as representative. In each band bucket, first the members are
held against one hub (the member with the least hash, so mostly the same in all bands); then, only where a bucket's members
still are in several components, all pairs across components are. So no link between components is lost, while a group of
thousands of copies takes one comparison for each copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

import xxhash

from .common import U64, WordHashes, among, as_docs, batch_of, map_batches, shingles, trim, words_of, written
from .pairs import components, within_groups

REGISTERS, BAND = 80, 4
MANTISSA = 10
_MULTIPLIERS = np.random.default_rng(20240607).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * U64(2) + U64(1)
_ADDENDS = np.random.default_rng(7).integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_hashes = WordHashes()


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros, at most 53, and the ten bits after the first set bit, of 64-bit numbers."""
    _, exponent = np.frexp((least >> U64(11)).astype(np.float64))  # 53 bits: exact as doubles
    zeros = np.where(least >> U64(11) > 0, 53 - exponent, 53).astype(np.uint64)
    rest = least << (zeros + U64(1))  # without the first set bit
    return ((zeros << U64(MANTISSA)) | (rest >> U64(64 - MANTISSA))).astype(np.uint16)


def registers(items: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), 1024):
        np.minimum(least, (items[i : i + 1024, None] * _MULTIPLIERS[None, :] + _ADDENDS[None, :]).min(0), out=least)
    return compress(least)


def _chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of disjoint sets of n and m are equal: both minima fall in one cell, of 2^-10 of its octave."""
    n, m = np.maximum(n, 1).astype(np.float64), np.maximum(m, 1).astype(np.float64)
    total = np.zeros(np.broadcast(n, m).shape)
    for z in range(54):
        top, low = 2.0**-z, 2.0 ** -(z + 1)
        middle, width = (top + low) / 2, (top - low) / 2**MANTISSA
        # density of a minimum of n uniform numbers at x: n (1 - x)^(n - 1)
        total += 2**MANTISSA * (n * (1 - middle) ** (n - 1) * width) * (m * (1 - middle) ** (m - 1) * width)
    return np.minimum(total, 0.5)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity of sets of n and m items with registers a and b (rows)."""
    same = (a == b).mean(-1)
    chance = _chance(n, m)
    return np.clip((same - chance) / (1 - chance), 0, 1)


class Sets(dict):
    """Shingles, and a hash of the words, of texts, kept for those seen lately: a text comes again with each of its hubs."""

    def __init__(self, most_words: int = 1 << 20):
        super().__init__()
        self.most, self.held = most_words, 0

    def __missing__(self, text: str | None) -> tuple[np.ndarray, bytes]:
        if self.held > self.most:
            self.clear()
            self.held = 0
        words = words_of(text)
        self.held += len(words)
        out = self[text] = shingles(_hashes.of(words)), xxhash.xxh3_128_digest(b" ".join(words))
        return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, sequence (a 128-bit hash of the words), n_shingles, registers (160 bytes) of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sizes, regs = [], [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            items = shingles(_hashes.of(words))
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
            sizes.append(len(items))
            regs.append(registers(items).tobytes() if len(items) else None)
        return batch_of(doc_id=batch.column(0), sequence=pa.array(keys, pa.binary()), n_shingles=pa.array(sizes, pa.int64()), registers=pa.array(regs, pa.binary()))

    return map_batches(as_docs(docs, "text"), run, "doc_id long, sequence binary, n_shingles long, registers binary")


def _buckets(reps: DataFrame) -> DataFrame:
    """key, band, id, a (the hub) of the buckets of several members; a bucket's key stands for the band and its registers."""
    keys = F.array(*(F.xxhash64(F.lit(b), F.substring("registers", 2 * BAND * b + 1, 2 * BAND)) for b in range(REGISTERS // BAND)))
    bucket = Window.partitionBy("key")
    hub = F.min(F.struct(F.xxhash64("id").alias("h"), "id")).over(bucket).getField("id")
    return reps.select("id", F.posexplode(keys).alias("band", "key")).select("key", "band", "id", hub.alias("a"), F.count("*").over(bucket).alias("size")).where("size > 1").drop("size")


def _confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= percent * union. Groups of one a stream by: its set, then those of its partners. Of a doc_id with several texts, any will do."""
    wanted = pairs.select(F.col("b").alias("id"), F.col("a").alias("hub")).unionByName(pairs.select(F.col("a").alias("id"), F.col("a").alias("hub")).distinct())
    # a hub of many partners is spread over parts, about 1,000 in each, with the hub's own text
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / 1000).alias("parts")).select(F.col("a").alias("hub"), "parts")
    wanted = wanted.join(sizes, "hub")
    own = wanted.where("id = hub").select("id", "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    placed = wanted.where("id <> hub").select("id", "hub", F.pmod(F.xxhash64("id"), "parts").alias("part")).unionByName(own)
    texts = among(as_docs(docs, "text"), "doc_id", wanted.select("id"), 2 * pairs.count()).join(placed, F.col("doc_id") == F.col("id")).select("hub", "part", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mine, seen = None, [], set()
        sets = Sets()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                found = []
                for hub, part, own_, doc, text in zip(*(c.to_pylist() for c in batch.slice(k, 512).columns)):
                    if (hub, part) != group:
                        group, mine, seen = (hub, part), [], set()
                    items, key = sets[text]
                    if own_ == 0:
                        if key not in seen:  # repeated rows teach nothing
                            seen.add(key)
                            mine.append(items)
                        continue
                    for set_ in mine:
                        if 100 * min(len(set_), len(items)) < percent * max(len(set_), len(items)):
                            continue
                        both = len(np.intersect1d(set_, items, assume_unique=True))
                        if both and 100 * both >= percent * (len(set_) + len(items) - both):
                            found.append((hub, doc))
                            break
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])
        trim()

    ordered = texts.withColumn("own", (F.col("id") != F.col("hub")).cast("int")).select("hub", "part", "own", "id", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ordered.repartition(parts, "hub", "part").sortWithinPartitions("hub", "part", "own", "id").mapInArrow(run, "a long, b long")


def _likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs whose estimate is at least so much."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
        hit = np.flatnonzero(estimate(ra, rb, na, nb) >= least)
        return batch_of(a=batch.column(0).take(pa.array(hit)), b=batch.column(1).take(pa.array(hit)))

    # the same pair comes again where an id has several texts
    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ra", "rb"), run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, slack: float = 0.25) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for every row.

    Documents are linked if 100 * intersection >= percent * union of their sets; component_id is the least doc_id that can
    be reached, kept is doc_id = component_id. Texts without words have empty sets and no links. Rows with a null doc_id are
    on their own (component_id null, kept). Repeated rows are answered row by row; of several texts under one doc_id, any may
    link it, and all are of one component, whatever the order of the rows.

    A pair at 0.85 shares none of the 20 bands with a chance of 4e-7, and is as far as slack below its estimate with one of
    1e-9: this is the loss that the method allows.
    """
    sigs = written(signatures(docs))
    full = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("sequence").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = written(classes)
    reps = classes.select("id", "n", "registers")
    buckets = written(_buckets(reps))
    # the classes that one doc_id has texts of are linked from the outset
    several = full.groupBy("doc_id").agg(F.min("sequence").alias("x"), F.max("sequence").alias("y")).where("x <> y").select("doc_id")
    own = full.join(several, "doc_id", "left_semi").select("doc_id", "sequence").distinct().join(classes.select("sequence", "id"), "sequence")
    own = written(own.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b"))
    stars = written(_likely(buckets.where("id <> a").select("a", F.col("id").alias("b")).distinct(), reps, percent / 100 - slack))
    links = written(_confirmed(docs, stars, percent)).unionByName(own)
    first = written(components(links))

    # buckets whose members are still apart
    placed = buckets.join(first, "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("component"))
    apart = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    members = placed.join(apart, "key").join(reps.select("id", "n", "registers"), "id")
    least = percent / 100 - slack

    def compare(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        """Likely pairs across components whose first band in common is this one: each pair comes from one bucket."""
        right = a if b is None else b
        ra, rb = (np.frombuffer(b"".join(x["registers"]), np.uint16).reshape(-1, REGISTERS) for x in (a, right))
        band = int(a["band"].iloc[0])
        before_a, before_b = (r.view(np.uint64)[:, :band] for r in (ra, rb))
        ids, others, ca, cb = a["id"].to_numpy(), right["id"].to_numpy(), a["component"].to_numpy(), right["component"].to_numpy()
        na, nb = a["n"].to_numpy(), right["n"].to_numpy()
        out = []
        for k in range(len(a)):
            hit = np.flatnonzero(cb != ca[k])
            if b is None:
                hit = hit[hit > k]
            if len(hit):
                hit = hit[~(before_b[hit] == before_a[k]).any(1)]
            if len(hit):
                hit = hit[(rb[hit] == ra[k]).sum(1) >= least * REGISTERS]
            if len(hit):
                hit = hit[estimate(ra[k][None, :], rb[hit], na[k : k + 1], nb[hit]) >= least]
            if len(hit):
                out.append(np.stack([np.minimum(others[hit], ids[k]), np.maximum(others[hit], ids[k])], 1))
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), np.int64), columns=["a", "b"])

    across = within_groups(members, compare, "a long, b long")
    tried = written(across.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti").distinct())
    if not tried.isEmpty():
        links = links.unionByName(written(_confirmed(docs, tried, percent)))
        first = written(components(links))
    of_class = classes.join(first, "id", "left").select("sequence", F.coalesce("component", "id").alias("component"))
    out = sigs.join(of_class, "sequence", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
