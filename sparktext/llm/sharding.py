"""Sharding by histogram sort, with DataFrame operations only.

Rows are ordered by a hash of their text and, within a hot text, by doc_id, so that equal texts are neighbours. For each
boundary between shards the driver knows the range of keys in which it lies; a round counts the exact bytes of all
partitions between candidate keys in these ranges, and keeps the range in which the target lies. When the ranges hold one
key each, the splitters are exact, and rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_docs, written

FIRST_BITS, NEXT_BITS = 12, 8
_SUBS = 64


@dataclass
class _Range:
    """Where a boundary lies: keys of group with this prefix of so many bits. below: bytes of the group's smaller keys."""

    target: float
    group: int = 0
    prefix: int = 0
    bits: int = 0
    below: int = 0


def _refine(keys: DataFrame, ranges: list[_Range], width: int) -> None:
    """Rounds of counting until each range is one key. keys: g (a group), k (an unsigned number of width bits, in a long), size.

    A round counts the bytes of the candidate keys within all open ranges at once: 2^12 at first, then 2^8 for each range.
    """
    old = 0
    while open_ := [r for r in ranges if r.bits < width]:
        bits = min(width, old + (NEXT_BITS if old else FIRST_BITS))
        wanted = sorted({(r.group, r.prefix) for r in open_})
        rows = keys
        if old:
            here = F.shiftright("k", width - old)
            rows = keys.where(F.col("g").isin(sorted({g for g, _ in wanted})) & here.isin(sorted({p for _, p in wanted})))
        counted = rows.groupBy("g", F.shiftright("k", width - bits).alias("p")).agg(F.sum("size").alias("bytes"), F.min("k").alias("least"), F.max("k").alias("most"))
        found: dict[tuple[int, int], list[tuple]] = {}
        for g, p, n, least, most in sorted(map(tuple, counted.collect())):
            found.setdefault((g, p >> (bits - old)), []).append((p, int(n), least, most))
        for r in open_:
            probes = found[r.group, r.prefix]
            for p, n, least, most in probes:
                r.prefix, r.bits = (p, bits) if least != most else (least, width)
                if r.below + n >= r.target or p == probes[-1][0]:
                    break
                r.below += n
        old = bits


def slim(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and a key of 62 bits, the same for equal texts; null texts are as empty ones."""
    text = F.coalesce("text", F.lit(""))
    data = text.cast("binary")
    key = F.shiftrightunsigned(F.xxhash64(data), 2)
    return as_docs(docs, "text").select("doc_id", (F.octet_length(data).cast("long") + 16).alias("size"), F.crc32(data).alias("text_crc32"), key.alias("k"))


def _at_least(k: Column, d: Column, splitter: tuple[int, int | None]) -> Column:
    key, doc = splitter
    return (k >= key) if doc is None else (k > key) | ((k == key) & (d >= doc))


def by_bytes(docs: DataFrame, shards: int = 40, hot: float = 0.125) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: shards of nearly equal bytes.

    The i-th splitter is that boundary between groups of equal texts, below which nearest to i/shards of all bytes lie. Equal texts
    share a shard, unless they have more than the share hot of a shard's bytes: such a group is split by doc_id. Sizes are
    then equal up to half of the largest whole group, or row, at either end. Repeated rows, which nothing tells apart, are in
    one shard. Null ids come first. Slots run from 0 in each shard. An empty table has no rows.
    """
    low = -(1 << 63)
    rows = written(slim(docs).withColumn("d", F.coalesce("doc_id", F.lit(low))))  # small: four numbers for a document
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = [_Range(i * total / shards) for i in range(1, shards)] if total else []
    _refine(rows.select(F.lit(0).alias("g"), "k", "size"), ranges, 62)
    keys = sorted({r.prefix for r in ranges})
    size_of = {r.k: int(r.bytes) for r in rows.where(F.col("k").isin(keys)).groupBy("k").agg(F.sum("size").alias("bytes")).collect()}  # at most a row for each boundary
    split = {k for k in keys if size_of[k] > hot * total / shards}
    # the nearer end of the group in which the target lies
    splitters: list[tuple[int, int | None]] = [(r.prefix + (r.target - r.below >= size_of[r.prefix] / 2), None) for r in ranges if r.prefix not in split]
    inner = [_Range(r.target - r.below, r.prefix) for r in ranges if r.prefix in split]
    if inner:
        pair = F.shiftrightunsigned(F.col("d").bitwiseXOR(F.lit(low)), 1)  # ids as unsigned numbers, two by two
        _refine(rows.where(F.col("k").isin(sorted(split))).select(F.col("k").alias("g"), pair.alias("k"), "size"), inner, 63)
    for x in inner:
        after = (x.prefix + 1) << 1
        splitters.append((x.group, after - (1 << 63)) if after < 1 << 64 else (x.group + 1, None))
    shard = sum((_at_least(F.col("k"), F.col("d"), s).cast("int") for s in splitters), F.lit(0))
    placed = rows.select("doc_id", "size", "text_crc32", "k", "d", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("d", "k"), F.lit(_SUBS)).cast("int").alias("sub"))
    return _slots(placed, "bytes")


def _slots(placed: DataFrame, law: str) -> DataFrame:
    """Gapless slots: rows are numbered within parts of a shard, and parts begin where the ones before them end."""
    from pyspark.sql import Window

    counts = placed.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("s"), F.col("sub").alias("u"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "sub").orderBy("k", "d", "text_crc32", "size")
    numbered = placed.withColumn("r", F.row_number().over(order))
    out = numbered.join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.col("sub") == F.col("u")))  # at most 64 rows for each shard
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("start") + F.col("r") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
