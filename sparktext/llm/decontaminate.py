"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by up to m // chars_per_edit edits. It is cut into one piece more
than that: a passage within the budget holds at least one piece unchanged. All pieces are sought in one pass (Aho-Corasick);
where one is found, Myers' bit-parallel distance decides on the passage around it.

Text is compared in lower case, all white space as spaces.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, as_docs, batch_of, map_batches, unused

_SPACES = {ord(c): " " for c in "\t\n\r\x0b\x0c\x85\xa0"}
RESULT = "doc_id long, item_id long, distance int, edits_allowed int, start int, stop int"


def normal(text: str | None) -> str:
    """In lower case, with white space as spaces; each code point stays one."""
    return (text or "").replace("İ", "i").lower().translate(_SPACES)


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the part of text nearest to pattern: the least edit distance, and where its first such part ends. Bit-parallel, on integers as wide as the pattern."""
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & mask  # the text may begin anywhere
        mh = mh << 1 & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Finder:
    """Pieces of the items of one block. Built once in each Python worker."""

    _kept = Kept()

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        self.items = [(i, normal(t)) for i, t in items if t]
        self.budget = [len(t) // chars_per_edit for _, t in self.items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.items):
            n = self.budget[k] + 1
            for p in range(n):
                at, to = len(t) * p // n, len(t) * (p + 1) // n
                pieces.setdefault(t[at:to], []).append((k, at))
        self.find = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.find.add_word(piece, (len(piece), where))
        if pieces:
            self.find.make_automaton()

    @classmethod
    def of(cls, key: str, items: list[tuple[int, str]], chars_per_edit: int) -> Finder:
        if key not in cls._kept:
            cls._kept.clear()
        return cls._kept.of(key, lambda: cls(items, chars_per_edit))

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, edits_allowed, start, stop), the best passage of each item that is there; the first of equals."""
        text = normal(text)
        if not self.items or not text:
            return []
        tried: dict[int, set[int]] = {}
        best: dict[int, tuple[int, int, int]] = {}
        for end, (length, where) in self.find.iter(text):
            for k, at in where:
                start = end - length + 1 - at
                seen = tried.setdefault(k, set())
                if start in seen:
                    continue
                seen.add(start)
                item, e = self.items[k][1], self.budget[k]
                m = len(item)
                if start >= 0 and text.startswith(item, start):
                    found = (0, start, start + m)
                elif k in best and best[k][0] == 0 or not e:
                    continue
                else:
                    # the passage reaches at most e further to either side than the piece's place in the item says
                    low, high = max(0, start - e), min(len(text), start + m + e)
                    distance, stop = myers(item, text[low:high])
                    if distance > e:
                        continue
                    back, length_ = myers(item[::-1], text[low : low + stop][::-1])
                    found = (distance, low + stop - length_ if back == distance else low, low + stop)
                if k not in best or found < best[k]:
                    best[k] = found
        return sorted((self.items[k][0], d, self.budget[k], a, b) for k, (d, a, b) in best.items())


def contamination(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = 15, block_chars: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, distance, edits_allowed, start, stop (code points): the best passage of each test item in each document.

    Items of fewer than chars_per_edit characters must be there exactly; null and empty ones, and items with a null id, are
    passed over. Each block of items, about block_chars long in all, is held against all documents; nothing else is kept by
    executors. Repeated documents are answered row by row; of items that share an id, the best counts. Documents
    without a match have no row.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.length("text") > 0).where(F.col("item_id").isNotNull()).select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    parts = []
    for b in range(blocks):
        rows = sorted((r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect())
        shared, key = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def run(batch: pa.RecordBatch, shared=shared, key=key) -> pa.RecordBatch:
            finder = Finder.of(key, shared.value, chars_per_edit)
            found = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in {x[0]: x for x in reversed(finder.matches(t))}.values()]
            columns = list(zip(*found)) or [()] * 6
            types = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            return batch_of(**{n: pa.array(c, t) for n, c, t in zip(("doc_id", "item_id", "distance", "edits_allowed", "start", "stop"), columns, types)})

        parts.append(map_batches(as_docs(docs, "text"), run, RESULT))
    return reduce(DataFrame.unionByName, parts)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The documents without a match, all their columns. Rows with a null doc_id stay."""
    hit = unused("hit", docs)
    hits = contamination(docs, benchmark, **parameters).select(F.col("doc_id").alias(hit)).distinct()
    return docs.join(hits, docs["doc_id"] == F.col(hit), "left_anti")
