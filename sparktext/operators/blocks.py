"""Rows held against a stated set of queries block by block in numpy, each task keeping its best: no pair of rows is made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Scores of a block of rows by queries that are in memory at once.
CELLS = 1 << 21


def rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Halves away from 0."""
    return x if digits is None else np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x)


def places(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids; null comes first."""
    if ids.dtype != object:
        return ids
    order = {x: i for i, x in enumerate(sorted(set(ids.tolist()), key=lambda x: (x is not None, x)))}
    return np.fromiter((order[x] for x in ids), np.int64, len(ids))


def ids_of(column: pa.Array) -> np.ndarray:
    if column.null_count or not pa.types.is_integer(column.type):
        out = np.empty(len(column), object)
        out[:] = column.to_pylist()
        return out
    return column.to_numpy(zero_copy_only=False)


class Best:
    """The best k rows of each of n queries so far, by score, then by id; NaN is above all."""

    def __init__(self, n: int, k: int, digits: int | None):
        self.n, self.k, self.digits = n, k, digits
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), None
        self.least = np.full(n, -np.inf)  # what a row must reach to be among them

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score: as rounded()."""
        fits = ~(score < self.least[query])
        query, score, ids = query[fits], score[fits], ids[fits]
        if not len(query):
            return
        touched = np.zeros(self.n, bool)
        touched[query] = True
        old = touched[self.query]
        q, s = np.concatenate([self.query[old], query]), np.concatenate([self.score[old], score])
        i = ids if self.id is None else np.concatenate([self.id[old], ids])
        order = np.lexsort((places(i), np.where(np.isnan(s), -np.inf, -s), q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        last = rank == self.k - 1
        self.least[q[last]] = np.where(np.isnan(s[last]), np.inf, s[last])
        kept = rank < self.k
        if self.id is not None:
            self.query, self.score, self.id = (np.concatenate([a[~old], b[kept]]) for a, b in ((self.query, q), (self.score, s), (self.id, i)))
        else:
            self.query, self.score, self.id = q[kept], s[kept], i[kept]

    def least_of(self, scores: np.ndarray, first: int, slack: float) -> np.ndarray:
        """For a block (the queries from first on, by rows), what a score must reach to count: by the best so far, or by this block alone. -inf is no score."""
        least = self.least[first : first + len(scores)]
        if scores.shape[1] <= self.k or not np.isneginf(least).any():
            return least
        return np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k] - slack)


def per_task(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, parts: int | None = None, key: str | None = None) -> DataFrame:
    """work on the batches of each task. parts: at most so many tasks; with a key, exactly so many, for a table that few tasks would read."""
    if parts is not None:
        df = df.repartition(parts, key) if key else df.coalesce(parts)
    return df.mapInArrow(work, schema)


def matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Lists of numbers as matrices of float64, by length: rows, values. Lists that are null or hold null have no likeness and are left out."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    values = pc.cast(column.flatten(), pa.float64())
    gaps = np.zeros(len(values) + 1, np.int64)
    if values.null_count:
        np.cumsum(pc.is_null(values).to_numpy(zero_copy_only=False), out=gaps[1:])
    flat = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    whole = (lengths >= 0) & (gaps[begin[1:]] == gaps[begin[:-1]])
    out = {}
    for width in np.unique(lengths[whole]).tolist():
        rows = np.nonzero(whole & (lengths == width))[0]
        out[width] = rows, flat[begin[rows][:, None] + np.arange(width)]
    return out


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first place to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out
