"""Suffix-array deduplication of passages.

Every string of 50 bytes of a document has a key: the least hash of its parts of 12 bytes. Consecutive strings of one key
make a fragment, and fragments go to shards by key, so that equal strings meet, whatever the documents around them. A shard
drops keys that only one document has, sorts the suffixes of what is left by external induced sorting, and reads off the
common-prefix values which strings are equal and the smallest doc_id that each is in. A string that is in an earlier
document is a span to remove; spans come back to their documents, where they are merged.

Fragments overlap, three to four bytes for one of text. So a map task packs those of a shard in compressed blobs: they
are exchanged once, and no text is but at the end, with its spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_docs, mix64, scratch, shared_dir, trim, unused, written
from .induced import sorted_suffixes, words_at

PART = 12
LAST = (1 << 63) - 1  # a null doc_id is after all others
SEVERAL = 255
_READY = b"\xff" * 8  # no compressed blob begins like this
_SPREAD = np.uint32(0x85EBCA6B)
_STRETCH = 1 << 18


def _finished(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of parts from those of their first eight and last four bytes."""
    h = first * np.uint32(0x27D4EB2F) + last
    h ^= h >> np.uint32(15)
    h *= _SPREAD
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE3D)
    return h


def _halves(w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The same of parts given byte by byte."""
    two = [w[i] * np.uint32(0x01000193) + w[i + 1] for i in range(0, PART, 2)]
    four = [two[i] * np.uint32(0x9E3779B1) + two[i + 1] for i in range(0, PART // 2, 2)]
    return four[0] * np.uint32(0xC2B2AE35) + four[1], four[2]


def _windows(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of documents that begin at starts (and end there, last of all) in data: (document, place, size, offset of the key's part, or SEVERAL, hash of the key).

    Some documents are taken at a time, so that arrays, which are many times as large as their texts, are small.
    """
    parts, a = [], 0
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + _STRETCH, side="right")) - 1)
        doc, place, *others = _windows_of(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], length)
        parts.append((doc + a, place + starts[a], *others))
        a = b
    return tuple(map(np.concatenate, zip(*parts)))


def _windows_of(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts = len(data) - PART + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint32)
    wide = data.astype(np.uint32) + np.uint32(1)
    h2 = wide[:-1] * np.uint32(0x01000193) + wide[1:]
    h4 = h2[:-2] * np.uint32(0x9E3779B1) + h2[2:]
    h8 = h4[:-4] * np.uint32(0xC2B2AE35) + h4[4:]
    h = _finished(h8[:parts], h4[8 : 8 + parts])
    w, have, least = length - PART + 1, 1, h
    while have < w:
        step = min(have, w - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    n = len(least)  # strings begin at 0 .. n - 1
    ok = np.zeros(n + 1, bool)
    lows, highs = starts[:-1], np.maximum(starts[1:] - length + 1, starts[:-1])
    marks = np.zeros(len(data) + 2, np.int8)
    np.add.at(marks, lows, 1)
    np.add.at(marks, highs, -1)
    ok[:n] = np.cumsum(marks[:n], dtype=np.int32) > 0
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~ok[:n - 1]
    fresh = np.zeros(n, bool)
    fresh[lows[lows < n]] = True
    first = np.flatnonzero((new | fresh) & ok[:n])
    if not len(first):
        return none, none, none, none, none.astype(np.uint32)
    # a fragment goes on to where the next begins, or where no string begins
    stops = np.flatnonzero(~ok)
    limit = stops[np.searchsorted(stops, first)]
    ends = np.minimum(np.concatenate([first[1:], [n]]), limit)
    key = least[first]
    # where the part with the key's hash is; SEVERAL, if it is in more than one place, or may be
    size = ends - first + length - 1
    most, have = least, 1
    while have < w:
        step = min(have, w - have)
        most = np.maximum(most[: len(most) - step], most[step:])
        have += step
    # of the strings around a part, the greatest key is the part's hash if it is the key of any of them
    inner = h[w - 1 : w - 1 + len(most)] == most
    places = np.flatnonzero(np.concatenate([np.ones(w - 1, bool), inner, np.ones(len(h) - w + 1 - len(most), bool)]))
    offset, times = np.full(len(first), SEVERAL, np.int64), np.zeros(len(first), np.int64)
    few = np.flatnonzero(size <= 2 * length - PART)
    at, stop = np.searchsorted(places, first[few]), np.searchsorted(places, first[few] + size[few] - PART, side="right")
    while len(few):
        there = places[np.minimum(at, len(places) - 1)]
        hit = h[there] == key[few]
        times[few[hit]] += 1
        offset[few[hit]] = there[hit] - first[few[hit]]
        at += 1
        on = at < stop
        few, at, stop = few[on], at[on], stop[on]
    offset[times != 1] = SEVERAL
    return np.searchsorted(starts, first, side="right") - 1, first, size, offset, key


def _planes(a: np.ndarray) -> bytes:
    """The bytes of numbers by significance, which compress better."""
    return a.view(np.uint8).reshape(len(a), -1).T.tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _gather(raw: bytes, at: np.ndarray, sizes: np.ndarray) -> bytes:
    return b"".join([raw[a:b] for a, b in zip(at.tolist(), (at + sizes).tolist())])


class _Blob:
    """Fragments of a map task for one shard."""

    @staticmethod
    def pack(ids, hashes, docs, places, sizes, offsets, codes, raw: bytes) -> bytes:
        parts = [_planes(ids.astype("<i8")), _planes(hashes.astype("<i8")), _planes(np.diff(docs, prepend=0).astype("<u2")), _planes(places.astype("<u4")), _planes(sizes.astype("<u4")), offsets.astype(np.uint8).tobytes(), codes[offsets == SEVERAL].astype("<u4").tobytes(), raw]
        head = np.array([len(p) for p in parts], "<u4").tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))

    def __init__(self, packed: bytes):
        raw = zstandard.ZstdDecompressor().decompress(packed)
        cuts = np.cumsum([32, *np.frombuffer(raw[:32], "<u4")]).tolist()
        p = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        self.ids, self.hashes = _from_planes(p[0], "<i8"), _from_planes(p[1], "<i8")
        self.docs = np.cumsum(_from_planes(p[2], "<u2").astype(np.int64))
        self.places, self.sizes = _from_planes(p[3], "<u4").astype(np.int64), _from_planes(p[4], "<u4").astype(np.int64)
        self.offsets, self.raw = np.frombuffer(p[5], np.uint8).astype(np.int64), p[7]
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.several_codes = np.frombuffer(p[6], "<u4")

    def codes(self) -> np.ndarray:
        """Hashes of keys: read from the text, or as packed where the place isn't one."""
        several = self.offsets == SEVERAL
        at = (self.begins + self.offsets)[~several]
        data = np.frombuffer(self.raw, np.uint8)
        out = np.empty(len(self.sizes), np.uint32)
        out[~several] = _finished(*_halves([data[at + k].astype(np.uint32) + np.uint32(1) for k in range(PART)]))
        out[several] = self.several_codes
        return out

    def hashes_at(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of size bytes from each place on."""
        data, key = np.frombuffer(self.raw, np.uint8), np.zeros(len(at), np.uint64)
        for k in [*range(0, size - 8, 8), size - 8]:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + words_at(data, at + k))
        return key


def _shared(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each key is in several documents."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key)
    k = key[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    several = np.minimum.reduceat(doc[order], starts) != np.maximum.reduceat(doc[order], starts)
    out = np.zeros(len(key), bool)
    out[order] = np.repeat(several, np.diff(np.concatenate([starts, [len(key)]])))
    return out


def _candidates(blobs: list[bytes], length: int) -> np.ndarray:
    """Fragments that may share a string with another document's.

    Two that do share the hash of their key. If its part is in one place of each, it is in the same place of the string, and
    of the string's other length - 12 bytes at least half are on one side of it: so the fragments also share the part with
    that half before it, or after it. Keys of which a fragment has the part in several places are taken as they are.
    """
    half = (length - PART + 1) // 2
    side = {name: ([], [], []) for name in ("before", "after")}  # hash, document, fragment
    keys, docs, anywhere, base = [], [], [], 0
    for b in map(_Blob, blobs):
        doc, several = b.ids[b.docs], b.offsets == SEVERAL
        keys.append(b.codes())
        docs.append(doc)
        anywhere.append(several)
        for name, fits, low in (("before", ~several & (b.offsets >= half), -half), ("after", ~several & (b.offsets + PART + half <= b.sizes), 0)):
            at = np.flatnonzero(fits)
            side[name][0].append(b.hashes_at(b.begins[at] + b.offsets[at] + low, PART + half))
            side[name][1].append(doc[at])
            side[name][2].append(at + base)
        base += len(b.sizes)
    key, doc, several = map(np.concatenate, (keys, docs, anywhere))
    found = np.zeros(len(key), bool)
    for h, d, at in side.values():
        at = np.concatenate(at)
        found[at[_shared(np.concatenate(h), np.concatenate(d))]] = True
    if several.any():
        same = np.isin(key, np.unique(key[several]))
        at = np.flatnonzero(same)
        found[at[_shared(key[at], doc[at])]] = True
    return found


def _repeated(raw: bytes, doc: np.ndarray, place: np.ndarray, size: np.ndarray, key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a document of a smaller id has a fragment with the same bytes."""
    out = np.zeros(len(key), bool)
    at = np.flatnonzero(_shared(key.astype(np.uint64) << np.uint64(32) | size.astype(np.uint64), ids[doc]))
    first, same = {}, []
    for a, b, i in zip(place[at].tolist(), (place + size)[at].tolist(), ids[doc[at]].tolist()):
        fragment = raw[a:b]
        same.append(fragment)
        if i < first.setdefault(fragment, i):
            first[fragment] = i
    out[at] = ids[doc[at]] > np.fromiter(map(first.__getitem__, same), np.int64, len(same))
    return out


def _runs(other: np.ndarray, place: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans (place, stop) merged where they touch, other being where a document's begin: (where runs begin, rows of start and stop). In order of place; stops rise with places."""
    cut = np.flatnonzero(other | np.concatenate([[True], place[1:] > stop[:-1]]))
    ends = np.concatenate([cut[1:], [len(place)]])
    return cut, np.stack([place[cut], stop[ends - 1]], 1)


def _spans_of(ids: np.ndarray, hashes: np.ndarray, doc: np.ndarray, place: np.ndarray, size: np.ndarray) -> bytes:
    """Spans that need no sorting, as they go along with fragments: eight bytes of 255, and numbers."""
    other = np.concatenate([[True], doc[1:] != doc[:-1]])
    cut, spans = _runs(other, place, place + size)
    parts = [np.cumsum(other)[cut] - 1, ids[other], hashes[other], spans.ravel()]
    return _READY + zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(cut), int(other.sum())], "<i8").tobytes(), *(_planes(x.astype("<i8")) for x in parts)]))


def _ready_spans(blob: bytes) -> Iterator[tuple[int, int, bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob[len(_READY) :])
    n, m = np.frombuffer(raw[:16], "<i8").tolist()
    cuts = np.cumsum([16, 8 * n, 8 * m, 8 * m, 16 * n]).tolist()
    doc, ids, hashes, spans = (_from_planes(raw[a:b], "<i8") for a, b in zip(cuts, cuts[1:]))
    spans = spans.reshape(-1, 2).astype("<i4")
    at = np.searchsorted(doc, np.arange(m + 1)).tolist()
    for i, h, a, b in zip(ids.tolist(), hashes.tolist(), at, at[1:]):
        yield i, h, spans[a:b].tobytes()


def _shard(blobs: list[bytes], length: int, folder: tuple[FileSystem, str] | None, memory: int) -> Iterator[tuple[int, int, bytes]]:
    """(doc_id, hash of its text, spans) of what a shard's documents have from earlier ones. spans: pairs of int32."""
    for blob in blobs:
        if blob.startswith(_READY):
            yield from _ready_spans(blob)
    packed = [b for b in blobs if not b.startswith(_READY)]
    blobs.clear()  # the caller's: they needn't be in memory while suffixes are sorted
    if not packed or not (shared := _candidates(packed, length)).any():
        return
    fragments: dict[bytes, int] = {}
    at, which, owners, texts, places = 0, [], [], [], []
    for b in map(_Blob, packed):
        mine = np.flatnonzero(shared[at : at + len(b.sizes)])
        at += len(b.sizes)
        raw = b.raw
        which.append(np.fromiter((fragments.setdefault(raw[x:y], len(fragments)) for x, y in zip(b.begins[mine].tolist(), (b.begins + b.sizes)[mine].tolist())), np.int64, len(mine)))
        owners.append(b.ids[b.docs[mine]])
        texts.append(b.hashes[b.docs[mine]])
        places.append(b.places[mine])
    del packed, b, raw
    which, owners, texts, places = map(np.concatenate, (which, owners, texts, places))
    known, rank = np.unique(owners, return_inverse=True)
    sizes = np.fromiter(map(len, fragments), np.int64, len(fragments))
    first = np.full(len(fragments), len(known), np.int32)
    np.minimum.at(first, which, rank.astype(np.int32))
    # each fragment, its bytes raised by 2, and a 1; then the only 0 (255 and 254 are no bytes of UTF-8, and become these)
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\xff".join([*fragments, b"\xfe"]), np.uint8) + np.uint8(2)
    total = len(text)
    del fragments
    owner = np.repeat(np.concatenate([first, [len(known)]]).astype(np.int32), np.concatenate([sizes + 1, [1]]))
    least = np.full(total, len(known), np.int32)
    tail, tail_least = np.zeros(0, np.int64), len(known)
    for suffixes, lcp in sorted_suffixes(text, length, folder, memory):
        # members of a group have a string of that length in common; one may go on over several blocks
        new = lcp < length
        suffixes = suffixes.astype(np.int64)
        heads = np.flatnonzero(new)
        if len(tail) and (not len(heads) or heads[0] > 0):
            stop = heads[0] if len(heads) else len(suffixes)
            tail = np.concatenate([tail, suffixes[:stop]])
            tail_least = min(tail_least, int(owner[suffixes[:stop]].min()))
        if not len(heads):
            continue
        least[tail] = tail_least
        groups = np.minimum.reduceat(owner[suffixes], heads)
        counts = np.diff(np.concatenate([heads, [len(suffixes)]]))
        least[suffixes[heads[0] :]] = np.repeat(groups, counts)
        tail, tail_least = suffixes[heads[-1] :], int(groups[-1])
    least[tail] = tail_least
    # strings of each copy that an earlier document has
    order = np.lexsort((places, texts, rank))
    for i in range(0, len(order), 200_000):
        part = order[i : i + 200_000]
        strings = sizes[which[part]] - length + 1
        copy = np.repeat(np.arange(len(part)), strings)
        step = np.arange(len(copy)) - np.repeat(np.cumsum(strings) - strings, strings)
        taken = least[begins[which[part]][copy] + step] < rank[part][copy]
        copy, step = copy[taken], step[taken]
        if not len(copy):
            continue
        place = places[part][copy] + step
        r, t = rank[part][copy], texts[part][copy]
        other = np.concatenate([[True], (r[1:] != r[:-1]) | (t[1:] != t[:-1])])
        cut, spans = _runs(other, place, place + length)
        spans = spans.astype("<i4")
        of = np.flatnonzero(other[cut])
        for a, b in zip(of.tolist(), [*of[1:].tolist(), len(cut)]):
            yield int(known[r[cut[a]]]), int(t[cut[a]]), spans[a:b].tobytes()


def repeated_spans(docs: DataFrame, length: int = 50, batch_bytes: int = 6 << 20, shard_bytes: int = 32 << 20, memory: int = 64 << 20) -> DataFrame:
    """doc_id, text_hash, spans (array of binary, of int32 pairs): bytes covered by strings of length bytes that also start in a document with a smaller doc_id.

    A null doc_id is larger than any other. Rows of one doc_id are told apart by the hash of their text.
    """
    spark = docs.sparkSession
    texts = as_docs(docs, "text").select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, round(3.5 * total / shard_bytes))
    shared = shared_dir(spark)

    def pack(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        raw = b"".join(r[2] for r in rows)
        data = np.frombuffer(raw, np.uint8)
        starts = np.cumsum([0, *(len(r[2]) for r in rows)])
        ids, hashes = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        doc, place, size, offset, key = _windows(data, starts, length)
        # of equal fragments of several documents, the first one's is enough for others: the rest of them is repeated as it is
        ready = _repeated(raw, doc, place, size, key, ids)
        if ready.any():
            yield pa.RecordBatch.from_pydict({"shard": pa.array([int(ids[0]) % shards], pa.int32()), "blob": pa.array([_spans_of(ids[doc[ready]], hashes[doc[ready]], doc[ready], place[ready] - starts[doc[ready]], size[ready])], pa.binary())})
            doc, place, size, offset, key = (x[~ready] for x in (doc, place, size, offset, key))
        shard = (((key * _SPREAD) ^ (key >> np.uint32(7))) % np.uint32(shards)).astype(np.uint16 if shards < 1 << 16 else np.uint32)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[s] : cuts[s + 1]]
            used, index = np.unique(doc[mine], return_inverse=True)
            blob = _Blob.pack(ids[used], hashes[used], index, place[mine] - starts[doc[mine]], size[mine], offset[mine], key[mine], _gather(raw, place[mine], size[mine]))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "blob": pa.array([blob], pa.binary())})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                for d, text, h in zip(*(c.to_pylist() for c in batch.slice(i, 1024).columns)):
                    raw = text.encode("utf-8", "surrogatepass")
                    if len(raw) < length:
                        continue
                    if rows and (held + len(raw) > batch_bytes or len(rows) > 60_000):
                        yield from pack(rows)
                        rows, held = [], 0
                    rows.append((d, h, raw))
                    held += len(raw)
        if rows:
            yield from pack(rows)
        rows = []
        trim()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            folder = scratch(shared)
            try:
                rows = []
                for row in _shard(blobs, length, folder, memory):
                    rows.append(row)
                    if len(rows) == 5000:
                        yield _span_batch(rows)
                        rows = []
                if rows:
                    yield _span_batch(rows)
            finally:
                folder[0].delete_dir(folder[1])
                trim()

        at, blobs = None, []
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                for s, blob in zip(*(c.to_pylist() for c in batch.slice(i, 16).columns)):
                    if s != at and blobs:
                        yield from done(blobs)
                        blobs = []
                    at = s
                    blobs.append(blob)
        if blobs:
            yield from done(blobs)

    packed = texts.mapInArrow(split, "shard int, blob binary")
    # beyond so many partitions, a task takes one shard after the other
    spans = packed.repartition(min(shards, 16_384), "shard").sortWithinPartitions("shard").mapInArrow(sort, "doc_id long, text_hash long, spans binary")
    spans = written(spans)
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_list("spans").alias("spans"))


def _span_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    a, b, c = zip(*rows)
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(a, pa.int64()), "text_hash": pa.array(b, pa.int64()), "spans": pa.array(c, pa.binary())})


def merged(spans: list[bytes] | None) -> np.ndarray:
    """Spans as maximal runs: rows of start and stop."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    pairs = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    return np.stack([pairs[first, 0], reach[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(pairs) - 1]])]], 1)


def _kept(raw: bytes, runs: np.ndarray) -> bytes:
    cuts = [0, *runs.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def _with_spans(docs: DataFrame, length: int, columns: list[str], name: str) -> DataFrame:
    """The columns of docs, and a document's spans under that name."""
    at, hash_, there, its = (unused(f"{name}_{x}", docs) for x in ("at", "hash", "doc", "text"))
    spans = repeated_spans(docs, length).select(F.col("doc_id").alias(at), F.col("text_hash").alias(hash_), F.col("spans").alias(name))
    rows = docs.select(*(docs[c] for c in columns), F.coalesce(docs["doc_id"], F.lit(LAST)).alias(there), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias(its))
    return rows.join(spans, (F.col(there) == F.col(at)) & (F.col(its) == F.col(hash_)), "left").select(*columns, name)


def dedup_report(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row: bytes covered by a string of length bytes that starts in a document with a smaller doc_id, too, are removed. Null texts are empty; texts shorter than length stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                ids, sizes, removed, counts, digests = [], [], [], [], []
                for doc, text, spans in zip(*(c.to_pylist() for c in batch.slice(i, 1024).columns)):
                    raw, runs = (text or "").encode("utf-8", "surrogatepass"), merged(spans)
                    ids.append(doc)
                    sizes.append(len(raw))
                    removed.append(int((runs[:, 1] - runs[:, 0]).sum()))
                    counts.append(len(runs))
                    digests.append(hashlib.sha256(_kept(raw, runs)).hexdigest())
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(counts, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    rows = _with_spans(docs, length, ["doc_id", "text"], "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(raw: bytes, runs: np.ndarray) -> np.ndarray:
    """Runs drawn in to whole characters of UTF-8, so that what stays is text."""
    out = []
    for a, b in runs.tolist():
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def deduplicated(docs: DataFrame, length: int = 50) -> DataFrame:
    """docs, all rows and columns, with repeated passages removed from text (whole characters only), and n_chars to match, if there is such a column. Texts that had none, or are null, are as they were."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            text, spans = batch.column(names.index("text")).to_pylist(), batch.column(names.index(own)).to_pylist()
            for k, s in enumerate(spans):
                if s and text[k]:
                    raw = text[k].encode("utf-8", "surrogatepass")
                    text[k] = _kept(raw, whole_characters(raw, merged(s))).decode("utf-8", "surrogatepass")
            columns = {n: batch.column(i) for i, n in enumerate(names) if n not in ("text", own)}
            yield pa.RecordBatch.from_pydict({n: pa.array(text, pa.string()) if n == "text" else columns[n] for n in docs_columns})

    docs_columns, own = docs.columns, unused("spans", docs)
    rows = _with_spans(docs, length, docs_columns, own)
    out = rows.mapInArrow(run, docs.schema)
    if "n_chars" in others:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs_columns)
