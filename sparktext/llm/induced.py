"""External induced suffix sorting with common-prefix values, of one shard.

The suffixes that begin leftmost S-type runs (LMS) are sorted first, by recursion on the names of the substrings between
them. The others are induced: scanning sorted suffixes upwards puts each L-type predecessor in the queue of its first
character, scanning downwards each S-type one. These queues are a priority queue, by character and then by arrival; their
tuples (suffix, common prefix with the one before) are moved to disk when they pass the memory allowed. The common prefix
of two neighbours in a queue is one more than the least among those scanned between their successors.

All steps are done on blocks of tuples. Order and common prefixes are exact up to the depth asked for, not beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyarrow.fs import FileSystem

BLOCK = 1 << 16
_LOG = np.zeros(BLOCK + 2, np.int64)
_LOG[2:] = np.floor(np.log2(np.arange(2, BLOCK + 2))).astype(np.int64)
_TUPLE = np.dtype([("at", "<i4"), ("lcp", "u1")])


class Queues:
    """256 queues of (suffix, lcp), read from the front while they grow, and once more as a whole."""

    def __init__(self, folder: tuple[FileSystem, str] | None, memory: int, name: str):
        self.kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(256)]
        self.spilled: list[list[tuple[int, int, int]]] = [[] for _ in range(256)]  # file, offset, tuples
        self.unread = [0] * 256  # chunks read so far, spilled ones first
        self.folder, self.name, self.files = folder, name, 0
        self.memory, self.held = memory, 0

    def push(self, c: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.kept[c].append((at, lcp))
        self.held += 5 * len(at) + 200
        if self.held > self.memory and self.folder:
            self._spill()

    def _file(self, k: int) -> str:
        return f"{self.folder[1]}/{self.name}-{k}"

    def _spill(self) -> None:
        """Each spill is a file of its own: not every file system appends."""
        end = 0
        with self.folder[0].open_output_stream(self._file(self.files)) as f:
            for c in range(256):
                for at, lcp in self.kept[c]:
                    rows = np.empty(len(at), _TUPLE)
                    rows["at"], rows["lcp"] = at, lcp
                    f.write(rows.tobytes())
                    self.spilled[c].append((self.files, end, len(at)))
                    end += rows.nbytes
                self.kept[c] = []
        self.files += 1
        self.held = 0

    def _chunk(self, c: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k >= len(self.spilled[c]):
            return self.kept[c][k - len(self.spilled[c])]
        file, begin, n = self.spilled[c][k]
        with self.folder[0].open_input_file(self._file(file)) as f:
            rows = np.frombuffer(f.read_at(n * _TUPLE.itemsize, begin), _TUPLE)
        return rows["at"].copy(), rows["lcp"].copy()

    def count(self, c: int) -> int:
        return len(self.spilled[c]) + len(self.kept[c])

    def next(self, c: int) -> tuple[np.ndarray, np.ndarray] | None:
        """What was pushed since, about a block of it."""
        parts, n = [], 0
        while self.unread[c] < self.count(c) and n < BLOCK:
            parts.append(self._chunk(c, self.unread[c]))
            self.unread[c] += 1
            n += len(parts[-1][0])
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else (np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]))

    def all(self, c: int, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks in order, about a block of them at once; backwards, the last block comes first."""
        order = range(self.count(c))
        parts, n = [], 0
        for k in reversed(order) if backwards else order:
            parts.append(self._chunk(c, k))
            n += len(parts[-1][0])
            if n >= BLOCK or k == (0 if backwards else len(order) - 1):
                at, lcp = zip(*(reversed(parts) if backwards else parts))
                yield (np.concatenate(at), np.concatenate(lcp)) if len(parts) > 1 else parts[0]
                parts, n = [], 0


def s_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is less than the next one; the last character must be the only 0."""
    n = len(text)
    step = np.flatnonzero(text[1:] != text[:-1])
    up = text[step + 1] > text[step]
    out = np.ones(n, bool)
    out[: n - 1] = np.repeat(up, np.diff(np.concatenate([[-1], step])))[: n - 1]
    return out


def words_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight characters from each place on, as numbers that compare alike; text must go on for eight."""
    every = np.ndarray((max(0, len(text) - 7),), ">u8", text, strides=(1,))
    return every[at].astype(np.uint64)


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of suffixes, up to depth; text must go on for depth + 8 more."""
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for o in range(0, depth, 8):
        x = words_at(text, a[open_] + o) ^ words_at(text, b[open_] + o)
        same = x == 0
        top = x[~same]
        _, e = np.frexp(top.astype(np.float64))
        # rounding up to a power of two may count one bit too many
        e -= (top >> np.minimum(np.maximum(e - 1, 0), 63).astype(np.uint64)) == 0
        out[open_[~same]] = o + (64 - e) // 8
        out[open_[same]] = o + 8
        open_ = open_[same]
        if not len(open_):
            break
    return np.minimum(out, depth).astype(np.uint8)


def _regroup(rank: np.ndarray, items: np.ndarray, key: np.ndarray) -> None:
    """Splits groups of equal rank (the place of the group's first) by key, for the items of whole groups."""
    r = rank[items]
    if r[0] == r[-1] and (r == r[0]).all():
        order = np.argsort(key)
    elif key.dtype == np.int64 and key.max() < 1 << 31:
        order = np.argsort(r.astype(np.uint64) << np.uint64(32) | (key + 1).astype(np.uint64))
    else:
        order = np.lexsort((key, r))
    r, k = r[order], key[order]
    new_group = np.concatenate([[True], r[1:] != r[:-1]])
    new_key = new_group | np.concatenate([[True], k[1:] != k[:-1]])
    place = np.arange(len(items))
    start = np.maximum.accumulate(np.where(new_group, place, 0))
    first = np.maximum.accumulate(np.where(new_key, place, 0))
    rank[items[order]] = r + (first - start)


def sort_lms(text: np.ndarray, padded: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """LMS suffixes in order, up to depth. Substrings between them are named first; each level of the recursion then names pairs of names, of twice as many substrings."""
    m = len(lms)
    size = np.empty(m, np.int64)
    size[:-1] = lms[1:] - lms[:-1] + 1
    size[-1] = 1
    rank = np.zeros(m, np.int64)
    items, o = np.arange(m), 0
    while len(items):
        key = words_at(padded, lms[items] + o)
        have = np.clip(size[items] - o, 0, 8)
        # beyond its end, a substring is greater than any that goes on
        key |= np.where(have < 8, (np.uint64(1) << (8 * (8 - np.maximum(have, 1))).astype(np.uint64)) - np.uint64(1), np.uint64(0))
        key[have == 0] = np.iinfo(np.uint64).max
        _regroup(rank, items, key)
        o += 8
        items = _tied(rank, size > o, items)
    h = 1
    while True:
        ends = np.minimum(np.arange(m) + h, m)
        reach = np.concatenate([lms, [len(text) + depth]])[ends] - lms
        items = _tied(rank, reach < depth + 1, np.arange(m) if h == 1 else items)
        if not len(items):
            break
        beyond = np.concatenate([rank, [-1]])[ends[items]]
        _regroup(rank, items, beyond)
        h *= 2
    return lms[np.argsort(rank, kind="stable")]


def _tied(rank: np.ndarray, wants: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Items, among whole groups, of groups of several with one that wants more."""
    r = rank[among]
    several = np.bincount(r, minlength=len(rank))[r] > 1
    among, r = among[several], r[several]
    more = np.zeros(len(rank), bool)
    more[r[wants[among]]] = True
    return among[more[r]]


class _Pass:
    """One scan: takes scanned suffixes in order, pushes their predecessors of one type."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: Queues, depth: int):
        self.text, self.wanted, self.queues, self.depth = text, wanted, queues, depth
        self.least = np.zeros(256, np.int64)  # common prefix of what was last pushed, and what was last scanned
        self.empty = np.ones(256, bool)

    def scan(self, at: np.ndarray, lcp: np.ndarray) -> None:
        for i in range(0, len(at), BLOCK):
            self._block(at[i : i + BLOCK], lcp[i : i + BLOCK])

    def _block(self, at: np.ndarray, lcp: np.ndarray) -> None:
        before = at - 1
        chosen = np.flatnonzero((at > 0) & self.wanted[before])
        to_right = np.minimum.accumulate(lcp)
        if not len(chosen):
            self.least = np.minimum(self.least, to_right[-1])
            return
        c = self.text[before[chosen]]
        order = np.argsort(c, kind="stable")
        c, chosen = c[order], chosen[order]
        starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        low = np.empty(len(chosen), np.int64)
        low[1:] = chosen[:-1] + 1
        low[starts] = chosen[starts]
        out = _range_least(lcp, low, chosen)
        heads = c[starts]
        out[starts] = np.minimum(self.least[heads], to_right[chosen[starts]])
        out = np.minimum(out.astype(np.int64) + 1, self.depth)
        out[starts[self.empty[heads]]] = 0
        ends = np.concatenate([starts[1:], [len(c)]])
        to_left = np.concatenate([np.minimum.accumulate(lcp[::-1])[::-1], [255]])
        self.least = np.minimum(self.least, to_right[-1])
        self.least[heads] = to_left[chosen[ends - 1] + 1]
        self.empty[heads] = False
        pushed, out = before[chosen].astype(np.int32), out.astype(np.uint8)
        for x, a, b in zip(heads.tolist(), starts.tolist(), ends.tolist()):
            self.queues.push(x, pushed[a:b], out[a:b])


def _range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high], by a sparse table."""
    k = _LOG[high - low + 1]
    levels = [values]
    for j in range(int(k.max())):
        last, s = levels[-1], 1 << j
        levels.append(np.minimum(last[:-s], last[s:]))
    out = np.empty(len(low), values.dtype)
    for j in np.unique(k):
        at = np.flatnonzero(k == j)
        out[at] = np.minimum(levels[j][low[at]], levels[j][high[at] - (1 << j) + 1])
    return out


def sorted_suffixes(text: np.ndarray, depth: int, folder: tuple[FileSystem, str] | None = None, memory: int = 1 << 27) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (suffixes, common prefixes with the one before, up to depth). Blocks of a first character are in order; first characters go down, and the common prefix at the start of each is 0.

    text: uint8, below 255; its last character is its only 0. folder: a file system and a path in it, for files that are the caller's to delete.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 24, np.uint8)])
    s_type = s_types(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if n == 1:
        lms = np.zeros(1, np.int64)
    lms = sort_lms(text, padded, lms, depth)
    lms_lcp = np.zeros(len(lms), np.uint8)
    lms_lcp[1:] = common(padded, lms[:-1], lms[1:], depth)
    cuts = np.searchsorted(text[lms], np.arange(257))

    def two(a: int, b: int) -> int:
        return int(common(padded, np.array([a]), np.array([b]), depth)[0])

    larger = Queues(folder, memory // 2, "l-type")
    scan = _Pass(text, ~s_type, larger, depth)
    last_of: list[int | None] = [None] * 256
    for c in range(256):
        while part := larger.next(c):
            scan.scan(part[0].astype(np.int64), part[1])
            last_of[c] = int(part[0][-1])
        if (a := cuts[c]) < (b := cuts[c + 1]):
            lcp = lms_lcp[a:b].copy()
            lcp[0] = 0 if last_of[c] is None else two(last_of[c], lms[a])
            scan.scan(lms[a:b], lcp)
    smaller = Queues(folder, memory // 2, "s-type")
    scan = _Pass(text, s_type, smaller, depth)
    for c in range(255, -1, -1):
        least = None
        while part := smaller.next(c):
            scan.scan(part[0].astype(np.int64), part[1])
            least = int(part[0][-1])
        following = 0 if least is None or last_of[c] is None else two(last_of[c], least)
        joint = following
        for at, lcp in larger.all(c, backwards=True):
            down = np.empty_like(lcp)
            down[1:] = lcp[:0:-1]
            down[0] = following
            scan.scan(at[::-1].astype(np.int64), down)
            following = lcp[0]
        for at, lcp in larger.all(c):
            yield at, lcp
        following = joint
        for at, lcp in smaller.all(c, backwards=True):
            up = np.empty_like(lcp)
            up[1:] = lcp[:0:-1]
            up[0] = following
            yield at[::-1], up
            following = lcp[0]
