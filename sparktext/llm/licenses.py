"""License scans: winnowed fingerprints pick candidate templates, banded alignment reports coverage and spans.

Text is compared as words of letters, digits and bytes of other scripts, in lower case. Fingerprints are hashes of 12
characters; of every 6 in a row, the least is kept, so that any 17 shared characters share one. Those of the templates are
an inverted index; where a document shares one, the words around it are aligned with the template's in a band.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, Kept, as_docs, batch_of, map_batches, mix64

K, WINDOW, BAND = 12, 6, 12
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_B = U64(0x9E3779B97F4A7C15)
_B2, _B4 = (U64(pow(int(_B), n, 1 << 64)) for n in (2, 4))

#: (license, notice): wordings by which works name their license.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

#: (license, text): the terms themselves, from files named license[.variant].txt, without what follows the end of the terms.
TEXTS: tuple[tuple[str, str], ...] = tuple((re.sub(r"(\.[23])?\.txt$", "", p.name) if p.name.startswith("BSD") else p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))
TEMPLATES = NOTICES + TEXTS


def folded(text: str | None) -> np.ndarray:
    """Bytes in lower case; all but letters, digits and other scripts are spaces."""
    return _FOLD[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]


def fingerprints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places in data) that winnowing keeps; runs of spaces count as one."""
    space = data == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    if len(at) < K:
        return np.zeros(0, np.uint64), at[:0]
    h1 = data[at].astype(np.uint64) + U64(1)
    h2 = h1[:-1] * _B + h1[1:]
    h4 = h2[:-2] * _B2 + h2[2:]
    h8 = h4[:-4] * _B4 + h4[4:]
    h = mix64(h8[:-4] * _B4 + h4[8:])
    w = min(WINDOW, len(h))
    least = h[: len(h) - w + 1].copy()
    for i in range(1, w):
        np.minimum(least, h[i : i + len(least)], out=least)
    chosen = np.zeros(len(h), bool)
    for i in range(w):
        chosen[i : i + len(least)] |= h[i : i + len(least)] == least
    where = np.flatnonzero(chosen)
    return h[where], at[where]


def align(template: Sequence[bytes], words: Sequence[bytes], shift: int, lo: int = 0, hi: int | None = None) -> tuple[int, int, int]:
    """Most words of the template that are, in order, among words[lo:hi]: (matched, first, last place). The i-th may be at i + shift, give or take BAND.

    Of equals, the one that ends first, and of these the one that begins last.
    """
    width = 2 * BAND + 1
    hi = len(words) if hi is None else hi
    best = [(0, -1, -1)] * (width + 1)
    for i, t in enumerate(template):
        row = [(0, -1, -1)] * (width + 1)
        left = (0, -1, -1)
        at = i + shift - BAND
        for d in range(width):
            cell = best[d + 1]
            if left[0] > cell[0] or left[0] == cell[0] and left[1] >= cell[1]:
                cell = left
            j = at + d
            if lo <= j < hi and words[j] == t:
                n, first, _ = best[d]
                if first < 0:
                    first = j
                if n + 1 > cell[0] or n + 1 == cell[0] and first > cell[1]:
                    cell = (n + 1, first, j)
            row[d] = left = cell
        best = row
    return max(best, key=lambda c: c[0])


class Scanner:
    _kept = Kept()

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [n for n, _ in templates]
        self.words = [_WORD.findall(folded(t).tobytes()) for _, t in templates]
        index: dict[int, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(templates):
            data = folded(text)
            starts = np.array([m.start() for m in _WORD.finditer(data.tobytes())])
            hashes, at = fingerprints(data)
            for h, a in zip(hashes.tolist(), at.tolist()):
                index.setdefault(h, []).append((k, int(np.searchsorted(starts, a, side="right")) - 1))
        self.counts = [Counter(w) for w in self.words]
        self.index, self.hashes = index, np.array(sorted(index), np.uint64)

    @classmethod
    def of(cls, templates: tuple[tuple[str, str], ...]) -> Scanner:
        return cls._kept.of(templates, lambda: cls(templates))

    def passages(self, k: int, words: list[bytes], shift: int, least: float) -> list[tuple[int, int, int]]:
        """(matched, first, last place) of all passages in the band that don't overlap, best first."""
        template, found = self.words[k], []
        open_ = [(max(0, shift - BAND), min(len(words), shift + len(template) + BAND))]
        while open_:
            lo, hi = open_.pop()
            # two bounds of what can match: the words there, and those of them that the template has
            if not template or hi <= lo or (hi - lo) / len(template) < least or (self.counts[k] & Counter(words[lo:hi])).total() / len(template) < least:
                continue
            matched, first, last = align(template, words, shift, lo, hi)
            if matched and matched / len(template) >= least:
                found.append((matched, first, last))
                open_ += [(lo, first), (last + 1, hi)]
        return found

    def scan(self, text: str | None, least: float) -> list[tuple[str, float, int, int]]:
        data = folded(text)
        hashes, at = fingerprints(data)
        hit = np.flatnonzero(self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes) if len(self.hashes) else hashes[:0]
        if not len(hit):
            return []
        spans = [m.span() for m in _WORD.finditer(data.tobytes())]
        starts = np.array([a for a, _ in spans])
        words = [data[a:b].tobytes() for a, b in spans]
        tried, out = set(), set()
        for i in hit.tolist():
            place = max(0, int(np.searchsorted(starts, at[i], side="right")) - 1)
            for k, inside in self.index[int(hashes[i])]:
                if (k, place - inside) in tried:
                    continue
                tried.add((k, place - inside))
                out.update((self.names[k], matched, matched / len(self.words[k]), spans[a][0], spans[b][1]) for matched, a, b in self.passages(k, words, place - inside, least))
        # of passages of a license that overlap, the one with most words
        kept: list[tuple[str, float, int, int]] = []
        for name, _, coverage, a, b in sorted(out, key=lambda x: (-x[1], -x[2], x[3] - x[4], x)):
            if not any(n == name and a < y and x < b for n, _, x, y in kept):
                kept.append((name, coverage, a, b))
        return sorted(kept, key=lambda x: (x[2], x[0]))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least_coverage: float = 0.85) -> DataFrame:
    """doc_id, license, coverage, start, stop (bytes of the UTF-8 text): passages of whole texts that hold at least that share of a template's words.

    Null and empty texts, and texts without such passages, have no rows; repeated rows are answered row by row. The
    templates, a list of the caller's, go to every executor; one without 12 characters finds nothing.
    """
    templates = tuple((n, t) for n, t in templates)
    if (size := sum(len(t) for _, t in templates)) > 10_000_000:
        raise ValueError(f"templates of {size} characters: more than executors are to hold; scan in blocks")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = Scanner.of(templates)
        found = [(i, *s) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in scanner.scan(t, least_coverage)]
        columns = list(zip(*found)) or [()] * 5
        types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
        return batch_of(**{n: pa.array(c, t) for n, c, t in zip(("doc_id", "license", "coverage", "start", "stop"), columns, types)})

    return map_batches(as_docs(docs, "text"), run, "doc_id long, license string, coverage double, start long, stop long")
