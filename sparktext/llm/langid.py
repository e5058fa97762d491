"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed into phrases: each the longest match, in
the language's text, of what remains; a character unknown there is a phrase of its own. Only letters count, in lower case; all between them is as one space. With n phrases of a text of m
characters against labelled text of length t, the cross entropy is about n log2(t) / m bits; the least wins.

The automata are walked as tables, many stretches of text at once: whole texts are cut into stretches of 256 characters,
and a phrase ends at the end of its stretch, alike for every language.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, as_docs, batch_of, map_batches

STRETCH = 256
_LETTER = re.compile(r"[^\W\d_]")


def suffix_automaton(classes: list[int]) -> list[dict[int, int]]:
    """Transitions of the states; 0 is the root. Class 0 separates texts: it is in no phrase."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in classes:
        if c == 0:
            last = 0
            continue
        if c in nxt[last]:  # after a separator, this may be known already
            q = nxt[last][c]
            if length[last] + 1 == length[q]:
                last = q
                continue
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[last] + 1)
            p = last
            while p != -1 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            last = clone
            continue
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def _letters() -> np.ndarray:
    """1 for each code point that is neither a letter nor a mark, else 0."""
    return np.fromiter((unicodedata.category(chr(c))[0] not in "LM" for c in range(0x110000)), np.uint32, 0x110000)


@dataclass(frozen=True)
class LanguageModel:
    """Labelled text of each language, at most the bounded number of characters; this is what executors get."""

    texts: tuple[tuple[str, tuple[str, ...]], ...]


class Parser:
    """Tables of a model: built once in each Python worker."""

    _kept = Kept()

    def __init__(self, model: LanguageModel, dense: int = 126):
        """Every letter of the labelled text has a class. Each language numbers its own letters, most frequent first: the
        transitions by its first dense ones are a table, those by its others (of large alphabets) are sorted keys."""
        counts = [Counter("".join(texts).lower()) for _, texts in model.texts]
        kept = sorted(c for c in set().union(*counts) if unicodedata.category(c)[0] in "LM")
        self.langs = [lang for lang, _ in model.texts]
        self.pad = len(kept) + 2
        self.lut = _letters()
        for i, c in enumerate(kept):
            self.lut[ord(c)] = i + 2
        self.tables, self.bits = [], []
        for own, (_, texts) in zip(counts, model.texts):
            mine = sorted((c for c in own if c in set(kept)), key=lambda c: (-own[c], c))
            local = np.zeros(self.pad + 1, np.int32)  # 0: a letter that this language's text doesn't have
            local[1] = 1
            for i, c in enumerate(mine):
                local[self.lut[ord(c)]] = i + 2
            first = min(len(mine), dense) + 2  # the first class that isn't in the table; there, first stands for the padding
            width = first + 1
            local[local >= first] += 1
            local[self.pad] = first
            classes = [c for t in texts for c in [*local[self.classes(t)].tolist(), 0]]
            nxt = suffix_automaton(classes)
            to = np.full((len(nxt), width), -1, np.int64)
            rare = {}
            for s, out in enumerate(nxt):
                for c, t in out.items():
                    if c < first:
                        to[s, c] = t
                    else:
                        rare[s * (len(mine) + 4) + c] = t
            ends = to < 0  # the phrase is over; the character begins the next one, or is one itself
            root = np.where(to[0] < 0, 0, to[0])
            more = ends * 1 + (ends & (to[0] < 0)[None, :])
            more[0] = to[0] < 0
            state = np.where(ends, root[None, :], to)
            state[:, first], more[:, first] = 0, 1
            more[0, first] = 0
            keys = np.array(sorted(rare), np.int64)
            self.tables.append((local, width, (state * width + (more << 28)).astype(np.int32).ravel(), len(mine) + 4, keys, np.array([rare[x] for x in keys.tolist()], np.int64)))
            self.bits.append(np.log2(max(2, len(classes))))

    @classmethod
    def of(cls, model: LanguageModel) -> Parser:
        return cls._kept.of(model, lambda: cls(model))

    def classes(self, text: str) -> np.ndarray:
        """A class for each letter (0: one that no labelled text has), and 1 for each run of other characters."""
        found = self.lut[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = found != 1
        keep[1:] |= keep[:-1]
        return found[keep]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (rows) against each language (columns)."""
        arrays = [self.classes(t) for t in texts]
        pieces = np.array([-(-len(a) // STRETCH) for a in arrays], np.int64)
        lanes = np.full((int(pieces.sum()), STRETCH + 1), self.pad, np.uint32)
        at = 0
        for a, n in zip(arrays, pieces):
            if whole := len(a) // STRETCH:
                lanes[at : at + whole, :STRETCH] = a[: whole * STRETCH].reshape(whole, STRETCH)
            if whole < n:
                lanes[at + whole, : len(a) - whole * STRETCH] = a[whole * STRETCH :]
            at += n
        steps = np.ascontiguousarray(lanes.T)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        owner = np.repeat(np.arange(len(texts)), pieces)
        for k, (local, width, table, letters, keys, targets) in enumerate(self.tables):
            at = np.zeros(len(lanes), np.int32)
            n = np.zeros(len(lanes), np.int32)
            for c in local.take(steps):
                rare = np.flatnonzero(c >= width) if len(keys) else ()
                if len(rare):
                    key, c = at[rare] // width * np.int64(letters) + c[rare], np.where(c < width, c, 0)
                v = table.take(at + c)
                n += v >> 28
                at = v & 0xFFFFFFF
                if len(rare):  # as in the table: on along the phrase, or a phrase is over and the letter, which the root knows, begins the next
                    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    on = keys[place] == key
                    start = np.searchsorted(keys, key % letters)
                    n[rare] += np.where(on, 0, 1) - (v[rare] >> 28)
                    at[rare] = np.where(on, targets[place], targets[start]) * width
            out[:, k] = np.bincount(owner, n, len(texts)) if len(lanes) else 0
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [bool(t and _LETTER.search(t)) for t in texts]
        n = self.phrases([t if k else "" for t, k in zip(texts, known)])
        chars = np.array([max(1, len(t or "")) for t in texts])  # the same for all languages
        bits = n * np.array(self.bits)[None, :] / chars[:, None]
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = bits.argmin(1)
        score = 1 / np.exp(-8 * (bits - bits.min(1, keepdims=True))).sum(1)
        return [self.langs[b] if k else "und" for b, k in zip(best, known)], np.where(known, score, 0.0)


def fit(train: DataFrame, chars_per_lang: int = 40_000, docs_per_lang: int = 300, most_langs: int = 200) -> LanguageModel:
    """Labelled text of each lang value: documents in the order of a hash of their ids, up to docs_per_lang documents and
    chars_per_lang characters. Of a document longer than a quarter of these, a stretch of that length teaches, which begins
    at a place that the hash picks; what doesn't fit any more is passed over. These bounds, and most_langs (the most
    frequent), bound what the driver and the executors hold. Rows with a null text, lang or id teach nothing.
    """
    known = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    langs = [r.lang for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()]
    if not langs:
        return LanguageModel(())
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = known.where(F.col("lang").isin(langs)).select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= docs_per_lang)
    ids = [r.doc_id for r in chosen.select("doc_id").collect()]
    most, h = chars_per_lang // 4, F.xxhash64("doc_id")
    start = F.when(F.length("text") > most, F.pmod(h, F.length("text") - most + 1)).otherwise(0).cast("int") + 1
    stretch = F.substring("text", start, F.lit(most)).alias("text")
    rows = known.where(F.col("doc_id").isin(ids) & F.col("lang").isin(langs)).select("lang", h.alias("h"), "doc_id", stretch).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h, r.doc_id, r.text)):
        kept = texts.setdefault(r.lang, [])
        if sum(map(len, kept)) + len(r.text) <= chars_per_lang:
            kept.append(r.text)
    return LanguageModel(tuple((lang, tuple(texts[lang])) for lang in sorted(texts) if texts[lang]))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every whole text. Null texts and texts without letters: und, 0; ties go to the first lang by name."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, score = Parser.of(model).predict(batch.column(1).to_pylist())
        return batch_of(doc_id=batch.column(0), lang_pred=pa.array(langs, pa.string()), score=pa.array(score, pa.float64()))

    return map_batches(as_docs(docs, "text"), run, "doc_id long, lang_pred string, score double")
