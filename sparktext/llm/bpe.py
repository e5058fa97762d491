"""Byte-level BPE with a sentencepiece model that is written straight from a rank file.

Each byte is mapped to a character of its own; the token of rank r becomes piece r with score -r, and the normaliser is
the identity. sentencepiece then merges as the ranks say: best score first, leftmost of equals. Text is cut into
pre-tokens by the pattern, each encoded alone; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import struct
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import Kept, as_docs, batch_of, map_batches

#: Cut points at which both neighbours are independent of each other: a single space between two characters that are no white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: What may put white space beside a space.
_BESIDE = ["  ", " \n", "\n ", " \t", "\t ", " \r", "\r ", "\x0b", "\x0c", *map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
#: White space to Python's re, but not to the pattern.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = r"[\t-\r \x85\xa0  -     　]"
_NO_SPACE = _SPACE.replace("[", "[^", 1)
#: Bytes as characters above the controls, so that no piece holds one that sentencepiece treats apart.
_BYTE_CHARS = [chr(0x4E00 + b) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | str | float) -> bytes:
    """A protobuf field."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. Piece r is the token of rank r; the one beyond the last is the unknown piece, which no byte reaches."""
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a rank: {missing[:8]}")
    pieces = [_field(1, _field(1, "".join(_BYTE_CHARS[b] for b in t)) + _field(2, -float(r))) for r, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    none = (1 << 64) - 1  # -1
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, none) + _field(42, none) + _field(43, none)
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Bpe:
    """Encoder and decoder of one vocabulary; kept for the life of a Python worker."""

    _kept = Kept()

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.tokens = sorted(ranks, key=ranks.get)
        self.numbers = [str(i) for i in range(len(self.tokens))]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.pattern = regex.compile(pattern.replace(r"[^\s", "[^" + _SPACE[1:-1]).replace(r"\S", _NO_SPACE).replace(r"\s", _SPACE))
        self.bytes_to_chars = {i: c for i, c in enumerate(_BYTE_CHARS)}
        #: Ids of pre-tokens, and of parts of text that several pre-tokens make up, as far as they were seen lately.
        self.cuts: dict[str, list[int]] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Bpe:
        return cls._kept.of((path, pattern), lambda: cls(path, pattern))

    def _learn(self, parts: list[str]) -> list[str]:
        """Encodes parts that aren't kept yet, each new pre-token of theirs once, all in one call. Returns the new pre-tokens."""
        cuts = [self.pattern.findall(p) for p in parts]
        if new := list({w for c in cuts for w in c}.difference(self.cuts)):
            mapped = [w.encode().decode("latin-1").translate(self.bytes_to_chars) for w in new]
            self.cuts.update(zip(new, self.model.encode(mapped, num_threads=1)))
        look = self.cuts.__getitem__
        for part, cut in zip(parts, cuts):
            self.cache[part] = tuple(chain.from_iterable(map(look, cut)))
        return new

    def parts(self, text: str) -> list[str]:
        """Pieces of the text that can be encoded apart: they are cut before single spaces inside a line."""
        if not text or _ODD.search(text):
            return [text] if text else []
        # split(" ") makes the same cuts unless white space is next to a space
        first, *rest = text.split(" ") if text[0] != " " and text[-1] != " " and not any(x in text for x in _BESIDE) else _CUT.split(text)
        return [first, *[" " + x for x in rest]]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        if collecting := gc.isenabled():
            gc.disable()  # the many small tuples hold no cycles
        try:
            return self._encode_all(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_all(self, texts: list[str]) -> list[list[int]]:
        cut = [self.parts(t) for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.cache)
        words = self._learn(list(new)) if new else []
        look = self.cache.__getitem__
        out = [list(chain.from_iterable(map(look, parts))) for parts in cut]
        for kept, fresh in ((self.cache, new), (self.cuts, words)):
            if len(kept) > 200_000:  # what was seen first is what is seen most
                for x in fresh:
                    del kept[x]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.numbers.__getitem__, ids)).encode()).hexdigest()


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> of every whole text. Null and empty texts have no ids; repeated rows stay; the order of rows doesn't matter.

    path: a rank file which every executor can read (it is installed, or lies in a shared folder).
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = Bpe.of(path, pattern)
        return batch_of(doc_id=batch.column(0), ids=pa.array(bpe.encode_all([t or "" for t in batch.column(1).to_pylist()]), pa.list_(pa.int32())))

    return map_batches(as_docs(docs, "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data binary: the bytes that the ids stand for. Null ids: empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = Bpe.of(path, pattern)
        return batch_of(doc_id=batch.column(0), data=pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary()))

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, lossless: encodes and decodes each text in one pass, without moving ids between processes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, rows = Bpe.of(path, pattern), []
        texts = batch.column(1).to_pylist()
        for text, ids in zip(texts, bpe.encode_all([t or "" for t in texts])):
            data = bpe.decode(ids)
            rows.append((len(ids), bpe.digest(ids), hashlib.sha256(data).hexdigest(), len(data), data == (text or "").encode()))
        columns = list(zip(*rows)) or [()] * 5
        return batch_of(
            doc_id=batch.column(0), n_tokens=pa.array(columns[0], pa.int64()), ids_sha256=pa.array(columns[1], pa.string()),
            decoded_sha256=pa.array(columns[2], pa.string()), n_bytes=pa.array(columns[3], pa.int64()), lossless=pa.array(columns[4], pa.bool_()),
        )

    return map_batches(as_docs(docs, "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, lossless boolean")
