"""WordPiece tokenizing, for encoders of texts that a caller brings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def word_pieces(text: str, vocabulary: dict[str, int], unknown: str = "[UNK]", longest: int = 100) -> list[str]:
    """Longest pieces first, those inside a word marked by ##; a word that can't be pieced together is unknown."""
    out = []
    for word in re.findall(r"\w+|[^\w\s]", text.lower()):
        pieces, at = [], 0
        while at < len(word) and len(word) <= longest:
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
            if end is None:
                break
            pieces.append(("##" if at else "") + word[at:end])
            at = end
        out += pieces if at == len(word) else [unknown]
    return out


def word_piece_ids(text: Column, vocabulary: dict[str, int], unknown: str = "[UNK]") -> Column:
    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [vocabulary[p] for p in word_pieces(t or "", vocabulary, unknown)])

    return run(text)
