"""Text to terms, as Column expressions that stay in the JVM (T1-T13, T18; stems in stemmers.py)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER_OR_DIGIT = r"\p{L}\p{Nd}"
WORD = rf"[{LETTER_OR_DIGIT}][{LETTER_OR_DIGIT}\p{{M}}]*"
_IDEOGRAPH = r"\p{IsHan}\p{IsHiragana}"
_SYMBOLS = "©®™↔"

#: Words that carry no topic: a short list of function words, and longer lists for two languages.
ENGLISH_FUNCTION_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
ENGLISH_STOP_WORDS = tuple(sorted({*ENGLISH_FUNCTION_WORDS, *"about after all also am any because been before being between both can could did do does each few from further had has have he her here him his how i its just me more most my nor now only other our out over own same she should so some than them through too under up very we were what when where which while who whom why would you your".split()}))
FRENCH_STOP_WORDS = tuple("a au aux avec ce ces cet cette dans de des du elle elles en est et eu il ils je la le les leur leurs lui ma mais me mes moi mon ne nos notre nous on ont ou par pas pour qu que qui sa se ses si son sont sur ta te tes toi ton tu un une vos votre vous y été être".split())


@dataclass(frozen=True)
class Tokenizer:
    """How text becomes terms.

    A term is a letter or digit and the letters, digits and combining marks after it; everything else separates. Slices of
    one character are dropped unless keep_single; then terms are lowered and folded, possessives and stop words go, stems
    and n-grams are made. joiners join where both neighbours are word characters; unicode_words also joins as Unicode's
    word boundaries do (digits by , ; . and letters by : · . ' _), and sets ideographs apart.
    """

    fold_diacritics: bool = True
    keep_single: bool = False
    possessive: bool = False
    stop_words: tuple[str, ...] = ()
    joiners: str = ""
    unicode_words: bool = False
    symbol_terms: bool = False
    ngram_min: int = 1
    ngram_max: int = 1
    longest: int = 255
    stem: Callable[[Column], Column] | None = None

    @property
    def pattern(self) -> str:
        start, rest = f"[{LETTER_OR_DIGIT}]", f"[{LETTER_OR_DIGIT}\\p{{M}}]"
        joins = []
        if self.joiners:
            joins.append("[" + "".join("\\" + c for c in self.joiners) + f"](?={start})")
        if self.unicode_words:
            start, rest = rf"(?:(?![{_IDEOGRAPH}]){start})", rf"(?:(?![{_IDEOGRAPH}])[{LETTER_OR_DIGIT}\p{{M}}\p{{Cf}}\x{{202F}}])"
            joins += [r"(?<=\p{Nd})[,;.'](?=\p{Nd})", r"(?<=\p{L})[:·.'’‘](?=\p{L})", rf"_+(?={start})"]
        word = start + rest + "*"
        if joins:
            word += "(?:(?:" + "|".join(joins) + ")" + start + rest + "*)*"
        if self.unicode_words:
            word += rf"|[{_IDEOGRAPH}]"
        if self.symbol_terms and self.keep_single and joins:
            word += f"|[{_SYMBOLS}]"
        return word

    def slices(self, text: Column) -> Column:
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))
        if self.unicode_words:
            found = F.flatten(F.transform(found, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / self.longest).cast("int")), lambda i: F.substring(x, i * self.longest + 1, F.lit(self.longest)))))
        return found if self.keep_single else F.filter(found, lambda x: F.length(x) >= 2)

    def normal(self, term: Column) -> Column:
        whole = F.lower(F.translate(fold(term) if self.fold_diacritics else term, "İ", "i"))
        term = F.when(_is_ascii(term), F.lower(term)).otherwise(whole)
        if self.possessive:
            term = F.regexp_replace(term, "['’]s$", "")
        return term

    def terms(self, text: Column) -> Column:
        """array<string>, in order; an empty array for null."""
        out = F.transform(self.slices(text), self.normal)
        if not self.possessive:  # then lowering is all that such texts need, and whole texts are lowered at once
            out = F.when(_is_ascii(text), self.slices(F.lower(text))).otherwise(out)
        if self.stop_words:
            out = F.filter(out, lambda x: ~x.isin(*self.stop_words))
        out = F.filter(out, lambda x: x != "")
        if self.stem:
            out = F.transform(out, self.stem)
        if (self.ngram_min, self.ngram_max) != (1, 1):
            # a lambda's variable is computed once, and not again for each run
            out = F.transform(F.array(out), lambda words: ngrams(words, self.ngram_min, self.ngram_max))[0]
        return out


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


@lru_cache
def _folding() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, their bases, [(character, several)]) under compatibility decomposition without marks."""
    single, several = {}, []
    for c in range(0x80, 0x10000):
        if 0xD800 <= c < 0xE000 or 0xF900 <= c < 0xFB00:
            continue
        x = chr(c)
        y = unicodedata.normalize("NFC", "".join(z for z in unicodedata.normalize("NFKD", x) if unicodedata.category(z) != "Mn").lower())
        if len(y) == 1 and y != x and y != x.lower() and unicodedata.category(x)[0] in "LNS":
            single[x] = y
        elif len(y) > 1 and x in "ﬀﬁﬂﬃﬄﬅﬆĳĲŉǆǅǄǉǈǇǌǋǊ":
            several.append((x, y))
    return "".join(single), "".join(single.values()), tuple(several)


def fold(term: Column) -> Column:
    """Letters without their marks, ligatures apart."""
    single, bases, several = _folding()
    out = F.translate(term, single, bases)
    for x, y in several:
        out = F.replace(out, F.lit(x), F.lit(y))
    return F.regexp_replace(out, r"\p{Mn}", "")


def ngrams(terms: Column, least: int, most: int, separator: str = " ") -> Column:
    """Runs of least to most terms, shorter ones first; fewer than two terms stay as they are."""
    def runs(n: int) -> Column:
        if n == 1:
            return terms
        starts = F.when(F.size(terms) >= n, F.sequence(F.lit(1), F.size(terms) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(terms, i, F.lit(n)), separator))

    return F.when(F.size(terms) < 2, terms).otherwise(F.concat(*(runs(n) for n in range(least, most + 1))))


def enriched(text: Column, fields: Iterable[Column]) -> Column:
    """Text with the values of fields before it."""
    return F.concat_ws(" ", *fields, text)
