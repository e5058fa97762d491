"""Stemmers: Porter's for English, Snowball's for French (T14-T16). Sequential rules, so they run over distinct words, in batches."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _shape(word: str) -> str:
    """c and v for consonants and vowels; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


_STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
_STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _replaced(word: str, rules: list[tuple[str, str]], least: int) -> str:
    for end, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + new if _measure(stem) > least else word
    return word


def porter(word: str) -> str:
    """The original algorithm; words of fewer than three letters, and those that aren't a-z, stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                stem = word[: -len(end)]
                if "v" in _shape(stem):
                    word = stem
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP_2, 0), _STEP_3, 0)
    for end in sorted(_STEP_4, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short(stem):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


_VOWELS = "aeiouyâàëéêèïîôûù"


def _regions(w: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""
    v = _VOWELS
    if len(w) > 1 and w[0] in v and w[1] in v or w.startswith(("par", "col", "tap")):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in v), len(w))

    def after(start: int) -> int:
        return next((i + 1 for i in range(start + 1, len(w)) if w[i] not in v and w[i - 1] in v), len(w))

    r1 = after(0)
    return min(rv, len(w)), r1, after(r1) if r1 < len(w) else len(w)


def french(word: str) -> str:
    """Snowball's algorithm; it wants accents, so fold none before."""
    w = word.lower()
    # vowels that are consonants here are written in capitals
    w = re.sub(rf"(?<=[{_VOWELS}])([ui])(?=[{_VOWELS}])", lambda m: m[1].upper(), w)
    w = re.sub(rf"y(?=[{_VOWELS}])|(?<=[{_VOWELS}])y", "Y", w)
    w = w.replace("qu", "qU").replace("ë", "He").replace("ï", "Hi")
    rv, r1, r2 = _regions(w)

    def ends(*suffixes: str) -> str:
        return next((s for s in sorted(suffixes, key=len, reverse=True) if w.endswith(s)), "")

    def inside(suffix: str, region: int) -> bool:
        return len(w) - len(suffix) >= region

    before, again = w, False
    s = ends(*"ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split())
    done = False
    if s:
        cut = w[: -len(s)]
        done = True
        if s in "ance iqUe isme able iste eux ances iqUes ismes ables istes".split() and inside(s, r2):
            w = cut
        elif s in ("atrice", "ateur", "ation", "atrices", "ateurs", "ations") and inside(s, r2):
            w = cut
            if w.endswith("ic"):
                w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
        elif s in ("logie", "logies") and inside(s, r2):
            w = cut + "log"
        elif s in ("usion", "ution", "usions", "utions") and inside(s, r2):
            w = cut + "u"
        elif s in ("ence", "ences") and inside(s, r2):
            w = cut + "ent"
        elif s in ("ement", "ements") and inside(s, rv):
            w = cut
            if w.endswith("iv") and len(w) - 2 >= r2:
                w = w[:-2]
                if w.endswith("at") and len(w) - 2 >= r2:
                    w = w[:-2]
            elif w.endswith("eus"):
                w = w[:-3] if len(w) - 3 >= r2 else w[:-1] + "x" if len(w) - 3 >= r1 else w
            elif w.endswith(("abl", "iqU")) and len(w) - 3 >= r2:
                w = w[:-3]
            elif w.endswith(("ièr", "Ièr")) and len(w) - 3 >= rv:
                w = w[:-3] + "i"
        elif s in ("ité", "ités") and inside(s, r2):
            w = cut
            if w.endswith("abil"):
                w = w[:-4] if len(w) - 4 >= r2 else w[:-4] + "abl"
            elif w.endswith("ic"):
                w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
            elif w.endswith("iv") and len(w) - 2 >= r2:
                w = w[:-2]
        elif s in ("if", "ive", "ifs", "ives") and inside(s, r2):
            w = cut
            if w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
                if w.endswith("ic"):
                    w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
        elif s == "eaux":
            w = cut + "eau"
        elif s == "aux" and inside(s, r1):
            w = cut + "al"
        elif s in ("euse", "euses") and inside(s, r1):
            w = cut if inside(s, r2) else cut + "eux"
        elif s in ("issement", "issements") and inside(s, r1) and cut and cut[-1] not in _VOWELS:
            w = cut
        elif s == "amment" and inside(s, rv):
            w, again = cut + "ant", True
        elif s == "emment" and inside(s, rv):
            w, again = cut + "ent", True
        elif s in ("ment", "ments") and len(cut) > rv and cut[-1] in _VOWELS:
            w, again = cut, True
        else:
            done = False
    if not done or again:
        here = w
        s = ends(*"îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split())
        if s and inside(s, rv) and len(w) - len(s) > rv and w[-len(s) - 1] not in _VOWELS + "H":
            w = w[: -len(s)]
        elif here == w:
            s = ends(*"ions é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split())
            if s and inside(s, rv):
                if s == "ions":
                    w = w[:-4] if inside(s, r2) else w
                else:
                    w = w[: -len(s)]
                    if s[0] in "âa" and w.endswith("e") and len(w) - 1 >= rv:
                        w = w[:-1]
    if w != before:
        if w.endswith("Y"):
            w = w[:-1] + "i"
        elif w.endswith("ç"):
            w = w[:-1] + "c"
    else:
        if w.endswith("s") and len(w) > 1 and (w[-2] not in "aiouès" or w.endswith("His")):
            w = w[:-1]
        s = ends("ion", "ier", "ière", "Ier", "Ière", "e")
        if s and inside(s, rv):
            if s == "ion":
                if inside(s, r2) and len(w) - 4 >= rv and w[-4] in "st":
                    w = w[:-3]
            elif s == "e":
                w = w[:-1]
            else:
                w = w[: -len(s)] + "i"
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(rf"[éè]([^{_VOWELS}]+)$", r"e\1", w)
    return w.replace("He", "ë").replace("Hi", "ï").lower()


STEMMERS: dict[str, Callable[[str], str]] = {"english": porter, "french": french}


def stemmed(words: DataFrame, language: str | Callable[[str], str] = "english") -> DataFrame:
    """words (term, ...), with stem: each distinct term is stemmed once, and joined back."""
    stem = STEMMERS[language] if isinstance(language, str) else language

    @F.pandas_udf("string")
    def run(terms: pd.Series) -> pd.Series:
        return terms.map(stem)

    return words.join(words.select("term").distinct().withColumn("stem", run("term")), "term")
