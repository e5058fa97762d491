"""The query language: a parser on the driver, and its operators as joins and column conditions."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import TextIndex
from .scoring import Scorer, bm25, bm25_f, bm25_f_scoped, score

MOST_EXPANSIONS, MOST_ATOMS = 64, 32


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    field: str = ""


@dataclass(frozen=True)
class Atom:
    """A term that stands for others: those with this prefix, or within so many edits."""

    base: str
    prefix: bool = False
    edits: int = 0
    sign: str = ""
    field: str = ""


@dataclass
class Query:
    terms: list[str] = field(default_factory=list)
    phrases: list[Phrase] = field(default_factory=list)
    required: list[tuple[str, str]] = field(default_factory=list)
    prohibited: list[tuple[str, str]] = field(default_factory=list)
    prohibited_phrases: list[Phrase] = field(default_factory=list)
    scoped: list[tuple[str, str]] = field(default_factory=list)
    atoms: list[Atom] = field(default_factory=list)

    @property
    def pure_negative(self) -> bool:
        return not (self.terms or self.phrases or self.required or self.scoped or any(a.sign != "-" for a in self.atoms)) and bool(self.prohibited or self.prohibited_phrases or self.atoms)

    @property
    def features(self) -> set[str]:
        names = {"phrases": self.phrases, "required": self.required, "prohibited": self.prohibited or self.prohibited_phrases, "scopes": self.scoped, "prefix": [a for a in self.atoms if a.prefix], "fuzzy": [a for a in self.atoms if a.edits]}
        return {n for n, v in names.items() if v}


def tokenize(text: str, least: int = 2) -> list[str]:
    """What the default tokenizer makes of a query, on the driver."""
    out = []
    for raw in re.findall(r"[^\W_](?:[^\W_]|[̀-ͯ])*", text):
        if len(raw) >= least:
            out.append("".join(x for x in unicodedata.normalize("NFKD", raw) if unicodedata.category(x) != "Mn").lower())
    return out


def parse(text: str, fields: tuple[str, ...] = (), syntax: bool = True) -> Query:
    """Terms, "phrases", +required, -prohibited, field:scoped, prefix*, fuzzy~N. A sign counts only in front of a word or phrase; a scope only if the field is known; without syntax, all is text."""
    q = Query()
    if not syntax:
        q.terms = tokenize(text)
        return q
    pattern = re.compile(r'(?P<sign>[+-]?)(?:(?P<field>\w+):)?(?:"(?P<phrase>[^"]*)"?|(?P<word>[^\s"]+))')
    for m in pattern.finditer(text):
        sign, scope, word = m["sign"], m["field"] or "", m["word"]
        if scope and scope not in fields:
            word, scope = (f"{scope}:{word}" if word is not None else word), ""
        if m["phrase"] is not None:
            terms = tuple(tokenize(m["phrase"]))
            if not terms:
                continue
            if len(terms) == 1:
                (q.prohibited if sign == "-" else q.required).append((scope, terms[0]))
                if sign != "-":
                    (q.scoped.append((scope, terms[0])) if scope else q.terms.append(terms[0]))
            elif sign == "-":
                q.prohibited_phrases.append(Phrase(terms, scope))
            else:
                q.phrases.append(Phrase(terms, scope))
                q.terms += [] if scope else terms
            continue
        fuzzy = re.fullmatch(r"(.+)~(\d*)", word)
        if word.endswith("*") and len(tokenize(word[:-1], 1)) == 1:
            q.atoms.append(Atom(tokenize(word[:-1], 1)[0], True, 0, sign, scope))
            continue
        if fuzzy and len(tokenize(fuzzy[1], 1)) == 1:
            edits = min(2, int(fuzzy[2] or 1))
            if edits:
                q.atoms.append(Atom(tokenize(fuzzy[1], 1)[0], False, edits, sign, scope))
                continue
            word = fuzzy[1]
        for t in tokenize(word):
            if sign == "-":
                q.prohibited.append((scope, t))
            else:
                if sign == "+":
                    q.required.append((scope, t))
                (q.scoped.append((scope, t)) if scope else q.terms.append(t))
    if len({(a.base, a.prefix, a.edits) for a in q.atoms}) > MOST_ATOMS:
        raise ValueError(f"more than {MOST_ATOMS} expanded terms in a query")
    return q


def ensure_supported(q: Query, supported: set[str]) -> None:
    if unknown := q.features - supported:
        raise NotImplementedError(f"this engine doesn't take {', '.join(sorted(unknown))}")


def expand_prefix(vocabulary: DataFrame, base: str, limit: int = MOST_EXPANSIONS) -> DataFrame:
    """term, df: the most frequent terms with a prefix (Q6)."""
    return vocabulary.where(F.col("term").startswith(base)).orderBy(F.desc("df"), "term").limit(limit).select("term", "df")


def expand_fuzzy(vocabulary: DataFrame, base: str, edits: int = 1, limit: int = MOST_EXPANSIONS, only_unknown: bool = False) -> DataFrame:
    """term, df, distance: terms within so many edits, nearest first (Q7); only_unknown: a known base stands for itself (Q8)."""
    near = vocabulary.where(F.length("term").between(len(base) - edits, len(base) + edits)).withColumn("distance", F.levenshtein("term", F.lit(base), edits)).where("distance >= 0")
    if only_unknown:
        known = vocabulary.where(F.col("term") == base).select(F.lit(True).alias("known")).limit(1)
        near = near.join(F.broadcast(known), F.lit(True), "left").where(F.col("known").isNull() | (F.col("term") == base)).drop("known")  # one row at most
    return near.orderBy("distance", F.desc("df"), "term").limit(limit).select("term", "df", "distance")


def has_phrase(terms: Column, phrase: tuple[str, ...]) -> Column:
    """Whether the terms hold the phrase, one after the other."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(terms) - len(phrase) + 1, F.lit(1))), lambda i: reduce(lambda a, b: a & b, (F.try_element_at(terms, i + k).eqNullSafe(F.lit(t)) for k, t in enumerate(phrase))))
    return F.arrays_overlap(terms, F.array(F.lit(phrase[0]))) & (F.size(starts) > 0)


def gate(index: TextIndex, q: Query, expanded: dict[Atom, list[str]] | None = None) -> DataFrame:
    """Ids of documents that pass the query's conditions; terms without a sign set none."""
    terms = F.col("terms")
    conditions = [has_phrase(terms, p.terms) for p in q.phrases if not p.field] + [~has_phrase(terms, p.terms) for p in q.prohibited_phrases if not p.field]
    conditions += [F.array_contains(terms, t) for f, t in q.required if not f] + [~F.array_contains(terms, t) for f, t in q.prohibited if not f]
    for a, found in (expanded or {}).items():
        if a.sign and not a.field:
            any_of = F.arrays_overlap(terms, F.array(*map(F.lit, found)).cast("array<string>")) if found else F.lit(False)
            conditions.append(~any_of if a.sign == "-" else any_of)
    of = {f: index.tokenizer.terms(F.col(f)) for f in index.fields}
    scoped = [F.array_contains(of[f], t) for f, t in q.required if f] + [~F.array_contains(of[f], t) for f, t in q.prohibited if f]
    scoped += [has_phrase(of[p.field], p.terms) for p in q.phrases if p.field] + [~has_phrase(of[p.field], p.terms) for p in q.prohibited_phrases if p.field]
    for a, found in (expanded or {}).items():
        if a.sign and a.field:
            any_of = F.arrays_overlap(of[a.field], F.array(*map(F.lit, found)).cast("array<string>")) if found else F.lit(False)
            scoped.append(~any_of if a.sign == "-" else any_of)
    passed = lambda rows, conditions, id: rows.where(reduce(lambda a, b: a & b, conditions, F.lit(True))).select(F.col(id).alias("doc_id"))
    if not scoped:
        return passed(index.terms, conditions, "doc_id")
    in_fields = passed(index.documents, scoped, index.id)  # all fields of a document are in its row
    return passed(index.terms, conditions, "doc_id").join(in_fields.hint("merge"), "doc_id", "left_semi") if conditions else in_fields


def search(index: TextIndex, text: str, scorer: Scorer | None = None, syntax: bool = True, fuzzy_only_unknown: bool = False, field_weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, score of all documents that match a query with its operators; a query that only prohibits scores the rest 1.

    Terms with a scope are sought, expanded and scored in their field alone, by BM25F with field_weights (1 where not given).
    Other terms, too, are scored over the fields if there are field_weights and no scorer.
    """
    q = parse(text, index.fields, syntax)
    expanded: dict[Atom, list[str]] = {}
    for a in dict.fromkeys(q.atoms):
        vocabulary = index.field_vocabulary(a.field) if a.field else index.vocabulary
        found = expand_prefix(vocabulary, a.base) if a.prefix else expand_fuzzy(vocabulary, a.base, a.edits, only_unknown=fuzzy_only_unknown)
        expanded[a] = [r.term for r in found.collect()]  # 64 at most
    passed = gate(index, q, expanded)
    if q.pure_negative:
        return passed.withColumn("score", F.lit(1.0))
    words = list(dict.fromkeys([*q.terms, *(t for a, found in expanded.items() if a.sign != "-" and not a.field for t in found)]))
    scoped = list(dict.fromkeys([*q.scoped, *((p.field, t) for p in q.phrases if p.field for t in p.terms), *((a.field, t) for a, found in expanded.items() if a.sign != "-" and a.field for t in found)]))
    spark = index.documents.sparkSession
    terms = spark.createDataFrame([(0, t, 1, len(words)) for t in words], "query_id int, term string, qtf int, qlen int")
    over_fields = field_weights and scorer is None
    hits = (bm25_f(index, None, field_weights, terms=terms) if over_fields else score(index, terms, scorer or bm25(), terms=terms)).select("doc_id", "score")
    if scoped:
        pairs = spark.createDataFrame([(0, f, t) for f, t in scoped], "query_id int, field string, term string")
        weights = {f: 1.0 for f in index.fields} | (field_weights or {})
        in_fields = bm25_f_scoped(index, pairs, weights).select("doc_id", "score")
        hits = hits.unionByName(in_fields).groupBy("doc_id").agg(F.sum("score").alias("score")) if words else in_fields
    # ids that pass may be nearly all, however small the documents' file is
    return hits.join(passed.hint("merge"), "doc_id", "left_semi").select("doc_id", "score")


# metadata


def _number(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), ",", "").try_cast("double")


def metadata(column: Column, operator: str, value: str, values: str | None = None) -> Column:
    """Whether a field passes (Q13, Q14): equal, not_equal, contains, greater, less. An absent field passes only not_equal; numbers compare as such where both are. values: the separator of a field that holds several, of which any may pass."""
    if values:
        parts = F.filter(F.split(column, re.escape(values)), lambda x: F.trim(x) != "")
        if operator == "not_equal":
            return F.coalesce(~F.exists(parts, lambda x: x == value), F.lit(True))
        return F.coalesce(F.exists(parts, lambda x: metadata(x, operator, value)), F.lit(False))
    if operator == "equal":
        return F.coalesce(column == value, F.lit(False))
    if operator == "not_equal":
        return F.coalesce(column != value, F.lit(True))
    if operator == "contains":
        return F.coalesce(F.contains(column, F.lit(value)), F.lit(False))
    number, other = _number(column), _number(F.lit(value))
    both = number.isNotNull() & other.isNotNull()
    if operator == "greater":
        return F.coalesce(F.when(both, number > other).otherwise(column > value), F.lit(False))
    if operator == "less":
        return F.coalesce(F.when(both, number < other).otherwise(column < value), F.lit(False))
    raise ValueError(f"unknown operator: {operator}")


def without(scored: DataFrame, ids: DataFrame) -> DataFrame:
    """Excluded documents (Q15)."""
    return scored.join(ids, "doc_id", "left_anti")


def best_of_variants(variants: DataFrame) -> DataFrame:
    """query_id, variant, doc_id, score: each document's best score over the variants of a query (Q17)."""
    return variants.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
