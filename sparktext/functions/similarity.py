"""Likeness of texts and of vectors, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def dice(a: Column, b: Column) -> Column:
    sizes = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(sizes == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / sizes)


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of a text with two spaces at either end; none of an empty text."""
    padded = F.concat(F.lit("  "), text, F.lit("  "))
    runs = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def trigram_dice(a: Column, b: Column) -> Column:
    return dice(trigrams(a), trigrams(b))


def word_trigrams(text: Column) -> Column:
    """Trigrams of words, each with two spaces before and one after it, as a trigram index of a database has them."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    def of(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def overlap(query: Column, document: Column) -> Column:
    """Share of the query's distinct terms that the document has (F16)."""
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(F.array_distinct(query), document)) / F.size(F.array_distinct(query)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def quantized(a: Column) -> Column:
    """Codes from -127 to 127, in proportion to the largest absolute value, halves away from 0 (V2)."""
    most = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.when(most == 0, F.transform(a, lambda x: F.lit(0))).otherwise(F.transform(a, lambda x: F.round(x.cast("double") / (most / 127.0)).cast("int")))


def normalized(a: Column) -> Column:
    size = norm(a)
    return F.when(size == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / size))
