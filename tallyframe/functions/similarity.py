"""Similarity of vectors, token sets and strings, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of each word, padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def name_similarity(a: Column, b: Column) -> Column:
    """1 if equal after folding; else .7 trigram similarity + .3 length ratio, .15 more if one holds the other."""
    fold = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    x, y = fold(a), fold(b)
    ratio = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    base = F.round(0.7 * F.round(jaccard(trigrams(x), trigrams(y)), 2) + 0.3 * F.round(ratio, 2), 2)
    more = F.when(x.contains(y) | y.contains(x), F.least(F.lit(1.0), base + 0.15)).otherwise(base)
    return F.when(x == y, 1.0).otherwise(F.round(more, 2))
