"""Similarities and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return safe_ratio(2 * p * r, p + r)


def lexical(target: Column, label: Column) -> Column:
    """1 where equal; where one contains the other .9, .7 or .5 by their lengths' ratio; .5 without containment too."""
    a, b = F.lower(F.trim(target)), F.lower(F.trim(label))
    ratio = safe_ratio(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b)))
    inside = F.contains(a, b) | F.contains(b, a)
    return F.when(a == b, 1.0).when(inside & (ratio >= 0.7), 0.9).when(inside & (ratio >= 0.4), 0.7).otherwise(0.5)


def jaccard(a: Column, b: Column) -> Column:
    return safe_ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    return F.aggregate(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), F.lit(0), lambda m, k: F.when(F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k), F.greatest(m, k)).otherwise(m))


def predicate_similarity(a: Column, b: Column) -> Column:
    """1 where equal, else the larger one of token Jaccard and prefix or suffix overlap."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"[^a-z0-9]+", -1), lambda w: w != ""))
    longest = F.greatest(F.length(x), F.length(y))
    ends = F.greatest(common_prefix(x, y), common_prefix(F.reverse(x), F.reverse(y)))
    return F.when(x == y, 1.0).otherwise(F.greatest(jaccard(words(x), words(y)), safe_ratio(ends, longest)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def popularity_score(tier: Column, indegree: Column) -> Column:
    return F.round(tier * (1 + F.log10(1 + indegree)), 4)


def link_score(graph: Column, embedding: Column, lexical_score: Column, type_score: Column) -> Column:
    return 0.4 * graph + 0.3 * embedding + 0.2 * lexical_score + 0.1 * type_score


def distance_bucket(d: Column) -> Column:
    """Below five as it is, else floor(log2) up to six, plus two."""
    return F.when(d < 5, d).otherwise(F.least(F.floor(F.log2(d)), F.lit(6)) + 2).cast("long")
