"""Token-array operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sublist_starts(words: Column, pattern: Column) -> Column:
    """All starts (from 0) of a token list in another."""

    def found(w: Column) -> Column:
        last = F.size(w) - F.size(pattern)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(w, i + 1, F.size(pattern)) == pattern)
        return F.when((last >= 0) & (F.size(pattern) > 0), starts).otherwise(F.array().cast("array<int>"))

    # a one-element transform evaluates the words once, not at each place
    return F.element_at(F.transform(F.array(words), found), 1)


def padded(words: Column, length: int = 40, fill: str = "<pad>") -> Column:
    return F.slice(F.concat(words, F.array_repeat(F.lit(fill), length)), 1, length)


def parts_around(words: Column, start: Column, end: Column) -> Column:
    """(left, right) of the span [start, end)."""
    return F.struct(F.slice(words, F.lit(1), start).alias("left"), F.slice(words, end + 1, F.greatest(F.size(words) - end, F.lit(0))).alias("right"))
