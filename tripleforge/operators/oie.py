"""Per-sentence operators that need Python: REBEL decoding, mention spans, fuzzy entity locks, rule-based triples."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F

def rebel_triples(c):
    """Triples (head, type, tail) of a marked sequence: after each ``<triplet>`` a head, then any number of ``<subj>`` tail ``<obj>`` relation.
    Markers stand between blanks; of several relations of a tail the last counts; a triple without one of its slots goes."""
    clean = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(c, "</?s>|<pad>", ""), r"\s+", " ")), F.lit(" "))
    cut = lambda text, marker: F.split(text, rf"(?<= )<{marker}>(?= )", -1)
    rest = lambda parts: F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def one(head, part):
        sides = cut(part, "obj")
        return F.struct(F.trim(cut(head, "obj")[0]).alias("head"), F.trim(F.when(F.size(sides) > 1, F.element_at(sides, -1)).otherwise("")).alias("type"), F.trim(sides[0]).alias("tail"))

    groups = F.transform(rest(cut(clean, "triplet")), lambda g: cut(g, "subj"))
    found = F.flatten(F.transform(groups, lambda parts: F.transform(rest(parts), lambda p: one(parts[0], p))))
    return F.filter(found, lambda t: (t["head"] != "") & (t["type"] != "") & (t["tail"] != ""))


def sequence_ratio(left, right):
    """Ratio of matching characters in the longest matching blocks, recursively; 0 for nulls, which cost nothing."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0.0 if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, "double")(left, right)


def locked(uri_label, mention, threshold: float = 0.82):
    """Whether a candidate's label is the mention: equal with or without a parenthesis, or nearly so."""
    clean = lambda c: F.lower(F.trim(F.replace(c, F.lit("_"), F.lit(" "))))
    label, wanted = clean(uri_label), clean(mention)
    bare = F.trim(F.regexp_replace(label, r"\s*\([^)]*\)", ""))
    same = (label == wanted) | (bare == wanted)
    left = lambda c: F.when(~same, c)  # noqa: E731  what is equal isn't compared letter by letter
    return same | (sequence_ratio(left(label), wanted) >= threshold) | (sequence_ratio(left(F.when(bare != label, bare)), wanted) >= threshold)


def bio_mentions(words, tags):
    """Mentions (start, end, kind) of B-/I- tags: a fold over the tags; an I- without its B- opens one too."""
    start = F.struct(F.lit(-1).alias("s"), F.lit("").alias("k"), F.array().cast("array<struct<s:int,e:int,k:string>>").alias("out"))

    def closed(state, at):
        return F.when(state["s"] >= 0, F.array_append(state["out"], F.struct(state["s"].alias("s"), at.cast("int").alias("e"), state["k"].alias("k")))).otherwise(state["out"])

    def step(state, item):
        kind = F.substring(item["t"], 3, 1 << 20)
        opens = item["t"].startswith("B-") | (item["t"].startswith("I-") & ((state["s"] < 0) | (state["k"] != kind)))
        return (
            F.when(opens, F.struct(item["i"].cast("int").alias("s"), kind.alias("k"), closed(state, item["i"]).alias("out")))
            .when(item["t"].startswith("I-"), state)
            .otherwise(F.struct(F.lit(-1).alias("s"), F.lit("").alias("k"), closed(state, item["i"]).alias("out")))
        )

    items = F.transform(tags, lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    return F.aggregate(items, start, step, lambda state: closed(state, F.size(words)))
