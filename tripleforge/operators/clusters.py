"""Scoring of open extractions against clustered gold patterns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleforge.functions.similarity import f1, safe_ratio

ALTERNATIVE, SLOT = " |OR| ", " --> "
PASSIVE, NO_PASSIVE = " <--{allowed in passive}", " <--{not allowed in passive}"


def slot_expression(slot: str) -> re.Pattern:
    """A slot's pattern: ``[x]`` may be left out, blanks between words count once, case doesn't matter."""
    out = []
    for part in re.split(r"(\[[^\]]*\])", re.sub(r"\{[a-z]\}", " ", slot)):
        words = re.escape(" ".join(part.strip("[]").split())).replace(r"\ ", r"\s+")
        if words:
            out.append(rf"(?:{words}\s*)?" if part.startswith("[") else rf"{words}\s*")
    return re.compile("^" + "".join(out) + "$", re.IGNORECASE)


def matches(pattern: str, extraction: tuple[str, str, str], passive: bool = True) -> bool:
    """Whether an extraction satisfies one of a gold line's alternatives; in passive its arguments may be swapped."""
    for line in pattern.split(ALTERNATIVE):
        swap = passive
        if NO_PASSIVE in line:
            line, swap = line.replace(NO_PASSIVE, ""), False
        elif PASSIVE in line:
            line, swap = line.replace(PASSIVE, ""), True
        slots = line.split(SLOT)
        if len(slots) != 3:
            continue
        wanted = [slot_expression(s) for s in slots]
        given = [" ".join((x or "").split()) for x in extraction]
        orders = [given, given[::-1]] if swap else [given]
        if any(all(w.match(x) for w, x in zip(wanted, order, strict=True)) for order in orders):
            return True
    return False


def cluster_scores(gold: DataFrame, extracted: DataFrame, passive: bool = True) -> DataFrame:
    """(sent_id, tp, fp, fn) from gold (sent_id, cluster, kind, pattern; kind essential or compensatory) and extractions
    (sent_id, arg1, rel, arg2). tp are extractions that satisfy any line; fn the essential lines left over in the
    cluster with the fewest. A sentence's gold and extractions are few, so they meet in grouped pandas."""

    def score(key, gold_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = list(dict.fromkeys(zip(rows["arg1"], rows["rel"], rows["arg2"], strict=True)))
        hit, missing = set(), []
        for _, cluster in gold_rows.groupby("cluster"):
            left = 0
            for kind, pattern in zip(cluster["kind"], cluster["pattern"], strict=True):
                satisfied = [e for e in found if matches(pattern, e, passive)]
                hit.update(satisfied)
                left += kind == "essential" and not satisfied
            missing.append(left)
        return pd.DataFrame({"sent_id": [key[0]], "tp": [len(hit)], "fp": [len(found) - len(hit)], "fn": [min(missing, default=0)]})

    return gold.groupBy("sent_id").cogroup(extracted.groupBy("sent_id")).applyInPandas(score, "sent_id string, tp long, fp long, fn long")


def missing_essentials(gold: DataFrame) -> DataFrame:
    """(sent_id, largest, smallest): essential lines of a sentence's clusters. What a sentence without any extraction misses is the largest
    number by one scheme of scoring, the smallest by another."""
    sizes = gold.groupBy("sent_id", "cluster").agg(F.count_if(F.col("kind") == "essential").alias("n"))
    return sizes.groupBy("sent_id").agg(F.max("n").alias("largest"), F.min("n").alias("smallest"))


def micro_with_missing(scores: DataFrame, gold: DataFrame, missing: str = "largest") -> DataFrame:
    """``micro`` of scores (sent_id, tp, fp, fn), with what sentences without scores miss."""
    left = missing_essentials(gold).join(scores.select("sent_id"), "sent_id", "left_anti")
    zero = F.lit(0).cast("long")
    return micro(scores.select("sent_id", "tp", "fp", "fn").unionByName(left.select("sent_id", zero.alias("tp"), zero.alias("fp"), F.col(missing).cast("long").alias("fn"))))


def micro(scores: DataFrame) -> DataFrame:
    sums = scores.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))
