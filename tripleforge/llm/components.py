"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Neighbours from which a node can be a hub, at least. There are at most 2 * HUB_SHARE hubs (24 bytes each in a broadcast).
HUB_LEAST, HUB_SHARE = 1000, 1000


def _fingerprint(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _with_least(pairs: DataFrame, edges: int) -> DataFrame:
    """(u, v, m): each pair (u, v) with the smallest v of its u.

    The pairs of a hub, with more than a HUB_SHARE-th of the edges, meet its row in a broadcast; the others are joined, so no
    task reads more of one u than that."""
    most = max(HUB_LEAST, edges // HUB_SHARE)
    least = materialize(pairs.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    hubs, others = F.broadcast(least.filter(F.col("n") > most)), least.filter(F.col("n") <= most)
    met = pairs.join(hubs, F.col("u") == F.col("k")).unionByName(pairs.join(others, F.col("u") == F.col("k")))
    return met.select("u", "v", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the smallest node that it reaches.

    Each round is two aggregations and joins over at most as many rows as there are edges, written to the
    shared folder; a chain of n edges takes O(log n) rounds and stars take two. Nothing is gathered. Nulls and
    loops are dropped; repeated edges count once."""
    pairs = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _fingerprint(pairs)
    while seen[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, seen[0]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v")
        large = materialize(large.distinct())
        small = _with_least(large, seen[0])
        down = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(down.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        now = _fingerprint(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
