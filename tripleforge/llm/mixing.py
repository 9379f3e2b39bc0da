"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize, small_enough, unit_hash

#: Target share of each source in the mix; a source that is not listed has DEFAULT_WEIGHT. Shares are relative.
TARGET_WEIGHTS = {"src0": 2.0, "src1": 2.0, "src2": 2.0}
DEFAULT_WEIGHT = 1.0
SEED = 17
#: A rate above this is inverted in equal parts, which are summed: a sum of Poisson numbers is Poisson.
PART_RATE = 16.0
#: Thresholds of the inverted distribution: beyond these, less than 1e-20 of a rate of PART_RATE is left.
STEPS = 80
#: A table of sources up to this size (about 1 KB a row) is broadcast.
BROADCAST_ROWS = 20_000
JOIN_SALTS = 64


def repetition_rates(docs: DataFrame, weights: dict[str, float], default_weight: float, epochs: float) -> DataFrame:
    """One row a source: rows, mean rate, parts, and the CDF of a part's Poisson numbers."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    weight = F.coalesce(F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("source")), F.lit(float(default_weight))) if weights else F.lit(float(default_weight))
    weighed = counts.select("source", "n_rows", weight.alias("weight"))
    total = weighed.agg(F.sum("n_rows").alias("all_rows"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("all_weight") > 0, F.lit(float(epochs)) * F.col("weight") / F.col("all_weight") * F.col("all_rows") / F.col("n_rows")).otherwise(0.0)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(PART_RATE)).cast("int"))
    sums = F.expr(f"""aggregate(sequence(1, {STEPS}), named_struct('p', exp(-part_rate), 'c', array(exp(-part_rate))),
        (s, k) -> named_struct('p', s.p * part_rate / k, 'c', array_append(s.c, element_at(s.c, -1) + s.p * part_rate / k)), s -> s.c)""")
    return weighed.crossJoin(F.broadcast(total)).withColumn("rate", rate).withColumn("parts", parts).withColumn("part_rate", F.col("rate") / F.col("parts")).select("source", "n_rows", "rate", "parts", sums.alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = DEFAULT_WEIGHT, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """Repeat each document by a Poisson number whose mean brings its source to its target share.

    Returns the columns of ``docs`` and ``copy`` (from 1) and ``shuffle_key`` (hex), in the order of the
    key within partitions that the key's hash fills: a global shuffle in which no key is hot.
    A document's number comes from the hash of (seed, doc_id, part), so a rerun or a lost executor
    gives the same mix. A rate of 0 drops the source; numbers of 0 drop a document: both are the feature.

    Nulls: a null source is a source of its own with the default weight; a null id hashes as the
    empty text; null and empty texts are repeated like others. Repeated rows are repeated alike. Columns
    that are named as the helpers' (``copy``, ``shuffle_key``) are replaced. An empty table stays empty.
    """
    weights = {k: float(v) for k, v in (TARGET_WEIGHTS if weights is None else weights).items()}
    if any(not math.isfinite(v) or v < 0 for v in [*weights.values(), default_weight]):
        raise ValueError("weights are finite and not negative")
    names = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    rates = materialize(repetition_rates(docs, weights, default_weight, epochs)).select(F.struct("parts", "cdf").alias("__rate"), F.col("source").alias("__source"))
    if small_enough(rates, BROADCAST_ROWS):
        rated = docs.join(F.broadcast(rates), docs["source"].eqNullSafe(rates["__source"]), "left")
    else:
        spread = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
        salted = docs.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(JOIN_SALTS)).cast("int"))
        rated = salted.join(spread, (salted["__salt"] == spread["__salt"]) & salted["source"].eqNullSafe(spread["__source"]), "left")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("__rate.parts")),
        F.lit(0),
        lambda n, part: n + F.size(F.filter(F.col("__rate.cdf"), lambda c: c <= unit_hash(F.lit(seed), ident, part))),
    )
    copies = rated.withColumn("__n", draw).filter("__n > 0").select(*names, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(f"shuffle{seed}"), ident, F.col("copy").cast("string")).cast("binary"))
    return copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents"))


_CASE = "CASE " + " ".join(f"WHEN source = '{k}' THEN {v}" for k, v in TARGET_WEIGHTS.items()) + f" ELSE {DEFAULT_WEIGHT} END"
SQL = f"""
WITH RECURSIVE w AS (SELECT source, count(*) AS n_rows, {_CASE} AS weight FROM documents GROUP BY source),
r0 AS (SELECT source, weight::DOUBLE / (SELECT sum(weight) FROM w) * (SELECT sum(n_rows) FROM w) / n_rows AS rate FROM w),
r AS (SELECT source, greatest(1, ceil(rate / {PART_RATE}))::INT AS parts, rate / greatest(1, ceil(rate / {PART_RATE}))::INT AS m FROM r0),
steps AS (
  SELECT source, m, 0 AS k, exp(-m) AS p, exp(-m) AS c FROM r
  UNION ALL SELECT source, m, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM steps WHERE k < {STEPS}),
u AS (
  SELECT d.*, r.parts, t.part, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || t.part), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)} AS u
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source, LATERAL (SELECT unnest(range(1, r.parts + 1)) AS part) t),
n AS (SELECT u.doc_id, sum((SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM u.source AND s.c <= u.u)) AS n FROM u GROUP BY u.doc_id),
e AS (SELECT doc_id, unnest(range(1, n::BIGINT + 1))::INT AS copy FROM n)
SELECT d.*, e.copy, md5('shuffle{SEED}|' || coalesce(d.doc_id::VARCHAR, '') || '|' || e.copy) AS shuffle_key
FROM documents d JOIN e ON d.doc_id = e.doc_id
"""
