"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, load, materialize

SALTS = 32


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Group rows whose text is the same up to runs of blanks; the smallest id stays.

    Three combining stages, and each keys on the digest *and* the whole normalised text, so
    no digest collision can merge two texts:

    1. locally: partial aggregation makes one row of the copies within a task;
    2. salted: these rows meet by (digest, salt, text), so a hot text is spread over ``salts`` tasks;
    3. globally: at most ``salts`` winners of a text meet by (digest, text).

    The rows then find their group by digest alone, unless a digest has two texts (which the
    winners tell): then by digest and text. AQE splits a hot digest there.

    Nulls: a null text counts as empty, and empty texts are one group. A null id never wins
    over an id; a group without ids has a null ``keep_id``, and its rows aren't kept. A row that is
    repeated with its id counts each time, and each of these rows is ``kept``. An empty table
    gives an empty result. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("body")).withColumn("text_sha256", F.sha2(F.col("body").cast("binary"), 256))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    salted = rows.groupBy("text_sha256", salt.alias("salt"), "body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("text_sha256", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = materialize(winners.select("text_sha256", "keep_id", "group_size"))
    if groups.groupBy("text_sha256").count().filter("count > 1").isEmpty():
        found = rows.select("doc_id", "text_sha256").join(groups, "text_sha256")
    else:
        found = rows.join(winners, ["text_sha256", "body"])
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, all columns: one with the group's smallest id, or without id if the group has none."""
    kept = exact_dedup(docs).filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha256")).distinct()
    rows = docs.select("doc_id", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"), F.struct(*docs.columns).alias("row"))
    out = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_sha256") == F.col("keep_sha256")), "left_semi")
    again = materialize(out.groupBy("doc_id", "text_sha256").count().filter("count > 1").select(F.col("doc_id").alias("again_id"), F.col("text_sha256").alias("again_sha256")))
    if not again.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("text_sha256") == F.col("again_sha256"))
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["doc_id", "text_sha256"]))
    return out.select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""
