"""Curation of training rows: dedup, routing, sampling, folds over sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import global_rank, smallest


def keep_first(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def complete(batch: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Answers, and a row of nulls for each key of the batch that has none."""
    missing = batch.select(key).distinct().join(answers, key, "left_anti")
    return answers.unionByName(missing, allowMissingColumns=True)


def routed(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Four-way outcome of a left join to (key, decision): keep, rewrite, drop, or unseen."""
    joined = rows.join(decisions, key, "left")
    route = F.when(F.col("decision").isNull(), "unseen").when(F.col("decision") == "none", "keep").when(F.col("decision") == "self_contained", "rewrite").otherwise("drop")
    return joined.withColumn("route", route)


def balanced_negatives(rows: DataFrame, label: str, id_col: str, seed: int = 7) -> DataFrame:
    """All positives and as many negatives, the ones with the smallest seeded hashes."""
    positive, negative = rows.filter(F.col(label) == 1), rows.filter(F.col(label) == 0)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    return positive.unionByName(smallest(negative, positive.count(), digest, id_col))


def merge_system(messages: DataFrame, conv: str, turn: str) -> DataFrame:
    """Conversations as arrays in turn order, a system message put before the next user's."""
    body = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), "role", "text")))
    fold = F.aggregate(
        body,
        F.struct(F.lit("").alias("held"), F.array().cast("array<struct<role:string,text:string>>").alias("out")),
        lambda s, m: F.when(m["role"] == "system", F.struct(F.concat(s["held"], m["text"], F.lit("\n")).alias("held"), s["out"].alias("out"))).otherwise(
            F.struct(
                F.when(m["role"] == "user", "").otherwise(s["held"]).alias("held"),
                F.array_append(s["out"], F.struct(m["role"].alias("role"), F.when(m["role"] == "user", F.concat(s["held"], m["text"])).otherwise(m["text"]).alias("text"))).alias("out"),
            )
        ),
        lambda s: s["out"],
    )
    return messages.groupBy(conv).agg(fold.alias("messages"))


def stratified(rows: DataFrame, coarse: dict[str, Column], order: list[Column], strata: int, per: int) -> DataFrame:
    """``per`` rows from each of ``strata`` even slices of the order (``coarse`` columns, then ``order``): a sampling operator. The first
    slices have one row more where the rows don't divide evenly."""
    total = rows.count()
    size, more = divmod(total, strata)
    ranked = global_rank(rows, coarse, order).withColumn("rank", F.col("rank") - 1)
    cut, r = more * (size + 1), F.col("rank")
    stratum = F.when(r < cut, F.floor(r / F.lit(size + 1))).otherwise(more + F.floor((r - cut) / F.lit(max(1, size))))
    first = F.when(F.col("stratum") < more, F.col("stratum") * (size + 1)).otherwise(cut + (F.col("stratum") - more) * size)
    sliced = ranked.withColumn("stratum", stratum.cast("long")).withColumn("n", (r - first + 1).cast("long")).filter(F.col("n") <= per)
    return sliced.withColumn("stratum", F.col("stratum") + 1).drop("rank")
