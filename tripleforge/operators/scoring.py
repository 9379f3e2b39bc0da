"""Scoring of extracted triples against gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleforge.functions.similarity import f1, safe_ratio
from tripleforge.functions.text import triple_key


def keyed(triples: DataFrame, by: list[str]) -> DataFrame:
    return triples.select(*by, triple_key(F.col("sub"), F.col("rel"), F.col("obj")).alias("key"))


def sentence_scores(gold: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1 of each sentence by set intersection of triple keys. One aggregation over both sides."""
    sides = keyed(gold, by).withColumns({"g": F.lit(1), "q": F.lit(0)}).unionByName(keyed(pred, by).withColumns({"g": F.lit(0), "q": F.lit(1)}))
    keys = sides.groupBy(*by, "key").agg(F.max("g").alias("g"), F.max("q").alias("q"))
    sums = keys.groupBy(*by).agg(F.sum("g").alias("n_gold"), F.sum("q").alias("n_pred"), F.sum(F.col("g") * F.col("q")).alias("tp"))
    p, r = safe_ratio(F.col("tp"), F.col("n_pred")), safe_ratio(F.col("tp"), F.col("n_gold"))
    return sums.withColumns({"p": p, "r": r, "f1": f1(p, r)})


def macro(scores: DataFrame, domain: str) -> DataFrame:
    """Mean over a domain's sentences, and OVERALL: the unweighted mean over domains."""
    per = scores.groupBy(F.col(domain).cast("string").alias("domain")).agg(*[F.avg(c).alias(c) for c in ("p", "r", "f1")], F.count(F.lit(1)).alias("n"))
    overall = per.agg(*[F.avg(c).alias(c) for c in ("p", "r", "f1")], F.sum("n").alias("n")).select(F.lit("OVERALL").alias("domain"), "p", "r", "f1", "n")
    return per.unionByName(overall).select("domain", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")], "n")


def multiset_counts(gold: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """tp = sum of the smaller counts; fp and fn the rest."""
    sides = keyed(gold, by).withColumns({"g": F.lit(1), "q": F.lit(0)}).unionByName(keyed(pred, by).withColumns({"g": F.lit(0), "q": F.lit(1)}))
    keys = sides.groupBy(*by, "key").agg(F.sum("g").alias("g"), F.sum("q").alias("q"))
    return keys.groupBy(*by).agg(F.sum(F.least("g", "q")).alias("tp"), F.sum(F.greatest(F.col("q") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("q"), F.lit(0))).alias("fn"))


def error_histogram(records: DataFrame, kinds: list[str], column: str = "error_type") -> DataFrame:
    """Count and percent of every kind, also of those that don't occur."""
    spark = records.sparkSession
    dimension = spark.createDataFrame([(k,) for k in kinds], "kind string")
    counts = records.groupBy(F.col(column).alias("kind")).count()
    total = records.agg(F.count(F.lit(1)).alias("total"))
    return F.broadcast(dimension).join(counts, "kind", "left").crossJoin(F.broadcast(total)).select("kind", F.coalesce("count", F.lit(0)).alias("n"), F.round(100 * safe_ratio(F.coalesce("count", F.lit(0)), F.col("total")), 1).alias("pct"))


def classification(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of 0/1 columns."""
    one = lambda c: F.count_if(c)
    t, g = F.col(truth) == 1, F.col(guess) == 1
    sums = rows.agg(one(t & g).alias("tp"), one(~t & g).alias("fp"), one(t & ~g).alias("fn"), one(~t & ~g).alias("tn"))
    p, r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("tp", "fp", "fn", "tn", F.round(safe_ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6).alias("accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def rank_metrics(ranks: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """hits@k, mean rank and mean reciprocal rank of a ``rank`` column."""
    hits = [F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"hits_{k}") for k in ks]
    return ranks.agg(*hits, F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"))


def lea_scores(key: DataFrame, response: DataFrame) -> DataFrame:
    """Precision, recall and F1 of clusters: each side's links resolved by the other."""
    p, r = lea(response, key).select(F.col("lea").alias("precision")), lea(key, response).select(F.col("lea").alias("recall"))
    return p.crossJoin(r).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall")], F.round(f1(F.col("precision"), F.col("recall")), 6).alias("f1"))


def lea(key: DataFrame, response: DataFrame) -> DataFrame:
    """Link-based entity-aware recall of clusters (doc, cluster, mention): size-weighted share of resolved links; single mentions are
    skipped. Links are counted from cluster overlaps, n(n-1)/2 each, so no pair is made."""
    sizes = key.groupBy("doc", "cluster").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    both = key.join(response.withColumnRenamed("cluster", "other"), ["doc", "mention"]).groupBy("doc", "cluster", "other").agg(F.count(F.lit(1)).alias("n"))
    links = both.groupBy("doc", "cluster").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("found"))
    joined = sizes.join(links, ["doc", "cluster"], "left").withColumn("found", F.coalesce("found", F.lit(0.0)))
    share = F.col("found") / (F.col("size") * (F.col("size") - 1) / 2)
    return joined.agg(safe_ratio(F.sum(F.col("size") * share), F.sum("size")).alias("lea"), F.sum("size").alias("mentions"))
