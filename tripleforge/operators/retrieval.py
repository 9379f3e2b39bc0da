"""BM25 statistics and retrieval, and diverse re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleforge.functions.text import tokens


def bm25_statistics(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (id, token, tf, dl) and statistics (token, df, idf, avgdl) of documents (id, text)."""
    words = docs.select("id", F.explode(tokens(F.col("text"))).alias("token"))
    tf = words.groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    lengths = docs.select("id", F.size(tokens(F.col("text"))).cast("long").alias("dl"))
    total = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return tf.join(lengths, "id"), df.crossJoin(F.broadcast(total)).select("token", "df", idf.alias("idf"), "avgdl")


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = 24, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The k best documents of each query (qid, text); joins on tokens, so only postings of query words move."""
    postings, stats = bm25_statistics(docs)
    asked = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = asked.join(stats, "token").join(postings, "token").groupBy("qid", "id").agg(F.round(F.sum(weight), 6).alias("score"))
    window = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(window).cast("long")).filter(F.col("rank") <= k)


def mmr(pool: DataFrame, k: int = 6, weight: float = 0.5) -> DataFrame:
    """Maximal marginal relevance over each query's pool (qid, id, score, text): a bounded pool a group, so grouped pandas."""
    import pandas as pd

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        import re

        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        sets = [set(re.findall("[a-z0-9]+", (t or "").lower())) for t in rows["text"]]
        top = max(float(rows["score"].max()), 1e-12)
        chosen: list[int] = []
        while len(chosen) < min(k, len(rows)):
            best, best_value = -1, float("-inf")
            for i in range(len(rows)):
                if i in chosen:
                    continue
                near = max((len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for j in chosen), default=0.0)
                value = weight * float(rows["score"][i]) / top - (1 - weight) * near
                if value > best_value:
                    best, best_value = i, value
            chosen.append(best)
        return pd.DataFrame({"qid": rows["qid"].iloc[chosen].values, "id": rows["id"].iloc[chosen].values, "pick": range(1, len(chosen) + 1)})

    return pool.groupBy("qid").applyInPandas(pick, "qid long, id long, pick long")
