"""Nearest vectors by blocks of rows and queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries of a block on average; a task holds one block of each.
ROW_BLOCK, QUERY_BLOCK = 20_000, 1_000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = [np.asarray(v, np.float64) for v in column.to_pylist()]
    return np.array(rows) if rows else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12) if m.size else m


def top_k(rows: DataFrame, queries: DataFrame, k: int, itself: bool = False) -> DataFrame:
    """(query_id, vec_id, sim, rank) of the ``k`` most similar rows (vec_id, embedding) of each query (query_id, embedding), by cosine to six
    digits; ties by vec_id. A query's own row is left out unless ``itself``.

    Every block of rows meets every block of queries in one matrix product, which gives k candidates a query; blocks grow in
    number with the tables, not in size. Null and empty vectors are left out."""
    rows, queries = (d.filter("size(embedding) > 0") for d in (rows, queries))
    row_blocks, query_blocks = (max(1, -(-d.count() // size)) for d, size in ((rows, ROW_BLOCK), (queries, QUERY_BLOCK)))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int").alias("rb"), blocks(query_blocks).alias("qb"))
    right = queries.select("query_id", F.col("embedding").alias("q"), F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("qb"), blocks(row_blocks).alias("rb"))

    def best(key, own: pa.Table, asked: pa.Table) -> pa.Table:
        ids, query_ids = own.column("vec_id").to_numpy(), asked.column("query_id").to_numpy()
        out = {"query_id": [], "vec_id": [], "sim": []}
        if len(ids) and len(query_ids):
            sims = np.round(_unit(_matrix(asked.column("q"))) @ _unit(_matrix(own.column("embedding"))).T, 6) + 0.0
            for query, sim in zip(query_ids, sims, strict=True):
                at = np.lexsort((ids, -sim))
                at = (at if itself else at[ids[at] != query])[:k]
                out["query_id"].append(np.full(len(at), query))
                out["vec_id"].append(ids[at])
                out["sim"].append(sim[at])
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, float if c == "sim" else np.int64) for c, v in out.items()})

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(best, "query_id long, vec_id long, sim double")
    window = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return found.withColumn("rank", F.row_number().over(window).cast("long")).filter(F.col("rank") <= k)
