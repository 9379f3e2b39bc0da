"""Ranks over a whole table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(rows: DataFrame, coarse: dict[str, Column], order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their rank (from 1) in the order of ``coarse``, then ``order``.

    The coarse columns lead the order and cut it into groups that a task can sort. Only the groups' sizes meet in one place: one row a
    group, so the coarse columns must not have as many values as there are rows."""
    own = rows.withColumns(coarse)
    keys = list(coarse)
    sizes = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = own.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = placed.join(offsets, same).withColumn(name, (F.col("__before") + F.col("__place")).cast("long"))
    return out.drop("__before", "__place", *[f"__{k}" for k in keys], *[k for k in keys if k not in rows.columns])


def smallest(rows: DataFrame, n: int, digest: Column, tie: str) -> DataFrame:
    """The ``n`` rows with the smallest hex digests, then ``tie``. Whole groups of digests are taken by their sizes (65,536 groups at most
    come to the driver); only the last group that is needed is sorted."""
    own = rows.withColumn("__d", digest).withColumn("__b", F.substring("__d", 1, 4))
    taken, last = 0, None
    for row in sorted(own.groupBy("__b").count().collect()):
        if taken + row["count"] > n:
            last = row["__b"]
            break
        taken += row["count"]
    if last is None:
        return own.drop("__d", "__b")
    edge = own.filter(F.col("__b") == last).withColumn("__k", F.row_number().over(Window.partitionBy("__b").orderBy("__d", tie)))
    return own.filter(F.col("__b") < last).unionByName(edge.filter(F.col("__k") <= n - taken).drop("__k")).drop("__d", "__b")
