"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, load, lower_ascii, materialize, numbered, own_ids, small_enough

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: Of an item with more shingles than this, a bottom-k MinHash sketch of this size is searched for.
SKETCH = 32
#: Chance that the search misses an item that reaches the containment.
MISS = 1e-9
#: Sketch rows (16 bytes of data each) and candidate ids up to these numbers are broadcast.
BROADCAST_SKETCHES = 500_000
BROADCAST_IDS = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BLANKS, -1), lambda w: w != "")


def shingle_hashes(text: Column, n: int = SHINGLE_WORDS) -> Column:
    """Distinct hashes of the word shingles; the whole sequence is one where it is shorter."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    body = lambda h: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(n)]))).when(F.size(h) > 0, F.array(F.xxhash64(F.lit(n), F.array_join(h.cast("array<string>"), " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.element_at(F.transform(F.array(hashed), body), 1))


def shingle_texts(text: Column, n: int = SHINGLE_WORDS) -> Column:
    """Distinct shingles as texts, as ``shingle_hashes`` has their hashes."""
    body = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.element_at(F.transform(F.array(words(text)), body), 1))


def least_hits(size: int, containment: float = CONTAINMENT, sketch: int = SKETCH, miss: float = MISS) -> int:
    """Hits in the sketch from which a document is a candidate: all that the containment asks for where the
    sketch is the whole set, else as many as a sample of the sketch falls short of with chance ``miss`` at most."""
    need = math.ceil(round(containment * size, 9))
    if size <= sketch:
        return max(1, need)
    short, hits = 0.0, 0
    while True:
        short += math.comb(sketch, hits) * containment**hits * (1 - containment) ** (sketch - hits)
        if short > miss:
            return max(1, hits)
        hits += 1


def sketches(items: DataFrame, n: int, containment: float, sketch: int) -> DataFrame:
    """(item_id, size_class, n_item, shingle) of each item's sketch: the ``sketch`` smallest values of a second hash."""
    sets = items.select("item_id", shingle_hashes(F.col("text"), n).alias("s")).filter("item_id IS NOT NULL AND size(s) > 0")
    ordered = F.transform(F.slice(F.array_sort(F.transform("s", lambda x: F.struct(F.xxhash64(x, F.lit(1)).alias("h"), x.alias("x")))), 1, sketch), lambda p: p["x"])
    size_class = F.floor(F.log2(F.size("s").cast("double"))).cast("int")
    return sets.select("item_id", size_class.alias("size_class"), F.size("s").alias("n_item"), F.explode(ordered).alias("shingle"))


def contaminated(docs: DataFrame, items: DataFrame, n: int = SHINGLE_WORDS, containment: float = CONTAINMENT, sketch: int = SKETCH) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_hits, containment) where a document holds at least that share of an item's shingles.

    Items are partitioned by the power of two of their size. Short ones are searched for by their whole set, the
    others by a bottom-k MinHash sketch, which a document of any length holds in proportion to its
    containment, so a long document doesn't dilute a short item. A document with enough of an item's
    sketch (for its size class) and enough shingles at all is a candidate; candidates are verified by exact containment of
    shingle texts. The chance to miss a pair is MISS at most, and no pair is wrong.

    Nulls: null and empty texts hold nothing, items without words or id are not searched for, a null doc_id is
    reported like others. Of rows with one doc_id, the best counts. Words are lower-cased (A-Z). An item
    with fewer words than a shingle is found only in a text that is just these words. Empty tables give no pairs.
    """
    # (needed hits by exact size) a fixed function of n_item, given as a small literal up to the sketch size
    full = F.element_at(F.array(*[F.lit(least_hits(k, containment, sketch)) for k in range(1, sketch + 1)]), F.least(F.col("n_item"), F.lit(sketch)))
    need = F.when(F.col("n_item") <= sketch, full).otherwise(F.lit(least_hits(sketch + 1, containment, sketch)))
    search = materialize(sketches(items, n, containment, sketch).withColumn("need", need).withColumn("least", F.ceil(F.lit(containment) * F.col("n_item") - 1e-9)))
    shingles = docs.select("doc_id", shingle_hashes(F.col("text"), n).alias("s"))
    exploded = shingles.select("doc_id", F.size("s").alias("n_doc"), F.explode("s").alias("shingle"))
    hits = exploded.join(F.broadcast(search) if small_enough(search, BROADCAST_SKETCHES) else search, "shingle").filter("n_doc >= least")
    pairs = hits.groupBy("doc_id", "item_id", "need").agg(F.size(F.collect_set("shingle")).alias("n")).filter("n >= need").select("doc_id", "item_id")
    pairs = materialize(pairs)
    ids = pairs.select(F.col("doc_id").alias("__id")).distinct()
    few = small_enough(ids, BROADCAST_IDS)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(F.col("doc_id").alias("__id"), shingle_texts(F.col("text"), n).alias("has"))
    wanted = items.select("item_id", shingle_texts(F.col("text"), n).alias("wants"))
    verified = pairs.join(wanted, "item_id").join(texts, F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc_id", "item_id", F.size("wants").cast("long").alias("n_item"), F.size(F.array_intersect("wants", "has")).cast("long").alias("n_hits"))
    best = verified.groupBy("doc_id", "item_id", "n_item").agg(F.max("n_hits").alias("n_hits"))
    return best.withColumn("containment", F.col("n_hits") / F.col("n_item")).filter(F.col("n_hits") * 100 >= F.col("n_item") * round(containment * 100))


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns; each row goes by its own text, also where ids are shared or null."""
    if own_ids(docs):
        return docs.join(contaminated(docs, items).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    each = numbered(docs)
    found = contaminated(each.select(F.col("number").alias("doc_id"), "text"), items).select(F.col("doc_id").alias("number")).distinct()
    return each.join(found, "number", "left_anti").select("row.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


_SETS = """SELECT {id}, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
  FROM (SELECT {id}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table})"""
SQL = f"""
WITH d AS ({_SETS.format(id="doc_id", table="documents")}),
b AS ({_SETS.format(id="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS n_hits FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_hits, n_hits / n_item AS containment FROM h JOIN n USING (item_id) WHERE n_hits * 100 >= n_item * 80
"""
