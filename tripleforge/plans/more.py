"""Queries on filters, set-containment joins, splits, weights and clustering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripleforge.functions.similarity import safe_ratio
from tripleforge.functions.text import ONTOLOGY
from tripleforge.operators import graph
from tripleforge.operators.ranks import global_rank

from . import tables
from .tables import EDGES_SQL, TRIPLES_SQL, load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


BLOCKED = ("Brand#1", "ECONOMY", "ring")


@query("uri_blacklist", "SELECT p_partkey FROM part WHERE NOT (contains(p_name, 'ring') OR contains(p_brand, 'Brand#1') OR contains(p_type, 'ECONOMY'))")
def uri_blacklist(spark, sf_dir):
    """Substring blacklist over all slots."""
    slots = F.concat_ws("|", "p_name", "p_brand", "p_type")
    hit = F.lit(False)
    for pattern in BLOCKED:
        hit = hit | slots.contains(pattern)
    return load(spark, sf_dir, "part").filter(~hit).select("p_partkey")


@query("kept_triples", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_discount >= 0.02 AND l_returnflag <> 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) <= 5")
def kept_triples(spark, sf_dir):
    """Confidence and kind filters, then the first five that survive of a sentence."""
    kept = load(spark, sf_dir, "lineitem").filter("l_discount >= 0.02 AND l_returnflag <> 'R'")
    window = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return kept.withColumn("k", F.row_number().over(window)).filter("k <= 5").select("l_orderkey", "l_partkey", "l_linenumber")


@query("predicate_whitelist", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def predicate_whitelist(spark, sf_dir):
    allowed = load(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf_dir, "orders").join(allowed, "o_custkey", "left_semi").select("o_orderkey")


@query("co_mentions", r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.\n]')) AS s FROM documents) WHERE contains(lower(s), 'the ') AND contains(lower(s), ' of ') GROUP BY doc_id")
def co_mentions(spark, sf_dir):
    """Sentences that hold both names, whatever their case."""
    sentences = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"[.\n]", -1)).alias("s"))
    both = F.lower("s").contains("the ") & F.lower("s").contains(" of ")
    return sentences.filter(both).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("head_tail_labels", "SELECT o_orderkey, c_name AS head, n_name AS tail FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def head_tail_labels(spark, sf_dir):
    customer, nation = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    joined = load(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("o_orderkey", F.col("c_name").alias("head"), F.col("n_name").alias("tail"))


@query("seed_pairs", """WITH b AS (SELECT l_orderkey AS id, list(DISTINCT l_returnflag) AS s FROM lineitem GROUP BY 1), p AS (SELECT * FROM (VALUES (0, 'A', 'N'), (1, 'N', 'R'), (2, 'A', 'R')) t(pos, a, b))
SELECT id, max_by(p.a || p.b, pos) AS pair FROM b JOIN p ON list_contains(s, p.a) AND list_contains(s, p.b) GROUP BY id""")
def seed_pairs(spark, sf_dir):
    """The last seed pair that a sentence's entity set holds; the seeds are three rows, so they are broadcast."""
    sets = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_returnflag").alias("s"))
    seeds = F.broadcast(spark.createDataFrame([(0, "A", "N"), (1, "N", "R"), (2, "A", "R")], "pos int, a string, b string"))
    hits = sets.join(seeds, F.array_contains("s", seeds["a"]) & F.array_contains("s", seeds["b"]))
    return hits.groupBy("id").agg(F.max_by(F.concat("a", "b"), "pos").alias("pair"))


@query("in_range", f"""WITH {EDGES_SQL}, t AS (SELECT s, p, o FROM edges WHERE p = '{ONTOLOGY}customer' OR p = '{ONTOLOGY}region')
SELECT s, p, o, CASE WHEN p = '{ONTOLOGY}customer' THEN EXISTS (SELECT 1 FROM edges e WHERE e.s = t.o AND e.p = '{ONTOLOGY}nation' AND e.o = 'http://kg.example.org/resource/Nation_3') END AS in_range FROM t""")
def in_range(spark, sf_dir):
    edges = tables.edges(spark, sf_dir)
    ranges = spark.createDataFrame([(ONTOLOGY + "customer", "http://kg.example.org/resource/Nation_3")], "p string, range string")
    return graph.range_members(edges, edges.filter(F.col("p").isin(ONTOLOGY + "customer", ONTOLOGY + "region")), ranges, ONTOLOGY + "nation")


@query("optimal_weights", """WITH g AS (SELECT l_orderkey AS id, max(l_discount) AS tv, max(l_tax) AS tl, min(l_discount) AS iv, max(l_quantity) / 50 AS il FROM lineitem GROUP BY 1), w AS (SELECT unnest(range(0, 21)) AS k),
m AS (SELECT id, k, round((k * 5 / 100) * tv + (1 - k * 5 / 100) * tl - ((k * 5 / 100) * iv + (1 - k * 5 / 100) * il), 9) AS margin FROM g, w)
SELECT id, coalesce(min_by(k, k) FILTER (margin = best AND margin > 0), 0)::BIGINT AS step FROM (SELECT *, max(margin) OVER (PARTITION BY id) AS best FROM m) GROUP BY id""")
def optimal_weights(spark, sf_dir):
    """Of 21 weights the one with the best positive margin of the target over the impostor; the lower of equal ones, else none."""
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_discount").alias("tv"), F.max("l_tax").alias("tl"), F.min("l_discount").alias("iv"), (F.max("l_quantity") / 50).alias("il"))

    def margin(k):
        w = k * 5 / F.lit(100.0)
        return F.round(w * F.col("tv") + (1 - w) * F.col("tl") - (w * F.col("iv") + (1 - w) * F.col("il")), 9)

    margins = F.transform(F.sequence(F.lit(0), F.lit(20)), margin)
    best = F.aggregate(margins, F.struct(F.lit(0.0).alias("m"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("i")), lambda s, m: F.struct(F.greatest(s["m"], m).alias("m"), F.when(m > s["m"], s["i"]).otherwise(s["k"]).alias("k"), (s["i"] + 1).alias("i")), lambda s: s["k"])
    return rows.select("id", best.alias("step"))


@query("hash_split", "SELECT o_orderkey, CASE WHEN k < 8 THEN 'train' WHEN k < 9 THEN 'valid' ELSE 'test' END AS part FROM (SELECT o_orderkey, ('0x' || substr(md5('42|' || o_orderkey), 1, 8))::BIGINT % 10 AS k FROM orders)")
def hash_split(spark, sf_dir):
    """80/10/10 by a seeded hash, so a rerun or another partitioning gives the same split."""
    k = F.conv(F.substring(F.md5(F.concat(F.lit("42|"), F.col("o_orderkey").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 10
    return load(spark, sf_dir, "orders").select("o_orderkey", F.when(k < 8, "train").when(k < 9, "valid").otherwise("test").alias("part"))


@query("entity_ids", "SELECT p_brand, (dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT AS id FROM (SELECT DISTINCT p_brand FROM part)")
def entity_ids(spark, sf_dir):
    """Integer ids in name order: names are sorted within groups of their first letters."""
    names = load(spark, sf_dir, "part").select("p_brand").distinct()
    return global_rank(names, {"__head": F.substring("p_brand", 1, 7)}, [F.col("p_brand")], "id").withColumn("id", F.col("id") - 1)


@query("under_extraction", f"WITH {TRIPLES_SQL}, g AS (SELECT id, count(*) AS g FROM gk GROUP BY 1), p AS (SELECT id, count(*) AS q FROM pk GROUP BY 1) SELECT sum(greatest(g - coalesce(q, 0), 0))::BIGINT AS missing, count(*) FILTER (g = coalesce(q, 0)) AS complete, count(*) FILTER (q IS NULL) AS without FROM g LEFT JOIN p USING (id)")
def under_extraction(spark, sf_dir):
    count = lambda df, name: df.groupBy("id").agg(F.count(F.lit(1)).alias(name))
    joined = count(tables.gold(spark, sf_dir), "g").join(count(tables.predicted(spark, sf_dir), "q"), "id", "left")
    q = F.coalesce("q", F.lit(0))
    return joined.agg(F.sum(F.greatest(F.col("g") - q, F.lit(0))).alias("missing"), F.count_if(F.col("g") == q).alias("complete"), F.count_if(F.col("q").isNull()).alias("without"))


@query("generation_check", "SELECT count(*) AS n_rows, count(*) FILTER (trim(coalesce(text, '')) = '') AS n_empty, count(DISTINCT text) AS n_unique, count(*) - count(DISTINCT text) AS n_duplicate FROM conversations")
def generation_check(spark, sf_dir):
    n, unique = F.count(F.lit(1)), F.count_distinct("text")
    return load(spark, sf_dir, "conversations").agg(n.alias("n_rows"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("n_empty"), unique.alias("n_unique"), (n - unique).alias("n_duplicate"))


@query("gold_by_text", """WITH g AS (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1)
SELECT conv_id, turn, coalesce(ids, '') AS ids FROM conversations LEFT JOIN g ON key = lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))""")
def gold_by_text(spark, sf_dir):
    """Gold lists of equal normalised text put together, and attached by that text."""
    from tripleforge.functions.text import normalize

    key = F.md5(normalize(F.col("text")).cast("binary"))
    gold = load(spark, sf_dir, "documents").groupBy(key.alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return load(spark, sf_dir, "conversations").withColumn("key", key).join(gold, "key", "left").select("conv_id", "turn", F.coalesce("ids", F.lit("")).alias("ids"))


@query("bootstrap_rounds", "SELECT event_id, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100)::BIGINT AS round, event_type FROM events")
def bootstrap_rounds(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    return load(spark, sf_dir, "events").select("event_id", F.floor((place - 1) / 100).cast("long").alias("round"), "event_type")


@query("method_comparison", "SELECT l_returnflag AS method, count(*) AS n, count(DISTINCT l_orderkey) AS sentences, round(count(*) / count(DISTINCT l_orderkey), 6) AS per_sentence FROM lineitem GROUP BY 1")
def method_comparison(spark, sf_dir):
    n, sentences = F.count(F.lit(1)), F.count_distinct("l_orderkey")
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(n.alias("n"), sentences.alias("sentences"), F.round(safe_ratio(n, sentences), 6).alias("per_sentence"))


@query("review_queue", "SELECT o_orderkey, CASE WHEN o_totalprice >= 250000 THEN 'auto' ELSE 'review' END AS queue FROM orders")
def review_queue(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") >= 250000, "auto").otherwise("review").alias("queue"))


@query("vector_clusters")
def vector_clusters(spark, sf_dir):
    """k-means, k by the best silhouette of three."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = load(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    fitted = [KMeans(k=k, seed=42, maxIter=10).fit(rows) for k in (4, 8, 12)]
    best = max(fitted, key=lambda m: ClusteringEvaluator().evaluate(m.transform(rows)))
    return best.transform(rows).select("vec_id", F.col("prediction").cast("long").alias("cluster"))
