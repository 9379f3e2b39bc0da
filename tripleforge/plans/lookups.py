"""Queries on the surface-form index, graph patterns and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripleforge.functions import similarity, text
from tripleforge.functions.text import ONTOLOGY, RESOURCE
from tripleforge.operators import graph, index
from tripleforge.operators.graph import WIKILINK

from . import tables
from .tables import EDGES_SQL, INDEX_SQL, load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def surface_table(spark, sf_dir):
    popularity = index.indegree(load(spark, sf_dir, "lineitem").select(tables.resource("Part", F.col("l_partkey")).alias("o")))
    return index.build_index(tables.forms(spark, sf_dir), popularity)


@query("surface_index", f"WITH {INDEX_SQL} SELECT * FROM sf")
def surface_index(spark, sf_dir):
    return surface_table(spark, sf_dir)


@query("popularity", f"SELECT '{RESOURCE}Part_' || l_partkey AS uri, count(*) AS indegree FROM lineitem GROUP BY 1")
def popularity(spark, sf_dir):
    return index.indegree(load(spark, sf_dir, "lineitem").select(tables.resource("Part", F.col("l_partkey")).alias("o")))


@query("insert_absent", f"""WITH {tables.FORMS_SQL}, own AS (SELECT DISTINCT surface, uri FROM forms WHERE tier = 1.0)
SELECT f.surface, f.uri, f.tier FROM forms f ANTI JOIN own USING (surface, uri) WHERE f.tier < 1.0""")
def insert_absent(spark, sf_dir):
    forms = tables.forms(spark, sf_dir)
    return index.insert_absent(forms.filter("tier = 1.0").select("surface", "uri"), forms.filter("tier < 1.0"))


@query("repair_tiers", f"""WITH {INDEX_SQL}, hit AS (SELECT DISTINCT surface, uri FROM forms WHERE tier = 0.8)
SELECT sf.surface, sf.uri, CASE WHEN hit.uri IS NULL THEN tier ELSE greatest(tier, 0.9) END AS tier,
  round(final * (CASE WHEN hit.uri IS NULL THEN tier ELSE greatest(tier, 0.9) END) / tier, 4) AS final
FROM sf LEFT JOIN hit ON sf.surface = hit.surface AND sf.uri = hit.uri""")
def repair_tiers(spark, sf_dir):
    return index.repair_tiers(surface_table(spark, sf_dir), tables.forms(spark, sf_dir).filter("tier = 0.8"), 0.9)


def mentions(spark, sf_dir):
    return load(spark, sf_dir, "part").select(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("_")).alias("mention")).distinct()


_POOL_SQL = f"""{INDEX_SQL}, m AS (SELECT DISTINCT p_name AS surface, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '_') AS mention FROM part)"""


@query("lookup_top15", f"""WITH {_POOL_SQL}
SELECT mention, sf.uri, tier, final, row_number() OVER (PARTITION BY mention ORDER BY tier DESC, final DESC, uri) AS rank FROM m JOIN sf ON sf.surface = m.surface QUALIFY rank <= 15""")
def lookup_top15(spark, sf_dir):
    pool = index.first_variant_pool(mentions(spark, sf_dir), surface_table(spark, sf_dir))
    return index.ranked(pool).select("mention", "uri", "tier", "final", "rank")


@query("rank_schemes", f"""WITH {_POOL_SQL}, pool AS (SELECT mention, sf.uri, tier, final FROM m JOIN sf ON sf.surface = m.surface)
SELECT mention, max(CASE WHEN a = 1 THEN uri END) AS tier_first, max(CASE WHEN b = 1 THEN uri END) AS final_only, max(CASE WHEN c = 1 THEN uri END) AS popularity, max(CASE WHEN d = 1 THEN uri END) AS blended FROM (
  SELECT mention, uri, row_number() OVER (PARTITION BY mention ORDER BY tier DESC, final DESC, uri) AS a, row_number() OVER (PARTITION BY mention ORDER BY final DESC, uri) AS b,
    row_number() OVER (PARTITION BY mention ORDER BY final / tier DESC, uri) AS c, row_number() OVER (PARTITION BY mention ORDER BY 0.5 * tier + 0.5 * ln(1 + final) DESC, uri) AS d FROM pool) GROUP BY mention""")
def rank_schemes(spark, sf_dir):
    pool = index.first_variant_pool(mentions(spark, sf_dir), surface_table(spark, sf_dir))
    return index.scheme_winners(pool)


@query("union_lookup", """WITH a AS (SELECT lower(p_name) AS form, 'B:' || p_brand AS uri, count(*) AS support FROM part GROUP BY 1, 2),
r AS (SELECT DISTINCT 'B:' || p_brand AS src, 'B:' || left(p_brand, 7) AS dst FROM part),
s AS (SELECT a.form AS mention, coalesce(r.dst, a.uri) AS uri, sum(support)::BIGINT AS support FROM a LEFT JOIN r ON a.uri = r.src GROUP BY 1, 2)
SELECT mention, uri, support, round(support / max(support) OVER (PARTITION BY mention), 6) AS share, row_number() OVER (PARTITION BY mention ORDER BY support DESC, uri) AS rank FROM s QUALIFY share >= 0.01 AND rank <= 5""")
def union_lookup(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    anchors = part.groupBy(F.lower("p_name").alias("form"), F.concat(F.lit("B:"), "p_brand").alias("uri")).agg(F.count(F.lit(1)).alias("support"))
    redirects = part.select(F.concat(F.lit("B:"), "p_brand").alias("src"), F.concat(F.lit("B:"), F.substring("p_brand", 1, 7)).alias("dst")).distinct()
    return index.union_lookup(part.select(F.lower("p_name").alias("mention")).distinct(), anchors, redirects)


_REDIRECTS_SQL = """r AS (SELECT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_orderkey <> o_custkey UNION ALL SELECT 1000000 + p_partkey, 1000001 + p_partkey FROM part UNION ALL SELECT 2000000 + s_suppkey, 2000000 + s_suppkey // 4 * 4 + (s_suppkey + 1) % 4 FROM supplier)"""


@query("redirect_closure", f"""WITH RECURSIVE {_REDIRECTS_SQL}, w AS (SELECT src, dst, [src] AS seen, 1 AS hops FROM r UNION ALL SELECT w.src, r.dst, list_append(seen, w.dst), hops + 1 FROM w JOIN r ON w.dst = r.src WHERE hops < 10 AND NOT list_contains(seen, w.dst))
SELECT src, max_by(dst, hops) AS dst FROM w GROUP BY src""")
def redirect_closure(spark, sf_dir):
    """Redirects of orders, one chain of all parts, and cycles of suppliers."""
    from tripleforge.plans.checkpoints import ensure

    ensure(spark)
    part, supplier = F.col("p_partkey"), F.col("s_suppkey")
    chains = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    chains = chains.unionByName(load(spark, sf_dir, "part").select((1_000_000 + part).alias("src"), (1_000_001 + part).alias("dst")))
    chains = chains.unionByName(load(spark, sf_dir, "supplier").select((2_000_000 + supplier).alias("src"), (2_000_000 + F.floor(supplier / 4) * 4 + (supplier + 1) % 4).alias("dst")))
    return index.redirect_closure(chains, 10)


def order_part_pairs(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    return lines.select(tables.resource("Order", F.col("l_orderkey")).alias("a"), tables.resource("Part", F.col("l_partkey")).alias("b")).distinct()


_PAIRS_SQL = f"""pairs AS (SELECT DISTINCT '{RESOURCE}Order_' || l_orderkey AS a, '{RESOURCE}Part_' || l_partkey AS b FROM lineitem)"""


@query("graph_between", f"""WITH {EDGES_SQL}, {_PAIRS_SQL} SELECT DISTINCT a, b, p, 'forward' AS direction FROM pairs JOIN edges ON a = s AND b = o
UNION SELECT a, b, p, 'inverse' FROM pairs JOIN edges ON b = s AND a = o""")
def graph_between(spark, sf_dir):
    return graph.between(tables.edges(spark, sf_dir), order_part_pairs(spark, sf_dir))


@query("graph_only_linked", f"WITH {EDGES_SQL} SELECT s, o FROM edges WHERE p = '{WIKILINK}' EXCEPT SELECT s, o FROM edges WHERE p <> '{WIKILINK}'")
def graph_only_linked(spark, sf_dir):
    return graph.only_linked(tables.edges(spark, sf_dir))


@query("graph_two_hop", f"""WITH {EDGES_SQL}, both_ways AS (SELECT s AS x, o AS y FROM edges UNION SELECT o, s FROM edges),
pairs AS (SELECT DISTINCT '{RESOURCE}Order_' || l_orderkey AS a, '{RESOURCE}Supplier_' || l_suppkey AS b FROM lineitem)
SELECT a, b, count(DISTINCT l.y) AS n_via FROM pairs JOIN both_ways l ON l.x = a JOIN both_ways r ON r.x = b AND r.y = l.y GROUP BY a, b""")
def graph_two_hop(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    return graph.two_hop(tables.edges(spark, sf_dir), lines.select(tables.resource("Order", F.col("l_orderkey")).alias("a"), tables.resource("Supplier", F.col("l_suppkey")).alias("b")))


@query("graph_linked", f"""WITH {EDGES_SQL}, pairs AS (SELECT DISTINCT '{RESOURCE}Customer_' || c_custkey AS a, '{RESOURCE}Nation_' || (c_custkey % 25) AS b FROM customer)
SELECT a, b FROM pairs WHERE EXISTS (SELECT 1 FROM edges WHERE (s = a AND o = b) OR (s = b AND o = a))""")
def graph_linked(spark, sf_dir):
    pairs = load(spark, sf_dir, "customer").select(tables.resource("Customer", F.col("c_custkey")).alias("a"), tables.resource("Nation", F.col("c_custkey") % 25).alias("b"))
    return graph.linked_either_way(tables.edges(spark, sf_dir), pairs)


@query("graph_exists", f"""WITH {EDGES_SQL}, n AS (SELECT s AS node FROM edges UNION SELECT o FROM edges), q AS (SELECT '{RESOURCE}Part_' || (p_partkey * 2) AS node FROM part)
SELECT q.node, n.node IS NOT NULL AS known FROM q LEFT JOIN n ON q.node = n.node""")
def graph_exists(spark, sf_dir):
    return graph.exists(tables.edges(spark, sf_dir), load(spark, sf_dir, "part").select(tables.resource("Part", F.col("p_partkey") * 2).alias("node")))


def claimed(spark, sf_dir):
    """Claims about orders: right, turned round, other predicate, or about nobody."""
    orders = load(spark, sf_dir, "orders")
    order, customer = tables.resource("Order", F.col("o_orderkey")), tables.resource("Customer", F.col("o_custkey"))
    kind = F.col("o_orderkey") % 5
    s = F.when(kind == 1, customer).when(kind == 4, F.concat(order, F.lit("x"))).otherwise(order)
    o = F.when(kind == 1, order).when(kind == 3, F.concat(customer, F.lit("x"))).otherwise(customer)
    return orders.select(s.alias("s"), F.when(kind == 2, ONTOLOGY + "buyer").otherwise(ONTOLOGY + "customer").alias("p"), o.alias("o"))


_CLAIMS_SQL = f"""claims AS (SELECT CASE o_orderkey % 5 WHEN 1 THEN cu WHEN 4 THEN od || 'x' ELSE od END AS s, '{ONTOLOGY}' || CASE WHEN o_orderkey % 5 = 2 THEN 'buyer' ELSE 'customer' END AS p,
  CASE o_orderkey % 5 WHEN 1 THEN od WHEN 3 THEN cu || 'x' ELSE cu END AS o FROM (SELECT *, '{RESOURCE}Order_' || o_orderkey AS od, '{RESOURCE}Customer_' || o_custkey AS cu FROM orders))"""


@query("graph_verify", f"""WITH {EDGES_SQL}, {_CLAIMS_SQL}, n AS (SELECT s AS node FROM edges UNION SELECT o FROM edges), so AS (SELECT s, o FROM edges UNION SELECT o, s FROM edges)
SELECT c.s, c.p, c.o, CASE WHEN e.s IS NOT NULL THEN 'VERIFIED' WHEN i.s IS NOT NULL THEN 'INVERTED' WHEN so.s IS NOT NULL THEN 'RELATED'
  WHEN n1.node IS NOT NULL AND n2.node IS NOT NULL THEN 'FAITHFUL' WHEN n1.node IS NOT NULL THEN 'OBJ_MISSING' ELSE 'REJECTED' END AS status
FROM claims c LEFT JOIN edges e ON e.s = c.s AND e.p = c.p AND e.o = c.o LEFT JOIN edges i ON i.o = c.s AND i.p = c.p AND i.s = c.o LEFT JOIN so ON so.s = c.s AND so.o = c.o
LEFT JOIN n n1 ON n1.node = c.s LEFT JOIN n n2 ON n2.node = c.o""")
def graph_verify(spark, sf_dir):
    return graph.verify(tables.edges(spark, sf_dir), claimed(spark, sf_dir))


@query("graph_verify_all", f"""WITH {EDGES_SQL}, {_CLAIMS_SQL}, n AS (SELECT s AS node FROM edges UNION SELECT o FROM edges), so AS (SELECT s, o FROM edges UNION SELECT o, s FROM edges),
d AS (SELECT DISTINCT s, p, o FROM (SELECT * FROM claims UNION ALL SELECT '{RESOURCE}Nation_' || (c_custkey % 25), '{ONTOLOGY}livesIn', '{RESOURCE}Customer_' || c_custkey FROM customer)),
home AS (SELECT s FROM edges WHERE p = '{ONTOLOGY}nation' AND o = '{RESOURCE}Nation_3'), unasked AS (SELECT '{RESOURCE}Order_' || o_orderkey || 'x' AS node FROM orders WHERE o_orderkey % 10 = 9), idx AS (SELECT '{RESOURCE}Customer_' || c_custkey || 'x' AS node FROM customer WHERE c_custkey % 2 = 0)
SELECT d.s, d.p, d.o, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.s = d.s AND e.p = d.p AND e.o = d.o) THEN 'VERIFIED'
  WHEN d.p <> '{ONTOLOGY}customer' AND EXISTS (SELECT 1 FROM edges e WHERE e.s = d.o AND e.p = d.p AND e.o = d.s) THEN 'INVERTED'
  WHEN d.p = '{ONTOLOGY}customer' AND d.o NOT IN (SELECT s FROM home) AND d.s IN (SELECT s FROM home) THEN 'INVERTED'
  WHEN EXISTS (SELECT 1 FROM so WHERE so.s = d.s AND so.o = d.o) THEN 'RELATED' WHEN d.s IN (SELECT node FROM unasked) OR d.o IN (SELECT node FROM unasked) THEN 'UNVERIFIED'
  WHEN d.s IN (SELECT node FROM n) AND d.o IN (SELECT node FROM n) THEN 'FAITHFUL' WHEN d.s IN (SELECT node FROM n) AND d.o IN (SELECT node FROM idx) THEN 'UNVERIFIED' WHEN d.s IN (SELECT node FROM n) THEN 'OBJ_MISSING' ELSE 'REJECTED' END AS status FROM d""")
def graph_verify_all(spark, sf_dir):
    """The whole ladder: a symmetric predicate is never turned, a range that only the subject fits turns a claim, names that the index has and
    resources that could not be asked for are accepted unverified."""
    customer, orders = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    lives = customer.select(tables.resource("Nation", F.col("c_custkey") % 25).alias("s"), F.lit(ONTOLOGY + "livesIn").alias("p"), tables.resource("Customer", F.col("c_custkey")).alias("o"))
    other = lambda name, key: F.concat(tables.resource(name, F.col(key)), F.lit("x")).alias("node")
    ranges = spark.createDataFrame([(ONTOLOGY + "customer", RESOURCE + "Nation_3")], "p string, range string")
    claims = claimed(spark, sf_dir).unionByName(lives).distinct()
    return graph.verify(tables.edges(spark, sf_dir), claims, (ONTOLOGY + "customer",), customer.filter("c_custkey % 2 = 0").select(other("Customer", "c_custkey")), orders.filter("o_orderkey % 10 = 9").select(other("Order", "o_orderkey")), ranges, ONTOLOGY + "nation")


@query("graph_degrees", f"WITH {EDGES_SQL} SELECT node, count(*) AS degree FROM (SELECT s AS node FROM edges UNION ALL SELECT o FROM edges) GROUP BY node")
def graph_degrees(spark, sf_dir):
    return graph.degrees(tables.edges(spark, sf_dir))


@query("graph_relation_counts", f"WITH {EDGES_SQL} SELECT p, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM edges GROUP BY p")
def graph_relation_counts(spark, sf_dir):
    return tables.edges(spark, sf_dir).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))


@query("graph_k_core")
def graph_k_core(spark, sf_dir):
    from tripleforge.plans.checkpoints import ensure

    ensure(spark)
    return graph.k_core(tables.edges(spark, sf_dir), 6, 50)


@query("graph_domain_range", f"""WITH {EDGES_SQL}, t AS (SELECT s, p, o, regexp_extract(s, 'resource/([A-Za-z]+)_', 1) AS domain, regexp_extract(o, 'resource/([A-Za-z]+)_', 1) AS "range" FROM edges)
SELECT p, array_to_string(list_sort(list(DISTINCT domain)), ',') AS domains, array_to_string(list_sort(list(DISTINCT "range")), ',') AS ranges FROM t GROUP BY p""")
def graph_domain_range(spark, sf_dir):
    kind = lambda c: F.regexp_extract(c, "resource/([A-Za-z]+)_", 1)
    return tables.edges(spark, sf_dir).groupBy("p").agg(F.array_join(F.sort_array(F.collect_set(kind("s"))), ",").alias("domains"), F.array_join(F.sort_array(F.collect_set(kind("o"))), ",").alias("ranges"))


@query("top_relations", "SELECT p_type AS name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, name DESC LIMIT 20")
def top_relations(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("name")).limit(20)


@query("entity_types", f"WITH {EDGES_SQL} SELECT s, array_to_string(list_sort(list(DISTINCT o)), ' ') AS types FROM edges WHERE p = '{ONTOLOGY}nation' GROUP BY s")
def entity_types(spark, sf_dir):
    own = tables.edges(spark, sf_dir).filter(F.col("p") == ONTOLOGY + "nation")
    return own.groupBy("s").agg(F.array_join(F.sort_array(F.collect_set("o")), " ").alias("types"))


@query("label_search", "SELECT p_partkey AS id, p_name AS label FROM part WHERE contains(lower(p_name), 'ring') ORDER BY id LIMIT 30")
def label_search(spark, sf_dir):
    return load(spark, sf_dir, "part").filter(F.lower("p_name").contains("ring")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")).orderBy("id").limit(30)


@query("majority_vote", "SELECT c_nationkey, c_mktsegment AS winner, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1")
def majority_vote(spark, sf_dir):
    counts = load(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    order = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "c_mktsegment"))
    return counts.withColumn("k", order).filter("k = 1").select("c_nationkey", F.col("c_mktsegment").alias("winner"), "n")


@query("best_and_runner_up", """SELECT l_orderkey AS id, max(CASE WHEN k = 1 THEN l_partkey END) AS best, max(CASE WHEN k = 2 THEN l_partkey END) AS runner_up, max(CASE WHEN k = 1 THEN l_extendedprice END) AS score, max(CASE WHEN k = 2 THEN l_extendedprice END) AS runner_up_score
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS k FROM lineitem) GROUP BY 1""")
def best_and_runner_up(spark, sf_dir):
    window = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber")
    ranked = load(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(window)).filter("k <= 2")
    pick = lambda c, k, name: F.max(F.when(F.col("k") == k, F.col(c))).alias(name)
    return ranked.groupBy(F.col("l_orderkey").alias("id")).agg(pick("l_partkey", 1, "best"), pick("l_partkey", 2, "runner_up"), pick("l_extendedprice", 1, "score"), pick("l_extendedprice", 2, "runner_up_score"))


@query("joint_pairs", """WITH s AS (SELECT l_orderkey AS id, l_partkey AS sub, l_extendedprice AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS k FROM lineitem QUALIFY k <= 5),
o AS (SELECT l_orderkey AS id, l_suppkey AS obj, l_quantity AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_suppkey, l_linenumber) AS k FROM lineitem QUALIFY k <= 5)
SELECT id, sub, obj, round((s.score + o.score) / 2, 4) AS score, row_number() OVER (PARTITION BY id ORDER BY (s.score + o.score) / 2 DESC, s.k, o.k) AS rank FROM s JOIN o USING (id) QUALIFY rank <= 5""")
def joint_pairs(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")

    def side(item, score, name):
        window = Window.partitionBy("l_orderkey").orderBy(F.desc(score), item, "l_linenumber")
        return lines.withColumn("k", F.row_number().over(window)).filter("k <= 5").select(F.col("l_orderkey").alias("id"), F.col(item).alias(name), F.col(score).alias(f"{name}_score"), F.col("k").alias(f"{name}_k"))

    pairs = side("l_partkey", "l_extendedprice", "sub").join(side("l_suppkey", "l_quantity", "obj"), "id").withColumn("raw", (F.col("sub_score") + F.col("obj_score")) / 2)
    window = Window.partitionBy("id").orderBy(F.desc("raw"), "sub_k", "obj_k")
    return pairs.withColumn("rank", F.row_number().over(window).cast("long")).filter("rank <= 5").select("id", "sub", "obj", F.round("raw", 4).alias("score"), "rank")


@query("surface_variants")
def surface_variants(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.surface_variants(F.concat(F.lit("The "), "p_type", F.lit("-"), "p_brand"))).alias("pos", "variant"))
