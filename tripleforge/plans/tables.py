"""Tables that the registered queries derive from the test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleforge.functions.text import ONTOLOGY, RESOURCE, normalize
from tripleforge.operators.graph import WIKILINK


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def resource(name: str, key):
    return F.concat(F.lit(f"{RESOURCE}{name}_"), key.cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge-graph edges (s, p, o) of the star schema; order lines are wikilinks."""
    nation = load(spark, sf_dir, "nation")
    p = lambda name: F.lit(ONTOLOGY + name)
    parts = [
        nation.select(resource("Nation", F.col("n_nationkey")), p("region"), resource("Region", F.col("n_regionkey"))),
        load(spark, sf_dir, "customer").select(resource("Customer", F.col("c_custkey")), p("nation"), resource("Nation", F.col("c_nationkey"))),
        load(spark, sf_dir, "supplier").select(resource("Supplier", F.col("s_suppkey")), p("nation"), resource("Nation", F.col("s_nationkey"))),
        load(spark, sf_dir, "orders").select(resource("Order", F.col("o_orderkey")), p("customer"), resource("Customer", F.col("o_custkey"))),
        load(spark, sf_dir, "lineitem").select(resource("Order", F.col("l_orderkey")), F.lit(WIKILINK), resource("Part", F.col("l_partkey"))),
        load(spark, sf_dir, "lineitem").filter("l_quantity >= 40").select(resource("Order", F.col("l_orderkey")), p("part"), resource("Part", F.col("l_partkey"))),
        load(spark, sf_dir, "lineitem").select(resource("Part", F.col("l_partkey")), p("supplier"), resource("Supplier", F.col("l_suppkey"))),
    ]
    out = parts[0].toDF("s", "p", "o")
    for part in parts[1:]:
        out = out.union(part.toDF("s", "p", "o"))
    return out.distinct()


def _r(name: str, key: str) -> str:
    return f"'{RESOURCE}{name}_' || {key}"


EDGES_SQL = f"""edges AS (
  SELECT {_r('Nation', 'n_nationkey')} AS s, '{ONTOLOGY}region' AS p, {_r('Region', 'n_regionkey')} AS o FROM nation
  UNION SELECT {_r('Customer', 'c_custkey')}, '{ONTOLOGY}nation', {_r('Nation', 'c_nationkey')} FROM customer
  UNION SELECT {_r('Supplier', 's_suppkey')}, '{ONTOLOGY}nation', {_r('Nation', 's_nationkey')} FROM supplier
  UNION SELECT {_r('Order', 'o_orderkey')}, '{ONTOLOGY}customer', {_r('Customer', 'o_custkey')} FROM orders
  UNION SELECT {_r('Order', 'l_orderkey')}, '{WIKILINK}', {_r('Part', 'l_partkey')} FROM lineitem
  UNION SELECT {_r('Order', 'l_orderkey')}, '{ONTOLOGY}part', {_r('Part', 'l_partkey')} FROM lineitem WHERE l_quantity >= 40
  UNION SELECT {_r('Part', 'l_partkey')}, '{ONTOLOGY}supplier', {_r('Supplier', 'l_suppkey')} FROM lineitem)"""


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(surface, uri, tier): names, brands and types of parts as labels, redirects and disambiguations."""
    part = load(spark, sf_dir, "part")
    uri = resource("Part", F.col("p_partkey")).alias("uri")
    out = None
    for column, tier in (("p_name", 1.0), ("p_brand", 0.8), ("p_type", 0.5)):
        rows = part.select(normalize(F.col(column)).alias("surface"), uri, F.lit(tier).alias("tier"))
        out = rows if out is None else out.unionByName(rows)
    return out


FORMS_SQL = "forms AS (" + " UNION ALL ".join(f"SELECT lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))) AS surface, {_r('Part', 'p_partkey')} AS uri, {t}::DOUBLE AS tier FROM part" for c, t in (("p_name", 1.0), ("p_brand", 0.8), ("p_type", 0.5))) + ")"
INDEX_SQL = f"""{FORMS_SQL}, pop AS (SELECT {_r('Part', 'l_partkey')} AS uri, count(*) AS indegree FROM lineitem GROUP BY 1),
best AS (SELECT surface, uri, max(tier) AS tier FROM forms WHERE surface <> '' GROUP BY 1, 2),
sf AS (SELECT surface, best.uri, tier, round(tier * (1 + log10(1 + coalesce(indegree, 0))), 4) AS final FROM best LEFT JOIN pop USING (uri))"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold triples of each order (a sentence) and its priority (a domain)."""
    lines, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("domain"), F.concat(F.lit("Order_"), F.col("l_orderkey").cast("string")).alias("sub"), F.concat(F.lit("has_"), F.col("l_returnflag")).alias("rel"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("obj"))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an extractor might give for these: some missing, some with another relation, other spelling."""
    lines, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    rel = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("Has "), F.col("l_returnflag"))).otherwise("has N")
    return lines.filter("l_quantity > 10").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("domain"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("sub"), rel.alias("rel"), F.concat(F.lit("Part_"), F.col("l_partkey").cast("string")).alias("obj"))


TRIPLES_SQL = """gold AS (SELECT o_orderkey AS id, o_orderpriority AS domain, 'Order_' || l_orderkey AS sub, 'has_' || l_returnflag AS rel, 'Part ' || l_partkey AS obj FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pred AS (SELECT o_orderkey AS id, o_orderpriority AS domain, 'order ' || l_orderkey AS sub, CASE WHEN l_linestatus = 'F' THEN 'Has ' || l_returnflag ELSE 'has N' END AS rel, 'Part_' || l_partkey AS obj
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 10),
gk AS (SELECT id, domain, lower(regexp_replace(sub, '[_\\s]', '', 'g')) || lower(regexp_replace(rel, '[_\\s]', '', 'g')) || lower(regexp_replace(obj, '[_\\s]', '', 'g')) AS key FROM gold),
pk AS (SELECT id, domain, lower(regexp_replace(sub, '[_\\s]', '', 'g')) || lower(regexp_replace(rel, '[_\\s]', '', 'g')) || lower(regexp_replace(obj, '[_\\s]', '', 'g')) AS key FROM pred)"""
