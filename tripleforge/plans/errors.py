"""Queries on error classes, filters of extractions, learned formats, files' lines and graph patterns with options."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripleforge.functions import literals
from tripleforge.functions.similarity import f1, safe_ratio
from tripleforge.functions.text import ONTOLOGY, RESOURCE
from tripleforge.operators import errors
from tripleforge.operators.graph import WIKILINK

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


def _extractions(spark, sf_dir):
    """Gold and predicted slots of each order line; what the prediction gets wrong goes by the line's keys."""
    kind = F.col("l_partkey") % 6
    text = lambda name, key: F.concat(F.lit(name), F.col(key).cast("string"))
    empty = F.lit("")
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", text("Order ", "l_orderkey").alias("gs"), F.lit("dbo:part").alias("gr"), text("Part ", "l_partkey").alias("go"), kind.alias("kind"))
    slot = lambda value: F.when(F.col("kind") == 0, empty).otherwise(value)
    relation = F.when(F.col("kind") == 3, "is part of").when(F.col("kind") == 4, "भाग है").when(F.col("kind") == 5, "भाग").otherwise("x")
    return rows.select("*", slot(F.upper("gs")).alias("ps"), slot(relation).alias("pr"), slot(F.when(F.col("kind") == 2, F.lit("Part")).otherwise(F.col("go"))).alias("po"), F.when(F.col("kind").isin(1, 2), " dbp:PART ").otherwise("").alias("aligned"))


def _classed(spark, sf_dir):
    slots = lambda side: {k: F.col(f"{side}{k}") for k in "sro"}
    return _extractions(spark, sf_dir).withColumn("error_type", errors.error_class(slots("p"), slots("g"), F.col("aligned")))


_KIND_SQL = "CASE l_partkey % 6 WHEN 0 THEN 'missing_triple' WHEN 1 THEN 'correct' WHEN 2 THEN 'argument_span_error' WHEN 3 THEN 'language_mixing' WHEN 4 THEN 'predicate_placeholder' ELSE 'predicate_normalization_failure' END"


@query("error_classes", f"SELECT l_orderkey, l_partkey, l_linenumber, {_KIND_SQL} AS error_type FROM lineitem")
def error_classes(spark, sf_dir):
    return _classed(spark, sf_dir).select("l_orderkey", "l_partkey", "l_linenumber", "error_type")


@query("slot_scores", """WITH k AS (SELECT l_partkey % 6 AS k FROM lineitem), c AS (SELECT count(*) AS total, count(*) FILTER (k <> 0) AS extracted, count(*) FILTER (k = 1) AS correct, count(*) FILTER (k NOT IN (0, 2)) AS o, count(*) FILTER (k IN (1, 2)) AS p FROM k)
SELECT total, extracted, correct, round(correct / extracted, 3) AS precision, round(correct / total, 3) AS recall, round(2 * (correct / extracted) * (correct / total) / (correct / extracted + correct / total), 3) AS f1, 1.0::DOUBLE AS subject_accuracy, round(o / extracted, 3) AS object_accuracy, round(p / extracted, 3) AS predicate_accuracy FROM c""")
def slot_scores(spark, sf_dir):
    return errors.slot_scores(_classed(spark, sf_dir))


_RAW_SQL = """x AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k, 'माल ' || (l_partkey % 9) || CASE WHEN l_partkey % 4 = 0 THEN ' का' ELSE '' END AS head,
  CASE l_suppkey % 5 WHEN 0 THEN 'है' WHEN 1 THEN 'घर को देता' WHEN 2 THEN ' बेचता ' WHEN 3 THEN '' ELSE 'देता' END AS rel, 'माल ' || (l_suppkey % 9) || CASE WHEN l_suppkey % 7 = 0 THEN ' में' ELSE '' END AS tail FROM lineitem)"""


def _raw(spark, sf_dir):
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    ending = lambda key, n, mark: F.when(F.col(key) % n == 0, mark).otherwise("")
    rel = F.when(F.col("l_suppkey") % 5 == 0, "है").when(F.col("l_suppkey") % 5 == 1, "घर को देता").when(F.col("l_suppkey") % 5 == 2, " बेचता ").when(F.col("l_suppkey") % 5 == 3, "").otherwise("देता")
    item = lambda key: F.concat(F.lit("माल "), (F.col(key) % 9).cast("string"))
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.row_number().over(place).cast("long").alias("k"), F.concat(item("l_partkey"), ending("l_partkey", 4, " का")).alias("head"), rel.alias("rel"), F.concat(item("l_suppkey"), ending("l_suppkey", 7, " में")).alias("tail"))


@query("filtered_extractions", f"WITH {_RAW_SQL} SELECT id, head, rel, tail, min(k) AS k FROM x WHERE head NOT LIKE '% का' AND tail NOT LIKE '% में' AND rel NOT LIKE '% को%' AND rel <> 'है' GROUP BY ALL")
def filtered_extractions(spark, sf_dir):
    return errors.filtered(_raw(spark, sf_dir), "id", ["k"]).select("id", "head", "rel", "tail", "k")


@query("prepared_extractions", f"""WITH {_RAW_SQL}, c AS (SELECT id, k, replace(head, ' का', '') AS head, CASE WHEN rel = 'है' THEN 'property' ELSE trim(rel) END AS rel, replace(tail, ' में', '') AS tail FROM x)
SELECT id, head, rel, tail, min(k) AS k FROM c WHERE rel <> '' AND rel NOT LIKE '% को %' AND head <> tail GROUP BY ALL""")
def prepared_extractions(spark, sf_dir):
    return errors.prepared(_raw(spark, sf_dir), "id", ["k"]).select("id", "head", "rel", "tail", "k")


@query("augmented_extractions", """WITH x AS (SELECT DISTINCT l_orderkey AS id, l_returnflag AS rel, 'p' || (l_partkey % 50) AS head, 's' || (l_suppkey % 9) AS tail FROM lineitem),
a AS (SELECT id, rel, head AS own, tail AS common FROM x UNION SELECT id, rel, tail, head FROM x) SELECT a.id, a.own AS head, a.rel || ' ' || a.common AS rel, b.own AS tail FROM a JOIN a b ON a.id = b.id AND a.rel = b.rel AND a.common = b.common AND a.own < b.own""")
def augmented_extractions(spark, sf_dir):
    short = lambda letter, key, n: F.concat(F.lit(letter), (F.col(key) % n).cast("string"))
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), short("p", "l_partkey", 50).alias("head"), F.col("l_returnflag").alias("rel"), short("s", "l_suppkey", 9).alias("tail"))
    return errors.augmented(rows, "id")


@query("benchmark_micro", f"""WITH {TRIPLES_SQL}, q AS (SELECT DISTINCT id, key FROM pk WHERE id IN (SELECT id FROM gk)), c AS (SELECT (SELECT count(DISTINCT id) FROM gk) AS n_sentences, (SELECT count(*) FROM gk) AS n_gold, (SELECT count(*) FROM q) AS n_predicted, (SELECT count(*) FROM gk JOIN q USING (id, key)) AS n_correct)
SELECT *, round(n_correct / n_predicted, 6) AS precision, round(n_correct / n_gold, 6) AS recall, round(2 * (n_correct / n_predicted) * (n_correct / n_gold) / (n_correct / n_predicted + n_correct / n_gold), 6) AS f1 FROM c""")
def benchmark_micro(spark, sf_dir):
    from tripleforge.operators.scoring import keyed

    return errors.benchmark_micro(keyed(tables.gold(spark, sf_dir), ["id"]), keyed(tables.predicted(spark, sf_dir), ["id"]), ["id"], ["key"])


@query("literal_ranges", "SELECT p_type AS range, count(*) FILTER (p_size > 25) AS quoted, count(*) FILTER (p_size <= 25) AS unquoted FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def literal_ranges(spark, sf_dir):
    """Quoted and plain objects of each declared range: triples joined with their predicate's range."""
    obj = F.when(F.col("p_size") > 25, F.concat(F.lit(' "'), "p_name", F.lit('"'))).otherwise(F.col("p_name"))
    declared = load(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("range"), F.trim(obj).startswith('"').alias("quoted"))
    rows = load(spark, sf_dir, "lineitem").select("l_partkey").join(declared, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("range").agg(F.count_if("quoted").alias("quoted"), F.count_if(~F.col("quoted")).alias("unquoted"))


def _profiled(spark, sf_dir):
    obj = F.when(F.col("l_quantity") > 40, F.concat(F.lit('"'), F.col("l_quantity").cast("string"), F.lit('"'))).otherwise("thing")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("sub"), obj.alias("obj"))


@query("dataset_profile", """WITH s AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity > 40) AS lit, count(DISTINCT l_suppkey) AS subjects FROM lineitem GROUP BY 1), c AS (SELECT count(*) AS sentences, sum(n)::BIGINT AS triples, sum(lit) AS lit, count(*) FILTER (subjects > 1) AS multi FROM s)
SELECT sentences, triples, round(triples / sentences, 6) AS per_sentence, round(100 * lit / triples, 1) AS literal_pct, round(100 * multi / sentences, 1) AS multi_subject_pct, round(sentences / triples, 6) AS one_triple_recall, round(2 * (sentences / triples) / (1 + sentences / triples), 6) AS one_triple_f1 FROM c""")
def dataset_profile(spark, sf_dir):
    return errors.dataset_profile(_profiled(spark, sf_dir), "l_orderkey")


@query("triples_per_sentence", "SELECT n, count(*) AS sentences, round(100 * count(*) / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 1) AS pct FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY n")
def triples_per_sentence(spark, sf_dir):
    sizes = _profiled(spark, sf_dir).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("sentences"))
    return sizes.select("n", "sentences", F.round(100 * F.col("sentences") / F.sum("sentences").over(Window.partitionBy()), 1).alias("pct"))


_FORMATS_SQL = r"""tr AS (SELECT p_type || (p_partkey % 3) AS pid, p_partkey % 3 AS kind, p_size AS size, p_brand FROM part),
vf AS (SELECT pid, any_value(kind) AS kind, CASE WHEN any_value(kind) = 0 AND count(*) FILTER (size % 10 <> 0) >= 2 AND count(*) FILTER (size % 10 <> 0) >= 0.8 * count(*) THEN 'kilo gram' WHEN any_value(kind) = 0 AND count(*) FILTER (size % 10 = 0) >= 2 AND count(*) FILTER (size % 10 = 0) >= 0.8 * count(*) THEN 'pound' END AS unit,
  any_value(kind) = 1 AND count(*) >= 2 AND count(*) FILTER (size = 7) = 0 AS float0, CASE WHEN any_value(kind) = 2 THEN CASE WHEN count(*) FILTER (size > 25) >= count(*) FILTER (size <= 25) THEN 'english' ELSE 'iso' END END AS date_style FROM tr GROUP BY pid)"""


def _train(spark, sf_dir):
    kind, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    unit = F.concat(F.lit('"'), size, F.lit(".5 ("), F.when(F.col("p_size") % 10 != 0, "kilo_gram").otherwise("pound"), F.lit(')"'))
    number = F.when(F.col("p_size") == 7, size).otherwise(F.concat(size, F.lit(".0")))
    date = F.when(F.col("p_size") > 25, "30 March 2007").otherwise("2007-03-30")
    return load(spark, sf_dir, "part").select(F.concat("p_type", kind.cast("string")).alias("pid"), F.when(kind == 0, unit).when(kind == 1, number).otherwise(date).alias("value"))


@query("learned_formats", f"WITH {_FORMATS_SQL} SELECT pid, unit, float0, date_style FROM vf")
def learned_formats(spark, sf_dir):
    return errors.value_formats(_train(spark, sf_dir))


@query("literal_values", """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '106000' WHEN 1 THEN lpad(p_size::VARCHAR, 4, '0') WHEN 2 THEN (p_size * 100) || '.0' WHEN 3 THEN '1726-01-01' WHEN 4 THEN '1990-02-14' WHEN 5 THEN '1990-02-14' WHEN 6 THEN '0' || p_size ELSE 'December 2008' END AS value, p_partkey % 8 = 7 AS quoted FROM part""")
def literal_values(spark, sf_dir):
    """Raw values through the literal rules: numbers, padded years, lengths, dates in three notations, area codes, a month kept as it is."""
    kind, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    cases = [("x", "number", F.lit("106,000")), ("foundingYear", "", size), ("runwayLength", "number", F.concat(size, F.lit("00"))), ("birthDate", "date", F.lit("January 1, 1726")), ("xDate", "date", F.lit("14-02-1990")), ("xDate", "date", F.lit("02-14-1990")), ("areaCode", "", F.concat(F.lit("0"), size)), ("completionDate", "date", F.lit("December 2008"))]
    pick = lambda j: F.coalesce(*[F.when(kind == k, c[j] if j == 2 else F.lit(c[j])) for k, c in enumerate(cases)])
    value = literals.literal(pick(2), pick(0), pick(1), F.lit(False), F.when(kind == 7, "english").otherwise("iso"))
    return load(spark, sf_dir, "part").select("p_partkey", value["value"].alias("value"), value["quoted"].alias("quoted"))


@query("beam_confidence", "SELECT l_orderkey AS id, l_returnflag AS triple, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey), 6) AS confidence FROM lineitem GROUP BY 1, 2")
def beam_confidence(spark, sf_dir):
    """Share of the beams of a sentence that give a triple."""
    counts = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("triple")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("confidence", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("id")), 6))


@query("pass_rates", "SELECT round(avg((answer = gold)::INT), 6) AS pass_at_1, round(avg((array_length(string_split(answer, '|')) = 3)::INT), 6) AS valid_rate, count(*) AS n FROM (SELECT CASE WHEN p_size % 4 = 0 THEN p_name WHEN p_size % 4 = 1 THEN p_name || '|x|' || p_type ELSE p_name || '|is|' || p_type END AS answer, p_name || '|is|' || p_type AS gold FROM part)")
def pass_rates(spark, sf_dir):
    from tripleforge.functions.text import slug_valid

    gold = F.concat_ws("|", "p_name", F.lit("is"), "p_type")
    answer = F.when(F.col("p_size") % 4 == 0, F.col("p_name")).when(F.col("p_size") % 4 == 1, F.concat_ws("|", "p_name", F.lit("x"), "p_type")).otherwise(gold)
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return load(spark, sf_dir, "part").agg(rate(answer == gold).alias("pass_at_1"), rate(slug_valid(answer, strict=True)).alias("valid_rate"), F.count(F.lit(1)).alias("n"))


@query("merged_extractions", "SELECT id, rel, obj, min(src) AS source FROM (SELECT l_orderkey AS id, l_returnflag AS rel, l_partkey % 20 AS obj, 'a_rules' AS src FROM lineitem WHERE l_quantity > 20 UNION ALL SELECT l_orderkey, l_returnflag, l_partkey % 20, 'b_model' FROM lineitem WHERE l_discount > 0.04) GROUP BY 1, 2, 3")
def merged_extractions(spark, sf_dir):
    """Rule and model extractions one after the other; of equal ones the rules' stays."""
    lines = load(spark, sf_dir, "lineitem")
    part = lambda rows, name: rows.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("rel"), (F.col("l_partkey") % 20).alias("obj"), F.lit(name).alias("source"))
    both = part(lines.filter("l_quantity > 20"), "a_rules").unionByName(part(lines.filter("l_discount > 0.04"), "b_model"))
    return both.groupBy("id", "rel", "obj").agg(F.min("source").alias("source"))


@query("literal_predicates", "SELECT DISTINCT p_type AS pid FROM part WHERE p_size > 45 UNION SELECT p_type FROM part GROUP BY 1 HAVING count(*) >= 3 AND avg((p_size > 10)::INT) >= 0.8")
def literal_predicates(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    learned = part.groupBy(F.col("p_type").alias("pid")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p_size") > 10).cast("double")).alias("share")).filter("n >= 3 AND share >= 0.8").select("pid")
    return part.filter("p_size > 45").select(F.col("p_type").alias("pid")).union(learned).distinct()


@query("two_files", "SELECT event_id, event_type FROM events WHERE event_id < 100 UNION ALL SELECT event_id, event_type FROM events WHERE event_id >= 1300")
def two_files(spark, sf_dir):
    """A first prediction file's rows, and the second file's from row 1300 on."""
    events = load(spark, sf_dir, "events").select("event_id", "event_type")
    return events.filter("event_id < 100").unionByName(events.filter("event_id >= 1300"))


@query("label_uri_sets", "SELECT p_name AS label, count(DISTINCT p_partkey) AS uris FROM part GROUP BY 1")
def label_uri_sets(spark, sf_dir):
    """Pages of (label, uri) put together: each label has the union of its URIs over the pages."""
    part = load(spark, sf_dir, "part").select(F.col("p_name").alias("label"), F.col("p_partkey").alias("uri"))
    pages = part.filter("uri % 2 = 0").unionByName(part.filter("uri % 3 = 0")).unionByName(part)
    return pages.groupBy("label").agg(F.count_distinct("uri").alias("uris"))


@query("unanswered_sentences", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)")
def unanswered_sentences(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_quantity")
    return lines.select("id").distinct().join(lines.filter("l_quantity > 10").select("id"), "id", "left_anti")


@query("all_traces", "SELECT role, count(*) AS n FROM (SELECT role, text FROM conversations UNION ALL SELECT 'user', text FROM benchmark) GROUP BY 1")
def all_traces(spark, sf_dir):
    """Base traces and converted ones as a bag."""
    both = load(spark, sf_dir, "conversations").select("role", "text").unionByName(load(spark, sf_dir, "benchmark").select(F.lit("user").alias("role"), "text"))
    return both.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("seed_pool", "SELECT o_orderkey, (o_totalprice / 50000)::DOUBLE AS score FROM orders WHERE o_totalprice / 50000 >= 0 AND o_totalprice / 50000 < 8 ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 6")
def seed_pool(spark, sf_dir):
    """Six low-scored examples by a seeded hash: a sampling operator."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 50000).alias("score")).filter("score >= 0 AND score < 8")
    return rows.orderBy(F.md5(F.concat(F.lit("7|"), F.col("o_orderkey").cast("string")).cast("binary")), "o_orderkey").limit(6)


@query("missing_edges", """WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), c AS (SELECT DISTINCT a, ('0x' || substr(md5('17|' || a || '|' || b), 1, 8))::BIGINT % (SELECT max(p_partkey) + 1 FROM part) AS b FROM e)
SELECT a, b FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.a = c.a AND e.b = c.b)""")
def missing_edges(spark, sf_dir):
    """Random edges that the graph has not: a seeded hash of each edge picks another end."""
    edges = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    size = load(spark, sf_dir, "part").agg((F.max("p_partkey") + 1).alias("size"))
    digest = F.md5(F.concat_ws("|", F.lit("17"), F.col("a").cast("string"), F.col("b").cast("string")).cast("binary"))
    drawn = edges.crossJoin(F.broadcast(size)).select("a", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("size")).alias("b")).distinct()
    return drawn.join(edges, ["a", "b"], "left_anti")


@query("error_rates", "SELECT l_returnflag AS family, sum(l_linenumber)::BIGINT AS p, sum(l_quantity)::BIGINT AS g, count(*) AS c, round(count(*) / sum(l_linenumber), 6) AS prec, round(count(*) / sum(l_quantity), 6) AS recall, round(2 * (count(*) / sum(l_linenumber)) * (count(*) / sum(l_quantity)) / (count(*) / sum(l_linenumber) + count(*) / sum(l_quantity)), 6) AS f1 FROM lineitem GROUP BY 1")
def error_rates(spark, sf_dir):
    """Scores of families from their numbers of predicted, gold and common items."""
    sums = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("family")).agg(F.sum("l_linenumber").cast("long").alias("p"), F.sum("l_quantity").cast("long").alias("g"), F.count(F.lit(1)).alias("c"))
    p, r = safe_ratio(F.col("c"), F.col("p")), safe_ratio(F.col("c"), F.col("g"))
    return sums.select("family", "p", "g", "c", F.round(p, 6).alias("prec"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


@query("property_blacklist", f"WITH {EDGES_SQL} SELECT p, count(*) AS n FROM edges WHERE p NOT IN ('{WIKILINK}', '{ONTOLOGY}logo', '{ONTOLOGY}region') GROUP BY p")
def property_blacklist(spark, sf_dir):
    """Exact set of properties that no answer may have."""
    blocked = [WIKILINK, ONTOLOGY + "logo", ONTOLOGY + "region"]
    return tables.edges(spark, sf_dir).filter(~F.col("p").isin(*blocked)).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("graph_between_named", f"WITH {EDGES_SQL} SELECT DISTINCT a.s, a.o, b.p FROM edges a JOIN edges b ON a.s = b.s AND a.o = b.o AND b.p <> '{WIKILINK}' WHERE a.p = '{WIKILINK}'")
def graph_between_named(spark, sf_dir):
    """Predicates other than the wikilink between linked resources."""
    edges = tables.edges(spark, sf_dir)
    links = edges.filter(F.col("p") == WIKILINK).select("s", "o").distinct()
    return links.join(edges.filter(F.col("p") != WIKILINK), ["s", "o"]).select("s", "o", "p").distinct()


@query("graph_linked_by", f"WITH {EDGES_SQL} SELECT s, string_agg(o, ' ' ORDER BY o) AS linked FROM edges WHERE p = '{ONTOLOGY}supplier' GROUP BY s")
def graph_linked_by(spark, sf_dir):
    """Entities that one predicate leads to."""
    own = tables.edges(spark, sf_dir).filter(F.col("p") == ONTOLOGY + "supplier")
    return own.groupBy("s").agg(F.array_join(F.sort_array(F.collect_set("o")), " ").alias("linked"))


@query("graph_optional", f"""WITH {EDGES_SQL}, l AS (SELECT DISTINCT s, o FROM edges WHERE p = '{WIKILINK}') SELECT l.s, l.o, f.p AS forward, i.p AS inverse FROM l LEFT JOIN edges f ON f.s = l.s AND f.o = l.o AND f.p <> '{WIKILINK}' LEFT JOIN edges i ON i.s = l.o AND i.o = l.s AND i.p <> '{WIKILINK}'""")
def graph_optional(spark, sf_dir):
    """Links with the predicates that hold forward and backward, null where none does."""
    edges = tables.edges(spark, sf_dir)
    links, named = edges.filter(F.col("p") == WIKILINK).select("s", "o").distinct(), edges.filter(F.col("p") != WIKILINK)
    ahead, back = named.select("s", "o", F.col("p").alias("forward")), named.select(F.col("o").alias("s"), F.col("s").alias("o"), F.col("p").alias("inverse"))
    return links.join(ahead, ["s", "o"], "left").join(back, ["s", "o"], "left")


@query("graph_labels", "SELECT p_partkey, p_name AS label, string_agg(DISTINCT alt, '|' ORDER BY alt) AS alternatives FROM (SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN unnest([p_brand, p_type]) END AS alt FROM part) GROUP BY 1, 2")
def graph_labels(spark, sf_dir):
    """A label with the alternative ones, sorted; null where there is none."""
    part = load(spark, sf_dir, "part")
    other = part.filter("p_size > 25").select("p_partkey", F.explode(F.array("p_brand", "p_type")).alias("alt")).groupBy("p_partkey").agg(F.array_join(F.sort_array(F.collect_set("alt")), "|").alias("alternatives"))
    return part.select("p_partkey", F.col("p_name").alias("label")).join(other, "p_partkey", "left")


@query("label_matches", "SELECT DISTINCT lower(m.p_name) AS label, p.p_partkey AS uri FROM part m JOIN part p ON p.p_name = m.p_name WHERE m.p_size > 40")
def label_matches(spark, sf_dir):
    """Resources whose label is one of a batch of labels."""
    part = load(spark, sf_dir, "part")
    wanted = part.filter("p_size > 40").select("p_name").distinct()
    return part.join(wanted, "p_name").select(F.lower("p_name").alias("label"), F.col("p_partkey").alias("uri"))


@query("first_descriptions", "SELECT p_name AS uri, p_type AS type, CASE WHEN p_size > 25 THEN p_brand END AS abstract FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1")
def first_descriptions(spark, sf_dir):
    """The first row of a resource with its optional type and abstract."""
    rows = load(spark, sf_dir, "part").groupBy(F.col("p_name").alias("uri")).agg(F.min_by(F.struct(F.col("p_type").alias("type"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("abstract")), "p_partkey").alias("x"))
    return rows.select("uri", "x.type", "x.abstract")


@query("relation_extremes", "WITH c AS (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1) SELECT name, n, 'most' AS side FROM (SELECT * FROM c ORDER BY n DESC, name LIMIT 5) UNION ALL SELECT name, n, 'least' FROM (SELECT * FROM c ORDER BY n, name LIMIT 5)")
def relation_extremes(spark, sf_dir):
    """The most and the least common relations: a top-k report."""
    counts = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    most, least = counts.orderBy(F.desc("n"), "name").limit(5), counts.orderBy("n", "name").limit(5)
    return most.withColumn("side", F.lit("most")).unionByName(least.withColumn("side", F.lit("least")))


@query("rdf_xml", "SELECT p_partkey, '<rdf:Description rdf:about=\"Part_' || p_partkey || '\"><label>' || replace(replace(p_name, '&', '&amp;'), '<', '&lt;') || ' &amp; co</label></rdf:Description>' AS value FROM part")
def rdf_xml(spark, sf_dir):
    from tripleforge.sources.sinks import rdf_xml_lines

    rows = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Part_"), F.col("p_partkey").cast("string")).alias("s"), F.lit("label").alias("p"), F.concat("p_name", F.lit(" & co")).alias("o"))
    return rows.select("p_partkey", rdf_xml_lines(F.col("s"), F.col("p"), F.col("o")).alias("value"))


@query("triple_csv", "SELECT '\"Part, ' || p_partkey || '\",\"say \"\"' || p_name || '\"\"\",' || p_type AS value FROM part")
def triple_csv(spark, sf_dir):
    from tripleforge.sources.sinks import csv_line

    return load(spark, sf_dir, "part").select(csv_line(F.concat(F.lit("Part, "), F.col("p_partkey").cast("string")), F.concat(F.lit('say "'), "p_name", F.lit('"')), F.col("p_type")).alias("value"))


@query("extraction_lines", "SELECT l_orderkey || chr(9) || 'Order ' || l_orderkey || chr(9) || l_returnflag || chr(9) || 'Part ' || l_partkey AS value FROM lineitem WHERE l_quantity > 10")
def extraction_lines(spark, sf_dir):
    from tripleforge.sources.sinks import extraction_lines as lines

    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("sent_id"), F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("arg1"), F.when(F.col("l_quantity") > 10, F.col("l_returnflag")).alias("rel"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("arg2"))
    return lines(rows)


@query("conll_lines", """SELECT item_id, string_agg(CASE WHEN i = 0 THEN w || ' (1' WHEN i = 1 AND n > 1 THEN w || ' 1)' ELSE w || ' -' END, chr(10) ORDER BY i) AS value FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS i, len(string_split(text, ' ')) AS n FROM benchmark) WHERE n > 1 GROUP BY item_id""")
def conll_lines(spark, sf_dir):
    from tripleforge.sources.sinks import conll_lines as lines

    words = F.split("text", " ", -1)
    rows = load(spark, sf_dir, "benchmark").filter(F.size(words) > 1)
    clusters = F.array(F.struct(F.lit(0).alias("first"), F.lit(1).alias("last"), F.lit("1").alias("cluster")))
    return rows.select("item_id", F.array_join(lines(words, clusters), "\n").alias("value"))


@query("ablation_rows", "SELECT '| ' || l_returnflag || ' | ' || printf('%.4f', round(sum(l_quantity) / (50 * count(*)), 4)) || ' | ' || count(*) || ' |' AS value FROM lineitem GROUP BY l_returnflag")
def ablation_rows(spark, sf_dir):
    from tripleforge.sources.sinks import markdown_row

    rows = load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity") / (50 * F.count(F.lit(1))), 4).alias("score"), F.count(F.lit(1)).alias("n"))
    return rows.select(markdown_row(F.col("l_returnflag"), F.format_string("%.4f", "score"), F.col("n").cast("string")).alias("value"))


@query("wikilink_targets", f"SELECT 'Part_' || p_partkey || CASE WHEN p_size > 25 THEN ',_é' ELSE '' END AS uri, count(*) AS indegree FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def wikilink_targets(spark, sf_dir):
    """In-degree by wikilink lines; the object's name is decoded only where it has a percent sign."""
    from tripleforge.sources.dumps import wikilink_lines

    joined = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    line = F.format_string(f"<{RESOURCE}Order_%s> <{WIKILINK}> <{RESOURCE}Part_%s%s> .", "l_orderkey", "p_partkey", F.when(F.col("p_size") > 25, ",_%C3%A9").otherwise(""))
    return wikilink_lines(joined.select(line.alias("value"))).groupBy("uri").agg(F.count(F.lit(1)).alias("indegree"))


@query("ontology_catalogue", """SELECT 'p' || p_partkey AS pid, p_name AS label_en, CASE WHEN p_size > 25 THEN 'हि ' || p_name END AS label_hi, CASE WHEN p_size % 2 = 0 THEN p_brand END AS comment, p_type AS domain FROM part WHERE p_partkey % 4 <> 3""")
def ontology_catalogue(spark, sf_dir):
    """Properties of an ontology from its triples: labels by language, a comment, a domain; other resources are left out."""
    from tripleforge.sources.dumps import property_catalogue

    part = load(spark, sf_dir, "part").withColumn("uri", F.concat(F.lit(ONTOLOGY + "p"), F.col("p_partkey").cast("string")))
    row = lambda p, o, lang: F.struct(F.col("uri").alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(lang).cast("string").alias("lang"))
    triples = part.select(F.explode(F.array(row("type", F.when(F.col("p_partkey") % 4 != 3, "Property").otherwise("Class"), None), row("label", F.col("p_name"), "en"), row("label", F.when(F.col("p_size") > 25, F.concat(F.lit("हि "), "p_name")), "hi"), row("comment", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), None), row("domain", F.col("p_type"), None))).alias("t")).select("t.*").filter("o IS NOT NULL")
    return property_catalogue(triples).select(F.regexp_extract("uri", "/(p[0-9]+)$", 1).alias("pid"), F.col("labels_en")[0].alias("label_en"), F.get("labels_hi", F.lit(0)).alias("label_hi"), "comment", F.col("domains")[0].alias("domain"))


@query("gold_by_id", "SELECT o_custkey AS id, max_by(o_orderpriority, o_orderkey) AS triples FROM orders GROUP BY 1")
def gold_by_id(spark, sf_dir):
    """Gold keyed by id: a later line overwrites the earlier ones."""
    from tripleforge.sources.dumps import last_by_id

    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("line"), F.col("o_orderpriority").alias("triples"))
    return last_by_id(rows, "id", "line").select("id", "triples")


@query("domains_in_order", "SELECT slug, (row_number() OVER (ORDER BY n, slug))::BIGINT AS place FROM (SELECT DISTINCT p_size || '_' || lower(p_type) AS slug, p_size AS n FROM part WHERE p_size <= 12)")
def domains_in_order(spark, sf_dir):
    """Domains by the number before their name; the ranked table is a list of names."""
    slugs = load(spark, sf_dir, "part").filter("p_size <= 12").select(F.concat_ws("_", F.col("p_size").cast("string"), F.lower("p_type")).alias("slug")).distinct()
    number = F.regexp_extract("slug", r"^(\d+)", 1).cast("int")
    return slugs.withColumn("place", F.row_number().over(Window.orderBy(number, "slug")).cast("long"))


@query("relation_sentences", "SELECT item_id AS id, 'cause word' AS first, 'effect' AS second, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS label, CASE WHEN item_id % 3 = 0 THEN 'cause word' ELSE 'effect' END AS cause FROM benchmark")
def relation_sentences(spark, sf_dir):
    """Tagged sentences and the line after them: the pair, whether it is cause and effect, and which comes first in the relation."""
    from tripleforge.sources.dumps import relation_pairs

    line = F.format_string('%s\t"The <e1>Cause word</e1> made an <e2>Effect</e2>."', "item_id")
    relation = F.concat(F.when(F.col("item_id") % 2 == 0, "Cause-Effect").otherwise("Other"), F.when(F.col("item_id") % 3 == 0, "(e1,e2)").otherwise("(e2,e1)"))
    rows = load(spark, sf_dir, "benchmark").select(F.explode(F.array(F.struct((F.col("item_id") * 3).alias("n"), line.alias("value")), F.struct((F.col("item_id") * 3 + 1).alias("n"), relation.alias("value")))).alias("x")).select("x.*")
    return relation_pairs(rows)


@query("segment_lines", "SELECT p_partkey AS id, p_name AS sentence FROM part WHERE p_size > 10")
def segment_lines(spark, sf_dir):
    """Sentences of a file's lines: blank ones are skipped."""
    from tripleforge.sources.dumps import sentence_lines

    return sentence_lines(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, F.concat(F.lit(" "), "p_name")).otherwise("  ").alias("value")))
