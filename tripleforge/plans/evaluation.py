"""Queries on scoring, learned conventions, curation and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripleforge.functions.similarity import safe_ratio
from tripleforge.operators import curation, scoring

from . import tables
from .tables import TRIPLES_SQL, load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_SCORES_SQL = f"""{TRIPLES_SQL}, k AS (SELECT coalesce(g.id, p.id) AS id, coalesce(g.domain, p.domain) AS domain, g.key IS NOT NULL AS g, p.key IS NOT NULL AS q FROM (SELECT DISTINCT * FROM gk) g FULL JOIN (SELECT DISTINCT * FROM pk) p ON g.id = p.id AND g.key = p.key),
s AS (SELECT id, domain, sum(g::INT)::BIGINT AS n_gold, sum(q::INT)::BIGINT AS n_pred, sum((g AND q)::INT)::BIGINT AS tp FROM k GROUP BY 1, 2),
pr AS (SELECT *, CASE WHEN n_pred = 0 THEN 0 ELSE tp / n_pred END AS p, CASE WHEN n_gold = 0 THEN 0 ELSE tp / n_gold END AS r FROM s),
sc AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)"""


def _scores(spark, sf_dir):
    return scoring.sentence_scores(tables.gold(spark, sf_dir), tables.predicted(spark, sf_dir), ["id", "domain"])


@query("sentence_scores", f"WITH {_SCORES_SQL} SELECT id, domain, n_gold, n_pred, tp, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1 FROM sc")
def sentence_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("id", "domain", "n_gold", "n_pred", "tp", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])


@query("macro_scores", f"""WITH {_SCORES_SQL}, d AS (SELECT domain, avg(p) AS p, avg(r) AS r, avg(f1) AS f1, count(*) AS n FROM sc GROUP BY 1)
SELECT domain, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1, n FROM d UNION ALL SELECT 'OVERALL', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), sum(n)::BIGINT FROM d""")
def macro_scores(spark, sf_dir):
    return scoring.macro(_scores(spark, sf_dir), "domain")


@query("multiset_counts", f"""WITH {TRIPLES_SQL}, g AS (SELECT domain, key, count(*) AS g FROM gk GROUP BY 1, 2), p AS (SELECT domain, key, count(*) AS q FROM pk GROUP BY 1, 2)
SELECT coalesce(g.domain, p.domain) AS domain, sum(least(coalesce(g, 0), coalesce(q, 0)))::BIGINT AS tp, sum(greatest(coalesce(q, 0) - coalesce(g, 0), 0))::BIGINT AS fp, sum(greatest(coalesce(g, 0) - coalesce(q, 0), 0))::BIGINT AS fn
FROM g FULL JOIN p ON g.domain = p.domain AND g.key = p.key GROUP BY 1""")
def multiset_counts(spark, sf_dir):
    return scoring.multiset_counts(tables.gold(spark, sf_dir), tables.predicted(spark, sf_dir), ["domain"]).toDF("domain", "tp", "fp", "fn")


_KINDS = ["correct", "missing", "predicate_error", "span_error", "placeholder"]


def _errors(spark, sf_dir):
    kind = F.when(F.col("l_quantity") < 5, "missing").when((F.col("l_returnflag") == "N") & (F.col("l_tax") > 0.04), "span_error").when(F.col("l_returnflag") == "N", "correct").otherwise("predicate_error")
    return load(spark, sf_dir, "lineitem").select("l_shipdate", kind.alias("error_type"))


_ERRORS_SQL = "e AS (SELECT CASE WHEN l_quantity < 5 THEN 'missing' WHEN l_returnflag = 'N' AND l_tax > 0.04 THEN 'span_error' WHEN l_returnflag = 'N' THEN 'correct' ELSE 'predicate_error' END AS kind FROM lineitem)"


@query("error_histogram", f"""WITH {_ERRORS_SQL}, k AS (SELECT unnest({_KINDS}) AS kind)
SELECT k.kind, count(e.kind) AS n, round(100 * count(e.kind) / (SELECT count(*) FROM e), 1) AS pct FROM k LEFT JOIN e ON e.kind = k.kind GROUP BY k.kind""")
def error_histogram(spark, sf_dir):
    return scoring.error_histogram(_errors(spark, sf_dir), _KINDS)


@query("classification_metrics", """WITH t AS (SELECT (l_quantity > 25)::INT AS t, (l_extendedprice > 40000)::INT AS g FROM lineitem), c AS (SELECT count(*) FILTER (t = 1 AND g = 1) AS tp, count(*) FILTER (t = 0 AND g = 1) AS fp, count(*) FILTER (t = 1 AND g = 0) AS fn, count(*) FILTER (t = 0 AND g = 0) AS tn FROM t)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""")
def classification_metrics(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 25).cast("int").alias("t"), (F.col("l_extendedprice") > 40000).cast("int").alias("g"))
    return scoring.classification(rows, "t", "g")


@query("rank_metrics", """WITH r AS (SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rank, l_returnflag FROM lineitem)
SELECT round(avg((rank <= 1)::INT), 6) AS hits_1, round(avg((rank <= 3)::INT), 6) AS hits_3, round(avg((rank <= 5)::INT), 6) AS hits_5, round(avg((rank <= 10)::INT), 6) AS hits_10, round(avg(rank), 6) AS mean_rank, round(avg(1 / rank), 6) AS mrr FROM r WHERE l_returnflag = 'R'""")
def rank_metrics(spark, sf_dir):
    window = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber")
    return scoring.rank_metrics(load(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(window)).filter("l_returnflag = 'R'"))


_LEA_SQL = """k AS (SELECT DISTINCT l_orderkey AS doc, l_returnflag AS cluster, l_partkey AS mention FROM lineitem), r AS (SELECT DISTINCT l_orderkey AS doc, l_linestatus AS cluster, l_partkey AS mention FROM lineitem),
s AS (SELECT doc, cluster, count(*) AS size FROM k GROUP BY 1, 2 HAVING count(*) > 1), b AS (SELECT k.doc, k.cluster, r.cluster AS other, count(*) AS n FROM k JOIN r ON k.doc = r.doc AND k.mention = r.mention GROUP BY 1, 2, 3),
f AS (SELECT doc, cluster, sum(n * (n - 1) / 2) AS found FROM b GROUP BY 1, 2)"""


@query("lea", f"""WITH {_LEA_SQL}, rs AS (SELECT doc, cluster, count(*) AS size FROM r GROUP BY 1, 2 HAVING count(*) > 1), rf AS (SELECT doc, other AS cluster, sum(n * (n - 1) / 2) AS found FROM b GROUP BY 1, 2),
x AS (SELECT sum(size * coalesce(found, 0) / (size * (size - 1) / 2)) / sum(size) AS recall FROM s LEFT JOIN f USING (doc, cluster)), y AS (SELECT sum(size * coalesce(found, 0) / (size * (size - 1) / 2)) / sum(size) AS precision FROM rs LEFT JOIN rf USING (doc, cluster))
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM x, y""")
def lea(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    side = lambda c: lines.select(F.col("l_orderkey").alias("doc"), F.col(c).alias("cluster"), F.col("l_partkey").alias("mention")).distinct()
    return scoring.lea_scores(side("l_returnflag"), side("l_linestatus"))


@query("quote_conventions", """SELECT p_type AS pid, count(*) AS n, round(avg((p_size > 25)::INT), 6) AS share, avg((p_size > 25)::INT) >= 0.4 AS quoted, count(*) >= 3 AND avg((p_size > 25)::INT) >= 0.8 AS literal FROM part GROUP BY 1""")
def quote_conventions(spark, sf_dir):
    share = F.avg((F.col("p_size") > 25).cast("double"))
    return load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("pid")).agg(F.count(F.lit(1)).alias("n"), F.round(share, 6).alias("share"), (share >= 0.4).alias("quoted"), ((F.count(F.lit(1)) >= 3) & (share >= 0.8)).alias("literal"))


@query("predicate_aliases", """WITH c AS (SELECT p_type, count(*) FILTER (p_size > 5) AS generic, count(*) FILTER (p_size <= 5) AS synonym FROM part GROUP BY 1)
SELECT p_type AS family, generic, synonym, generic > 0 AND (synonym = 0 OR generic >= 10 * synonym) AS remapped FROM c""")
def predicate_aliases(spark, sf_dir):
    counts = load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("family")).agg(F.count_if(F.col("p_size") > 5).alias("generic"), F.count_if(F.col("p_size") <= 5).alias("synonym"))
    return counts.withColumn("remapped", (F.col("generic") > 0) & ((F.col("synonym") == 0) | (F.col("generic") >= 10 * F.col("synonym"))))


@query("value_formats", """WITH c AS (SELECT p_type AS pid, p_brand AS unit, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2)
SELECT pid, unit, n, round(n / total, 6) AS share, n >= 2 AND n / total >= 0.8 AS dominant FROM (SELECT *, sum(n) OVER (PARTITION BY pid) AS total, row_number() OVER (PARTITION BY pid ORDER BY n DESC, first) AS k FROM c) WHERE k = 1""")
def value_formats(spark, sf_dir):
    counts = load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("pid"), F.col("p_brand").alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))
    own = Window.partitionBy("pid")
    ranked = counts.withColumn("total", F.sum("n").over(own)).withColumn("k", F.row_number().over(own.orderBy(F.desc("n"), "first"))).filter("k = 1")
    share = F.col("n") / F.col("total")
    return ranked.select("pid", "unit", "n", F.round(share, 6).alias("share"), ((F.col("n") >= 2) & (share >= 0.8)).alias("dominant"))


@query("merged_literals", """SELECT l_orderkey AS sub, l_returnflag AS rel, string_agg(l_partkey::VARCHAR, ', ' ORDER BY l_linenumber, l_partkey) AS obj FROM lineitem GROUP BY 1, 2""")
def merged_literals(spark, sf_dir):
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sub"), F.col("l_returnflag").alias("rel")).agg(F.array_join(F.transform(items, lambda x: x["l_partkey"].cast("string")), ", ").alias("obj"))


@query("method_errors", "SELECT o_orderpriority AS system, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def method_errors(spark, sf_dir):
    wide = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("system")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("system", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("method_masks", "SELECT l_quantity > 25 AS a, l_discount > 0.05 AS b, l_tax > 0.04 AS c, count(*) AS n FROM lineitem GROUP BY ALL")
def method_masks(spark, sf_dir):
    masks = [(F.col("l_quantity") > 25).alias("a"), (F.col("l_discount") > 0.05).alias("b"), (F.col("l_tax") > 0.04).alias("c")]
    return load(spark, sf_dir, "lineitem").select(*masks).groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"))


@query("recall_rollup", """SELECT coalesce(l_returnflag, 'OVERALL') AS domain, round(avg((k <= 3)::INT), 6) AS rank3, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS k FROM lineitem) GROUP BY ROLLUP (l_returnflag)""")
def recall_rollup(spark, sf_dir):
    window = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber")
    ranked = load(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(window))
    return ranked.rollup("l_returnflag").agg(F.round(F.avg((F.col("k") <= 3).cast("double")), 6).alias("rank3"), F.count(F.lit(1)).alias("n")).select(F.coalesce("l_returnflag", F.lit("OVERALL")).alias("domain"), "rank3", "n")


@query("degree_profile", """SELECT count(*) AS n, round(avg(c), 6) AS mean, median(c)::DOUBLE AS median, max(c) AS largest, min(c) AS smallest FROM (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1)""")
def degree_profile(spark, sf_dir):
    counts = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean"), F.percentile("c", 0.5).alias("median"), F.max("c").alias("largest"), F.min("c").alias("smallest"))


@query("dedup_keep_first", "SELECT p_name, p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1")
def dedup_keep_first(spark, sf_dir):
    return curation.keep_first(load(spark, sf_dir, "part"), [F.lower("p_name")], [F.col("p_partkey")]).select("p_name", "p_partkey", "p_brand")


@query("dedup_keep_max", "SELECT l_orderkey, l_partkey, l_extendedprice, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) = 1")
def dedup_keep_max(spark, sf_dir):
    return curation.keep_first(load(spark, sf_dir, "lineitem"), [F.col("l_orderkey")], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", "l_partkey", "l_extendedprice", "l_linenumber")


@query("completed_batch", "SELECT c_custkey, max(o_totalprice) AS answer FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def completed_batch(spark, sf_dir):
    answers = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("answer"))
    return curation.complete(load(spark, sf_dir, "customer"), answers, "c_custkey")


@query("routed_rows", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unseen' WHEN c_mktsegment = 'BUILDING' THEN 'keep' WHEN c_mktsegment = 'MACHINERY' THEN 'rewrite' ELSE 'drop' END AS route FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def routed_rows(spark, sf_dir):
    decision = F.when(F.col("c_mktsegment") == "BUILDING", "none").when(F.col("c_mktsegment") == "MACHINERY", "self_contained").otherwise("ambiguous")
    decisions = load(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), decision.alias("decision"))
    return curation.routed(load(spark, sf_dir, "orders"), decisions, "o_custkey").select("o_orderkey", "route")


@query("balanced_negatives", """WITH p AS (SELECT event_id, (event_type = 'error')::INT AS y FROM events)
SELECT event_id, y FROM p WHERE y = 1 UNION ALL SELECT event_id, y FROM (SELECT event_id, y, row_number() OVER (ORDER BY md5('7|' || event_id), event_id) AS k FROM p WHERE y = 0) WHERE k <= (SELECT sum(y) FROM p)""")
def balanced_negatives(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("y"))
    return curation.balanced_negatives(rows, "y", "event_id")


@query("merged_messages", """WITH m AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM conversations), s AS (SELECT conv_id, g, string_agg(text || chr(10), '' ORDER BY turn, role, text) AS held FROM m WHERE role = 'system' GROUP BY 1, 2)
SELECT conv_id, coalesce(string_agg(role || ':' || CASE WHEN role = 'user' THEN coalesce(held, '') ELSE '' END || text, chr(10) ORDER BY turn, role, text) FILTER (role <> 'system'), '') AS chat FROM m LEFT JOIN s USING (conv_id, g) GROUP BY conv_id""")
def merged_messages(spark, sf_dir):
    merged = curation.merge_system(load(spark, sf_dir, "conversations"), "conv_id", "turn")
    return merged.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n").alias("chat"))


@query("stratified_sample", "SELECT doc_id, stratum, n FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY n_chars, doc_id) AS n FROM (SELECT doc_id, n_chars, ntile(20) OVER (ORDER BY n_chars, doc_id) AS stratum FROM documents)) WHERE n <= 25")
def stratified_sample(spark, sf_dir):
    return curation.stratified(load(spark, sf_dir, "documents"), {"n_chars": F.col("n_chars"), "__range": F.floor(F.col("doc_id") / 1_000_000)}, [F.col("doc_id")], 20, 25).select("doc_id", "stratum", "n")


@query("capped_feed", """WITH k AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS a FROM events WHERE value > 1 QUALIFY a <= 6)
SELECT event_id, user_id, event_type FROM k QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 10""")
def capped_feed(spark, sf_dir):
    rows = load(spark, sf_dir, "events").filter("value > 1")
    feed = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    kept = rows.withColumn("a", F.row_number().over(feed)).filter("a <= 6")
    return kept.withColumn("b", F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))).filter("b <= 10").select("event_id", "user_id", "event_type")


@query("recent_events", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events, (SELECT max(ts) AS now FROM events) WHERE ts IS NULL OR now - ts <= INTERVAL 48 HOURS")
def recent_events(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    now = rows.agg(F.max("ts").alias("now"))
    return rows.crossJoin(F.broadcast(now)).filter(F.col("ts").isNull() | (F.col("now") - F.col("ts") <= F.expr("INTERVAL 48 HOURS"))).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("symmetric_difference", "(SELECT c_custkey AS k, 'only_customers' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) UNION ALL (SELECT DISTINCT o_custkey, 'only_orders' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))")
def symmetric_difference(spark, sf_dir):
    a, b = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return a.join(b, "k", "left_anti").withColumn("side", F.lit("only_customers")).unionByName(b.join(a, "k", "left_anti").withColumn("side", F.lit("only_orders")))


@query("multiset_difference", "SELECT (SELECT count(*) FROM (SELECT l_partkey FROM lineitem EXCEPT ALL SELECT p_partkey FROM part)) AS fp, (SELECT count(*) FROM (SELECT p_partkey FROM part EXCEPT ALL SELECT l_partkey FROM lineitem)) AS fn, (SELECT count(*) FROM (SELECT l_partkey FROM lineitem INTERSECT ALL SELECT p_partkey FROM part)) AS tp")
def multiset_difference(spark, sf_dir):
    a, b = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(a.exceptAll(b), "fp").crossJoin(count(b.exceptAll(a), "fn")).crossJoin(count(a.intersectAll(b), "tp"))


@query("candidate_union", "SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size > 45 UNION SELECT l_partkey FROM lineitem WHERE l_discount > 0.09")
def candidate_union(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    pick = lambda df, c: df.select(F.col(c).alias("id"))
    return pick(lines.filter("l_quantity > 45"), "l_partkey").union(pick(load(spark, sf_dir, "part").filter("p_size > 45"), "p_partkey")).union(pick(lines.filter("l_discount > 0.09"), "l_partkey")).distinct()


@query("tag_context", "SELECT conv_id, turn, role, coalesce(lag(role, 1) OVER w, 'X') AS before1, coalesce(lag(role, 2) OVER w, 'X') AS before2, coalesce(lead(role, 1) OVER w, 'X') AS after1, coalesce(lead(role, 2) OVER w, 'X') AS after2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)")
def tag_context(spark, sf_dir):
    window = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    steps = [f("role", n, "X").over(window).alias(f"{name}{n}") for f, name in ((F.lag, "before"), (F.lead, "after")) for n in (1, 2)]
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", *steps)


@query("entropy_weights", """WITH n AS (SELECT p_name, count(*) AS n, count(DISTINCT p_brand) AS kinds FROM part GROUP BY 1)
SELECT p_name, n, CASE WHEN n >= 2 AND kinds / n >= 0.4 THEN 0.9 WHEN n <= 1 THEN 0.15 ELSE 0.5 END::DOUBLE AS wv FROM n""")
def entropy_weights(spark, sf_dir):
    counts = load(spark, sf_dir, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_brand").alias("kinds"))
    return counts.select("p_name", "n", F.when((F.col("n") >= 2) & (safe_ratio(F.col("kinds"), F.col("n")) >= 0.4), 0.9).when(F.col("n") <= 1, 0.15).otherwise(0.5).alias("wv"))


@query("json_properties", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_properties(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))
