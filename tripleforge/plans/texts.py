"""Queries on text normalisers, similarities, token arrays and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripleforge.functions import similarity, text
from tripleforge.functions.text import RESOURCE
from tripleforge.operators import arrays, retrieval

from .tables import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("normalized_text", r"SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS surface FROM documents")
def normalized_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("surface"))


@query("uri_names", f"""SELECT p_partkey, replace(p_type, ' ', '%20') || '+' || p_brand AS local, p_brand || '>' AS last, replace(p_brand, '#', '') AS fragment, p_type || '|' || replace(p_brand, '#', '') AS decoded FROM part""")
def uri_names(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    escaped = F.concat(F.replace("p_type", F.lit(" "), F.lit("%20")), F.lit("+"), "p_brand")
    return part.select(
        "p_partkey",
        F.replace(text.local_name(F.concat(F.lit(RESOURCE), escaped)), F.lit(" "), F.lit("%20")).alias("local"),
        F.concat(text.last_segment(F.concat(F.lit("<http://x/"), "p_brand", F.lit(">"))), F.lit(">")).alias("last"),
        text.fragment_name(F.concat(F.lit("http://x/y#"), F.replace("p_brand", F.lit("#"), F.lit("")))).alias("fragment"),
        F.concat(text.percent_decoded(F.col("p_type")), F.lit("|"), text.fragment_name(F.concat(F.lit("http://x/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/")))).alias("decoded"),
    )


@query("camel_case", r"""SELECT p_partkey, replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' ') AS camel, lower(trim(regexp_replace(regexp_replace(regexp_replace(x, '[_.\-]', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '\s+', ' ', 'g'))) AS words,
  x[1] || regexp_replace(x[2:], '([A-Z])', ' \1', 'g') AS spaced FROM (SELECT p_partkey, replace(p_name, ' ', '_') || replace(p_brand, '#', '') || 'Of' || p_size AS x FROM part)""")
def camel_case(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("Of"), F.col("p_size").cast("string")).alias("x"))
    return rows.select("p_partkey", text.split_camel(F.col("x")).alias("camel"), text.split_camel_words(F.col("x")).alias("words"), text.space_capitals(F.col("x")).alias("spaced"))


@query("label_texts", "SELECT p_partkey, 'predicate: ' || p_partkey || '. label: ' || p_name || CASE WHEN p_size > 25 THEN '. comment: ' || p_type ELSE '' END AS label_text FROM part")
def label_texts(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.label_text(F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string")), F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_type"))).alias("label_text"))


@query("plain_pages", r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))[1:900] AS snippet FROM pages""")
def plain_pages(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", text.clean_snippet(text.strip_tags(F.col("html"))).alias("snippet"))


@query("main_text")
def main_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", text.main_text(F.col("html")).alias("body"))


@query("annotated_mentions", """SELECT doc_id, CASE WHEN position('the' IN lower(text)) > 0 THEN text[1:position('the' IN lower(text)) - 1] || '[START] ' || text[position('the' IN lower(text)):position('the' IN lower(text)) + 2] || ' [END]' || text[position('the' IN lower(text)) + 3:] END AS annotated FROM documents""")
def annotated_mentions(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.annotate_mention(F.col("text"), F.lit("the")).alias("annotated"))


@query("language_mixing", r"""SELECT doc_id, round(CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0 THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(regexp_replace(text, '[^\p{L}]', '', 'g')) ELSE 0 END, 6) AS ratio FROM documents""")
def language_mixing(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.round(text.ascii_letter_ratio(F.col("text")), 6).alias("ratio"))


@query("iso_dates", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%d') AS b, CASE WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS c, NULL::VARCHAR AS d FROM orders""")
def iso_dates(spark, sf_dir):
    day = F.col("o_orderdate")
    suffix = F.concat(F.date_format(day, "d"), F.lit("th"), F.date_format(day, " MMMM yyyy"))
    return load(spark, sf_dir, "orders").select("o_orderkey", text.iso_date(F.date_format(day, "MMMM d, yyyy")).alias("a"), text.iso_date(suffix).alias("b"), text.iso_date(F.date_format(day, "dd-MM-yyyy")).alias("c"), text.iso_date(F.concat(F.lit("on "), F.date_format(day, "yyyy"))).alias("d"))


@query("slugs", r"""SELECT l_orderkey AS id, coalesce(string_agg('Order ' || l_orderkey || '|has ' || l_returnflag || '|' || CASE WHEN l_quantity > 25 THEN 'Part ' || l_partkey ELSE 'NONE' END, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) FILTER (l_discount < 0.08), 'NONE') AS slug, true AS valid FROM lineitem GROUP BY 1""")
def slugs(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    item = F.struct(F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), F.col("l_extendedprice"), F.when(F.col("l_discount") < 0.08, F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"))).otherwise(" ").alias("s"), F.concat(F.lit("has "), "l_returnflag").alias("r"), F.when(F.col("l_quantity") > 25, F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))).alias("o"))
    made = lines.groupBy(F.col("l_orderkey").alias("id")).agg(text.slug(F.array_sort(F.collect_list(item))).alias("slug"))
    return made.withColumn("valid", text.slug_valid(F.col("slug"), strict=True))


@query("final_answers", "SELECT conv_id, turn, trim(text) AS answer FROM conversations")
def final_answers(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").withColumn("raw", F.concat(F.lit("[ANSWER] no "), "role", F.lit(" [ANSWER] "), "text"))
    return rows.select("conv_id", "turn", text.final_answer(F.col("raw")).alias("answer"))


@query("formatted_objects", """SELECT p_partkey, CASE WHEN p_size > 25 THEN replace(p_name, ' ', '_') ELSE '"' || p_name || '"' END AS object FROM part""")
def formatted_objects(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.format_object(F.when(F.col("p_size") > 25, F.col("p_name")), F.concat(F.lit('"'), "p_name")).alias("object"))


@query("lexical_similarity", """WITH t AS (SELECT p_partkey, lower(p_name) AS a, lower(split_part(p_name, ' ', 1)) AS b FROM part)
SELECT p_partkey, CASE WHEN a = b THEN 1.0 WHEN length(b) / length(a) >= 0.7 THEN 0.9 WHEN length(b) / length(a) >= 0.4 THEN 0.7 ELSE 0.5 END::DOUBLE AS sim FROM t""")
def lexical_similarity(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", similarity.lexical(F.col("p_name"), F.split("p_name", " ")[0]).cast("double").alias("sim"))


@query("token_jaccard", r"""WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type || ' ' || split_part(p_name, ' ', 2)), ' ')) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS sim FROM t""")
def token_jaccard(spark, sf_dir):
    words = lambda c: F.split(F.lower(c), " ")
    other = F.concat("p_type", F.lit(" "), F.split("p_name", " ")[1])
    return load(spark, sf_dir, "part").select("p_partkey", F.round(similarity.jaccard(words(F.col("p_name")), words(other)), 6).alias("sim"))


def _ends(a: str, b: str) -> str:
    """SQL: length of the longest common prefix."""
    return f"coalesce(list_max(list_filter(range(1, least(length({a}), length({b})) + 1), lambda k: {a}[1:k] = {b}[1:k])), 0)"


@query("predicate_alignment", f"""WITH n AS (SELECT DISTINCT p_type AS domain, lower(p_name) AS predicate FROM part), a AS (SELECT DISTINCT p_type AS domain, lower(p_name) AS allowed FROM part WHERE p_size > 44),
j AS (SELECT domain, predicate, allowed, string_split(predicate, ' ') AS x, string_split(allowed, ' ') AS y FROM n JOIN a USING (domain)),
s AS (SELECT domain, predicate, allowed, round(CASE WHEN predicate = allowed THEN 1.0 ELSE greatest(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), greatest({_ends('predicate', 'allowed')}, {_ends('reverse(predicate)', 'reverse(allowed)')}) / greatest(length(predicate), length(allowed))) END, 6)::DOUBLE AS sim FROM j)
SELECT domain, predicate, allowed, sim FROM s WHERE sim >= 0.6 QUALIFY row_number() OVER (PARTITION BY domain, predicate ORDER BY sim DESC, allowed) = 1""")
def predicate_alignment(spark, sf_dir):
    """Each predicate against the allowed ones of its domain: the best of at least 0.6, the first of equal ones."""
    part = load(spark, sf_dir, "part").select(F.col("p_type").alias("domain"), F.lower("p_name").alias("predicate"), "p_size")
    allowed = part.filter("p_size > 44").select("domain", F.col("predicate").alias("allowed")).distinct()
    scored = part.select("domain", "predicate").distinct().join(allowed, "domain").withColumn("sim", F.round(similarity.predicate_similarity(F.col("predicate"), F.col("allowed")), 6)).filter("sim >= 0.6")
    window = Window.partitionBy("domain", "predicate").orderBy(F.desc("sim"), "allowed")
    return scored.withColumn("k", F.row_number().over(window)).filter("k = 1").select("domain", "predicate", "allowed", "sim")


@query("distance_buckets", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 5 THEN l_quantity::BIGINT ELSE least(floor(log2(l_quantity)), 6)::BIGINT + 2 END AS bucket FROM lineitem")
def distance_buckets(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", similarity.distance_bucket(F.col("l_quantity").cast("long")).alias("bucket"))


@query("sublist_search", r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)
SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'the' AND w[i + 1] = 'of'))::BIGINT AS n, list_min(list_filter(range(1, len(w)), lambda i: w[i] = 'the' AND w[i + 1] = 'of')) - 1 AS first FROM t""")
def sublist_search(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", arrays.sublist_starts(text.tokens(F.col("text")), F.array(F.lit("the"), F.lit("of"))).alias("at"))
    return rows.select("doc_id", F.size("at").cast("long").alias("n"), F.array_min("at").cast("long").alias("first"))


@query("padded_tokens", r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)
SELECT doc_id, array_to_string(list_concat(w, list_transform(range(0, 40), lambda i: '<pad>'))[1:40], ' ') AS padded, array_to_string(w[1:2], ' ') AS "left", greatest(len(w) - 5, 0)::BIGINT AS n_right FROM t""")
def padded_tokens(spark, sf_dir):
    words = text.tokens(F.col("text"))
    around = arrays.parts_around(words, F.lit(2), F.lit(5))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(arrays.padded(words), " ").alias("padded"), F.array_join(around["left"], " ").alias("left"), F.size(around["right"]).cast("long").alias("n_right"))


_BM25 = r"""w AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark), tf AS (SELECT id, token, count(*) AS tf FROM w GROUP BY 1, 2),
l AS (SELECT item_id AS id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM benchmark), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
s AS (SELECT token, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(avgdl) AS avgdl FROM tf, n GROUP BY token)"""


@query("bm25_statistics", f"WITH {_BM25} SELECT token, df, round(idf, 6) AS idf, round(avgdl, 6) AS avgdl FROM s")
def bm25_statistics(spark, sf_dir):
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return retrieval.bm25_statistics(items)[1].select("token", "df", F.round("idf", 6).alias("idf"), F.round("avgdl", 6).alias("avgdl"))


def _pool(spark, sf_dir):
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return items, retrieval.bm25_search(items, items.select(F.col("id").alias("qid"), "text"))


@query("bm25_top24", f"""WITH {_BM25}, q AS (SELECT DISTINCT id AS qid, token FROM w),
sc AS (SELECT qid, tf.id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN s USING (token) JOIN tf USING (token) JOIN l ON l.id = tf.id GROUP BY 1, 2)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 24""")
def bm25_top24(spark, sf_dir):
    return _pool(spark, sf_dir)[1]


@query("mmr_examples")
def mmr_examples(spark, sf_dir):
    items, pool = _pool(spark, sf_dir)
    return retrieval.mmr(pool.filter("qid <> id").join(items, "id").select("qid", "id", "score", "text"))
