"""Queries on parsers of model answers, on spans, tags and coreference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripleforge.functions import answers, spans
from tripleforge.functions.similarity import safe_ratio
from tripleforge.functions.text import surface_variants

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


@query("fenced_json", "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 5 <> 0 THEN p_size::BIGINT END AS size FROM part")
def fenced_json(spark, sf_dir):
    body = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    kind = F.col("p_partkey") % 5
    raw = F.when(kind == 0, F.concat(F.lit("no answer about "), "p_name")).when(kind == 1, body).when(kind == 2, F.concat(F.lit("Sure! "), body, F.lit(" Done."))).otherwise(F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```")))
    parsed = F.from_json(answers.json_block(raw), "name string, size long")
    return load(spark, sf_dir, "part").select("p_partkey", parsed["name"].alias("name"), parsed["size"].alias("size"))


@query("json_list_triples", "SELECT l_orderkey AS id, 'Order ' || l_orderkey AS s, 'has ' || l_returnflag AS r, 'Part ' || l_partkey AS o, count(*) AS n FROM lineitem WHERE l_quantity >= 5 GROUP BY ALL")
def json_list_triples(spark, sf_dir):
    """Lists of lists with single quotes; an empty object or a missing slot goes."""
    line = F.format_string("['Order %s', 'has %s'%s]", F.col("l_orderkey"), F.col("l_returnflag"), F.when(F.col("l_quantity") < 2, "").when(F.col("l_quantity") < 5, ", ' '").otherwise(F.concat(F.lit(", 'Part "), F.col("l_partkey").cast("string"), F.lit("'"))))
    raw = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(F.lit("Answer: ["), F.array_join(F.collect_list(line), ", "), F.lit("] ok")).alias("raw"))
    return raw.select("id", F.inline(answers.json_list_triples(F.col("raw")))).groupBy("id", "s", "r", "o").agg(F.count(F.lit(1)).alias("n"))


@query("function_calls", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Order ' || o_orderkey END AS subject, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS relation FROM orders")
def function_calls(spark, sf_dir):
    kind = F.col("o_orderkey") % 3
    raw = F.format_string('thinking {"name": "%s", "arguments": {"subject": "Order %s", "relation": "%s"%s}} done', F.when(kind == 1, "other").otherwise("extract_relation"), "o_orderkey", "o_orderpriority", F.when(kind == 2, ",,,").otherwise(""))
    call = answers.function_call(raw, "extract_relation")
    return load(spark, sf_dir, "orders").select("o_orderkey", call["subject"].alias("subject"), call["relation"].alias("relation"))


_ANSWERS_SQL = "a AS (SELECT p_partkey, CASE WHEN p_partkey % 7 < 2 THEN 'json' WHEN p_partkey % 7 < 5 THEN 'patterns' WHEN p_partkey % 7 = 5 THEN 'fallback' ELSE 'failed' END AS method, p_name, p_type, p_brand FROM part)"


def _answers(spark, sf_dir):
    raw = None
    for k, template in enumerate(('Output: {"s": "%1$s", "p": "%2$s", "o": "%3$s"}', 'see {"विषय": "%1$s", "संबंध": "%2$s", "वस्तु": "%3$s"}, fine', "(%1$s, %2$s, %3$s)", "1. %1$s - %2$s - %3$s", "%1$s -> %2$s -> %3$s", '"%1$s", %2$s, [%3$s]', "nothing said")):
        made = F.format_string(template, "p_name", "p_type", "p_brand")
        raw = F.when(F.col("p_partkey") % 7 == k, made) if raw is None else raw.when(F.col("p_partkey") % 7 == k, made)
    return load(spark, sf_dir, "part").select("p_partkey", answers.answer_triples(raw).alias("answer"))


@query("answer_triples", f"WITH {_ANSWERS_SQL} SELECT p_partkey, method, p_name AS s, p_type AS r, p_brand AS o FROM a WHERE method <> 'failed'")
def answer_triples(spark, sf_dir):
    return _answers(spark, sf_dir).select("p_partkey", F.col("answer.method").alias("method"), F.inline("answer.triples"))


@query("parse_statistics", f"WITH {_ANSWERS_SQL} SELECT count(*) AS responses, count(*) FILTER (method <> 'failed') AS parsed, count(*) FILTER (method <> 'failed') AS triples, count(*) FILTER (method = 'json') AS json, count(*) FILTER (method = 'patterns') AS patterns, count(*) FILTER (method = 'fallback') AS fallback, count(*) FILTER (method = 'failed') AS failed, round(count(*) FILTER (method <> 'failed') / count(*) FILTER (method <> 'failed'), 6) AS per_response FROM a")
def parse_statistics(spark, sf_dir):
    method, n = F.col("answer.method"), F.sum(F.size("answer.triples"))
    parsed = F.count_if(method != "failed")
    return _answers(spark, sf_dir).agg(F.count(F.lit(1)).alias("responses"), parsed.alias("parsed"), n.alias("triples"), *[F.count_if(method == m).alias(m) for m in ("json", "patterns", "fallback", "failed")], F.round(safe_ratio(n, parsed), 6).alias("per_response"))


@query("checked_answers", """SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN p_name || '|' || p_type || '|' || p_brand ELSE '' END AS triples,
CASE p_partkey % 4 WHEN 2 THEN 'No valid triples parsed from: {"triples": [{"subject": "' || p_name || '"}]}' WHEN 3 THEN 'Could not parse JSON from: ' || p_name END AS parse_error FROM part""")
def checked_answers(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    one = '"subject": "%s", "predicate": "%s", "%s": "%s"'
    listed = F.format_string('```json\n{"triples": [{' + one + '}, {"subject": "x"}]}\n```', "p_name", "p_type", F.lit("object"), "p_brand")
    single = F.format_string("{" + one + "}", "p_name", "p_type", F.lit("object_"), "p_brand")
    raw = F.when(kind == 0, listed).when(kind == 1, single).when(kind == 2, F.format_string('{"triples": [{"subject": "%s"}]}', "p_name")).otherwise(F.col("p_name"))
    checked = answers.checked_answer(raw)
    lines = F.array_join(F.transform(checked["triples"], lambda t: F.concat_ws("|", t["s"], t["r"], t["o"])), "\n")
    return load(spark, sf_dir, "part").select("p_partkey", lines.alias("triples"), checked["parse_error"].alias("parse_error"))


@query("genre_titles", "SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN 'a >> ' || p_name || ' >> c' ELSE p_name END AS title, CASE p_partkey % 3 WHEN 0 THEN 'de' ELSE 'en' END AS lang FROM part")
def genre_titles(spark, sf_dir):
    kind = F.col("p_partkey") % 3
    raw = F.when(kind == 0, F.concat(F.lit(" "), "p_name", F.lit(" >> de "))).when(kind == 1, F.concat("p_name", F.lit(" "))).otherwise(F.concat(F.lit("a >> "), "p_name", F.lit(" >> c")))
    return load(spark, sf_dir, "part").select("p_partkey", F.inline(F.array(answers.title_and_language(raw))))


@query("unmarked_texts", "SELECT p_partkey, p_name || ' । ' || p_type AS text FROM part")
def unmarked_texts(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", answers.without_marks(F.concat(F.lit("\U0001f600\U0001f680"), "p_name", F.lit("️ | "), "p_type")).alias("text"))


@query("mail_dates", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T11:05:10Z' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T23:00:00Z' END AS at FROM orders")
def mail_dates(spark, sf_dir):
    kind, day = F.col("o_orderkey") % 3, lambda f: F.date_format("o_orderdate", f)
    raw = F.when(kind == 0, F.concat(day("EEE, dd MMM yyyy"), F.lit(" 13:05:10 +0200"))).when(kind == 1, F.concat(day("d MMM yyyy"), F.lit(" 23:00:00 GMT"))).otherwise(day("yyyy, dd"))
    return load(spark, sf_dir, "orders").select("o_orderkey", answers.mail_date(raw).alias("at"))


@query("property_texts", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || ' | ' || p_type ELSE 'p_' || p_partkey END || CASE WHEN p_size % 2 = 0 THEN ' | ' || p_brand ELSE '' END AS text FROM part")
def property_texts(spark, sf_dir):
    labels = F.when(F.col("p_size") > 25, F.array("p_name", "p_type")).otherwise(F.array().cast("array<string>"))
    uri = F.concat(F.lit("http://kg.example.org/ontology/p_"), F.col("p_partkey").cast("string"))
    return load(spark, sf_dir, "part").select("p_partkey", spans.property_text(uri, labels, F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))).alias("text"))


@query("older_variants", """WITH t AS (SELECT p_partkey, 'The ' || p_name AS m, 'The ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part),
v AS (SELECT p_partkey, unnest([m, lower(m), title, replace(m, ' ', '_'), replace(title, ' ', '_')]) AS variant FROM t) SELECT DISTINCT p_partkey, variant FROM v""")
def older_variants(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.explode(spans.older_variants(F.concat(F.lit("The "), "p_name"))).alias("variant"))


@query("restored_initials", """WITH t AS (SELECT p_partkey, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS a, 'Stone' AS z, chr(65 + (p_size % 26)::INT) AS i FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN a || '_' || i || '._' || z WHEN p_partkey % 3 = 1 THEN a || '_Rivers' ELSE a || '_' || z END AS name FROM t""")
def restored_initials(spark, sf_dir):
    kind, first = F.col("p_partkey") % 3, F.initcap(F.split("p_name", " ")[0])
    mention = F.when(kind == 2, F.concat(first, F.lit(" Stone"))).otherwise(F.concat(first, F.lit(" "), F.char(65 + F.col("p_size") % 26), F.lit(". Stone")))
    resolved = F.concat(first, F.when(kind == 1, "_Rivers").otherwise("_Stone"))
    return load(spark, sf_dir, "part").select("p_partkey", spans.restored_initial(resolved, mention).alias("name"))


@query("formatted_mentions", "SELECT p_partkey, 'a [' || p_name || '](#) (best) is no [' || split_part(p_name, ' ', 2) || '](#)' AS text FROM part")
def formatted_mentions(spark, sf_dir):
    word = F.split("p_name", " ")[1]
    sentence = F.concat(F.lit("a "), "p_name", F.lit(" (best) is no "), word)
    return load(spark, sf_dir, "part").select("p_partkey", spans.formatted_mentions(sentence, F.array(word, F.col("p_name"))).alias("text"))


@query("coref_chains", "SELECT p_partkey, '1' AS chain, p_name || ',it' AS mentions FROM part UNION ALL SELECT p_partkey, '2', p_brand FROM part")
def coref_chains(spark, sf_dir):
    text = F.format_string("[%s](#1) of [%s](#2) sells, [it](#1) does", "p_name", "p_brand")
    rows = load(spark, sf_dir, "part").select("p_partkey", F.inline(spans.chains(text)))
    return rows.select("p_partkey", "chain", F.array_join("mentions", ",").alias("mentions"))


@query("resolved_chains", "SELECT p_partkey, p_name || ' fell and ' || p_name || ' broke; ' || p_brand || ' said ' || p_brand || ' knew' AS text FROM part")
def resolved_chains(spark, sf_dir):
    sentence = F.concat("p_name", F.lit(" fell and the thing broke; "), "p_brand", F.lit(" said they knew"))
    chains = F.array(F.array(F.col("p_name"), F.lit("the thing")), F.array(F.col("p_brand"), F.lit("they")))
    return load(spark, sf_dir, "part").select("p_partkey", spans.resolved(sentence, chains).alias("text"))


@query("case_markers", """SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN p_name ELSE p_name END AS bare, CASE p_partkey % 4 WHEN 0 THEN p_brand || ' को' WHEN 1 THEN p_brand || ' का' WHEN 2 THEN p_brand || ' को' ELSE p_brand END AS marked FROM part""")
def case_markers(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    span = F.when(kind == 0, F.concat("p_name", F.lit(" को"))).when(kind == 1, F.concat("p_name", F.lit(" के लिए"))).when(kind == 2, F.concat(F.lit("हे "), "p_name")).otherwise(F.col("p_name"))
    pronoun = F.when(kind == 0, "उसको").when(kind == 1, "उसका").when(kind == 2, "उन्हें").otherwise("वह")
    return load(spark, sf_dir, "part").select("p_partkey", spans.without_case_marker(span).alias("bare"), spans.with_case_marker(F.col("p_brand"), pronoun).alias("marked"))


@query("pronoun_verdicts", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'self_contained' ELSE 'none' END AS verdict FROM part")
def pronoun_verdicts(spark, sf_dir):
    kind = F.col("p_partkey") % 5
    span = F.when(kind == 0, F.concat(F.lit(" उसने "), "p_name")).when(kind == 1, "यह").when(kind == 2, F.concat(F.lit("यह "), "p_name")).when(kind == 3, F.concat(F.lit("यहाँ "), "p_name")).otherwise(F.lit(None).cast("string"))
    return load(spark, sf_dir, "part").select("p_partkey", spans.pronoun_verdict(span).alias("verdict"))


@query("entry_pronouns", "SELECT l_orderkey AS id, CASE WHEN bool_or(l_returnflag = 'R' AND l_linestatus = 'F') THEN 'ambiguous' ELSE 'self_contained' END AS status FROM lineitem GROUP BY 1")
def entry_pronouns(spark, sf_dir):
    """An entry is ambiguous when a triple of another relation than ``property`` has an ambiguous span."""
    triple = F.struct(F.when(F.col("l_returnflag") == "R", "उसे").otherwise("यह शहर").alias("subject"), F.when(F.col("l_linestatus") == "F", "has").otherwise(" property ").alias("relation"), F.lit("x").alias("object"))
    content = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.to_json(F.struct(F.collect_list(triple).alias("extracted_triplets"))).alias("content"))
    return content.select("id", spans.entry_pronoun_status(F.col("content")).alias("status"))


@query("notebook_errors", "SELECT l_orderkey, l_linenumber, l_partkey, CASE (l_partkey % 4) WHEN 0 THEN 'LANGUAGE_MIXING' WHEN 1 THEN 'IMPLICIT_RELATION' WHEN 2 THEN 'PREDICATE_NORMALIZATION' ELSE 'LANGUAGE_MIXING' END AS kind FROM lineitem")
def notebook_errors(spark, sf_dir):
    kind = F.col("l_partkey") % 4
    relation = F.when(kind == 0, "was born in").when(kind == 1, " है ").when(kind == 2, "जन्म स्थान").otherwise("dbo:birthPlace")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", spans.notebook_error(relation).alias("kind"))


@query("refinements", "SELECT p_partkey, p_partkey % 3 <> 2 AS refines FROM part")
def refinements(spark, sf_dir):
    kind = F.col("p_partkey") % 3
    wanted = F.when(kind == 0, F.concat(F.upper("p_name"), F.lit(", "), "p_brand")).when(kind == 1, " ").otherwise(F.lit("0123456789 0123456789"))
    return load(spark, sf_dir, "part").select("p_partkey", spans.refines(wanted, F.col("p_name")).alias("refines"))


@query("judge_consistency", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'ADJUST_PREDICATE' ELSE 'APPROVED' END ELSE 'REJECTED' END AS status, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS suggested FROM orders")
def judge_consistency(spark, sf_dir):
    verdict = F.when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("REJECTED")
    feedback = F.when(F.col("o_orderkey") % 2 == 0, "The predicate SHOULD BE deathPlace").otherwise("all fine")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.inline(F.array(spans.consistent_verdict(verdict, feedback, F.col("o_orderpriority")))))


_TAGS_SQL = "t AS (SELECT l_orderkey AS id, list(CASE l_returnflag WHEN 'A' THEN 'B_NP' WHEN 'N' THEN 'I_NP' ELSE CASE WHEN l_linestatus = 'F' THEN 'I_VP' ELSE 'X' END END ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS w FROM lineitem GROUP BY 1)"


def _tags(spark, sf_dir):
    tag = F.when(F.col("l_returnflag") == "A", "B_NP").when(F.col("l_returnflag") == "N", "I_NP").when(F.col("l_linestatus") == "F", "I_VP").otherwise("X")
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", tag.alias("t"))))
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(items, lambda x: x["t"]).alias("tags"))


@query("chunk_validity", f"WITH {_TAGS_SQL} SELECT id, NOT starts_with(w[1], 'I_') AND len(list_filter(range(1, len(w)), lambda i: starts_with(w[i + 1], 'I_') AND w[i] <> 'X' AND w[i][3:] <> w[i + 1][3:])) = 0 AS valid FROM t")
def chunk_validity(spark, sf_dir):
    return _tags(spark, sf_dir).select("id", spans.chunks_valid(F.col("tags")).alias("valid"))


@query("resolved_tags", f"""WITH {_TAGS_SQL}, e AS (SELECT id, unnest(w) AS tag, unnest(range(1, len(w) + 1)) AS i, w FROM t),
f AS (SELECT *, max(CASE WHEN tag <> 'X' THEN i END) OVER (PARTITION BY id ORDER BY i) AS known FROM e)
SELECT id, string_agg(CASE WHEN tag <> 'X' THEN tag WHEN known IS NOT NULL THEN 'I_' || w[known][3:] WHEN i = 1 THEN CASE WHEN len(w) < 2 THEN 'NP' WHEN w[2] = 'X' THEN 'B_NP' ELSE 'B_' || w[2][3:] END
  ELSE 'I_NP' END, ' ' ORDER BY i) AS tags FROM f GROUP BY id""")
def resolved_tags(spark, sf_dir):
    return _tags(spark, sf_dir).select("id", F.array_join(spans.resolved_tags(F.col("tags")), " ").alias("tags"))


@query("chunk_phrases", """WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS word, unnest(range(0, len(string_split(text, ' ')))) AS i FROM benchmark),
c AS (SELECT *, sum((i % 3 = 0)::INT) OVER (PARTITION BY item_id ORDER BY i) - 1 AS phrase FROM w) SELECT item_id, phrase::BIGINT AS phrase, string_agg(word, ' ' ORDER BY i) AS words, min(i)::BIGINT AS first FROM c GROUP BY 1, 2""")
def chunk_phrases(spark, sf_dir):
    words = F.split("text", " ", -1)
    tags = F.transform(words, lambda w, i: F.when(i % 3 == 0, "B_NP").otherwise("I_NP"))
    rows = load(spark, sf_dir, "benchmark").select("item_id", F.posexplode(spans.phrases(words, tags)).alias("phrase", "x"))
    return rows.select("item_id", F.col("phrase").cast("long").alias("phrase"), F.array_join("x.words", " ").alias("words"), F.col("x.first").cast("long").alias("first"))


@query("word_places", """WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), p AS (SELECT item_id, list_position(w, 'the') - 1 AS a, list_position(w, 'of') - 1 AS b FROM t)
SELECT item_id, coalesce(a, b) AS first, coalesce(b, a) AS last FROM (SELECT item_id, CASE WHEN a >= 0 THEN a END AS a, CASE WHEN b >= 0 THEN b END AS b FROM p) WHERE coalesce(a, b) IS NOT NULL AND NOT (coalesce(a, b) = 0 AND coalesce(b, a) = 0)""")
def word_places(spark, sf_dir):
    from tripleforge.functions.text import tokens

    rows = load(spark, sf_dir, "benchmark").select("item_id", spans.word_places(tokens(F.col("text")), F.array(F.lit("the"), F.lit("of"))).alias("at"))
    return rows.filter("at IS NOT NULL").select("item_id", F.col("at.first").cast("long").alias("first"), F.col("at.last").cast("long").alias("last"))


@query("span_order", """WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), p AS (SELECT item_id, greatest(list_position(w, 'the') - 1, 0) AS a, greatest(list_position(w, 'in') - 1, 0) AS b FROM t),
c AS (SELECT item_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM p) SELECT item_id, least(a, b)::BIGINT AS left_at, greatest(a, b)::BIGINT AS right_at, CASE WHEN a > b THEN 0 ELSE 1 END::BIGINT AS direction FROM c""")
def span_order(spark, sf_dir):
    """Places of a cause and an effect in order, 0 for one that isn't there; the direction is 0 where the cause comes later."""
    from tripleforge.functions.text import tokens

    place = lambda w: F.greatest(F.coalesce(F.array_position(tokens(F.col("text")), w), F.lit(0)) - 1, F.lit(0))
    rows = load(spark, sf_dir, "benchmark").select("item_id", place("the").alias("a"), place("in").alias("b"))
    return rows.select("item_id", F.least("a", "b").cast("long").alias("left_at"), F.greatest("a", "b").cast("long").alias("right_at"), F.when(F.col("a") > F.col("b"), 0).otherwise(1).cast("long").alias("direction"))


@query("nearest_phrases", """WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), p AS (SELECT item_id, list_position(w, 'the') AS a, unnest([[1, list_position(w, 'of')], [2, list_position(w, 'in')], [3, list_position(w, 'and')]]) AS c FROM t)
SELECT item_id, min_by(['of', 'in', 'and'][c[1]::INT], abs(c[2] - a) * 10 + c[1]) AS nearest FROM p WHERE a > 0 AND c[2] > 0 GROUP BY item_id""")
def nearest_phrases(spark, sf_dir):
    from tripleforge.functions.text import tokens

    rows = load(spark, sf_dir, "benchmark").select("item_id", spans.nearest(tokens(F.col("text")), F.lit("the"), F.array(F.lit("of"), F.lit("in"), F.lit("and"))).alias("nearest"))
    return rows.filter("nearest IS NOT NULL")


@query("antecedents", """WITH m AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'R' THEN 'PRON' WHEN 'A' THEN 'PROPN' ELSE 'NOUN' END AS pos, l_quantity AS len, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem),
c AS (SELECT a.id, a.i, b.i AS j, b.pos, row_number() OVER (PARTITION BY a.id, a.i ORDER BY (b.pos = 'PROPN') DESC, CASE WHEN b.pos = 'PROPN' THEN b.len ELSE 0 END, b.i DESC) AS k FROM m a JOIN m b ON a.id = b.id AND b.i < a.i AND b.pos <> 'PRON' WHERE a.pos = 'PRON')
SELECT id, i, j AS antecedent FROM c WHERE k = 1""")
def antecedents(spark, sf_dir):
    """Of a pronoun, the shortest proper noun before it (the nearest of equal ones), else the nearest noun."""
    chain = Window.partitionBy("id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pos = F.when(F.col("l_returnflag") == "R", "PRON").when(F.col("l_returnflag") == "A", "PROPN").otherwise("NOUN")
    rows = load(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey")).withColumns({"pos": pos, "i": F.row_number().over(chain).cast("long")})
    return spans.antecedents(rows, "id", "i", "pos", "l_quantity")


@query("longest_entities", "SELECT id, string_agg(name, ',' ORDER BY k DESC) AS names FROM (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY length(name) DESC, name DESC) AS k FROM (SELECT DISTINCT l_orderkey AS id, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey)) WHERE k <= 2 GROUP BY id")
def longest_entities(spark, sf_dir):
    """The two longest distinct entities of a sentence, shorter one first; of equally long ones the later names."""
    named = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), F.col("p_name").alias("name")).distinct()
    ordered = F.array_sort(F.collect_list(F.struct(F.length("name").alias("n"), "name")))
    return named.groupBy("id").agg(F.array_join(F.transform(F.slice(ordered, F.greatest(F.size(ordered) - 1, F.lit(1)), 2), lambda x: x["name"]), ",").alias("names"))


@query("subword_windows", """WITH RECURSIVE s AS (SELECT l_orderkey AS id, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::BIGINT AS stop FROM lineitem), b AS (SELECT id, list(stop) AS stops, max(stop) AS n FROM s GROUP BY 1),
w AS (SELECT id, 0::BIGINT AS first, CASE WHEN n <= 60 THEN n ELSE coalesce(list_max(list_filter(stops, lambda x: x <= 60)), 60) END AS last, stops, n FROM b
UNION ALL SELECT id, last, CASE WHEN n <= last + 60 THEN n ELSE coalesce(list_max(list_filter(stops, lambda x: x > last AND x <= last + 60)), last + 60) END, stops, n FROM w WHERE last < n)
SELECT id, first, last FROM w""")
def subword_windows(spark, sf_dir):
    """Windows of at most 60 pieces that end where a sentence ends; a longer sentence is cut hard."""
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(parts, lambda x: x["l_quantity"].cast("long")).alias("sizes"))
    return rows.select("id", F.inline(spans.bounded_windows(F.col("sizes"), 60)))


@query("pruned_antecedents", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) <= 3")
def pruned_antecedents(spark, sf_dir):
    best = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber")
    return load(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(best)).filter("k <= 3").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("vocabulary_blocks", "SELECT p_type AS domain, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS vocabulary FROM part GROUP BY 1")
def vocabulary_blocks(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("domain")).agg(F.array_join(F.sort_array(F.collect_set("p_brand")), ", ").alias("vocabulary"))


@query("few_shot_blocks", """SELECT l_orderkey AS id, string_agg('{"subject": "Order ' || l_orderkey || '", "predicate": "has ' || l_returnflag || '", "object": "' || CASE WHEN l_linestatus = 'F' THEN 'a_b' ELSE 'Part ' || l_partkey END || '"}', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS block FROM lineitem GROUP BY 1""")
def few_shot_blocks(spark, sf_dir):
    """Triples as a prompt's example has them: names with spaces, literals without their quotes."""
    obj = F.when(F.col("l_linestatus") == "F", F.lit('"a_b"')).otherwise(F.concat(F.lit("Part_"), F.col("l_partkey").cast("string")))
    triple = spans.example_line(F.concat(F.lit("Order_"), F.col("l_orderkey").cast("string")), F.concat(F.lit("has "), "l_returnflag"), obj)
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", triple.alias("line"))))
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias("block"))


@query("latest_checkpoints", "SELECT o_custkey, 'out/checkpoint-' || max(o_orderkey) AS path FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def latest_checkpoints(spark, sf_dir):
    path = F.concat(F.when(F.col("o_orderkey") % 3 != 0, "out/checkpoint-").otherwise("out/final-"), F.col("o_orderkey").cast("string"))
    rows = load(spark, sf_dir, "orders").select("o_custkey", path.alias("path")).withColumn("n", F.regexp_extract("path", r"checkpoint-(\d+)$", 1)).filter("n <> ''")
    return rows.groupBy("o_custkey").agg(F.max_by("path", F.col("n").cast("long")).alias("path"))


@query("lookup_variant_order", """WITH t AS (SELECT p_partkey, p_name, 'THE ' || p_name AS m FROM part) SELECT p_partkey, lower(m) AS first, replace(lower(m), ' ', '_') AS second, p_name AS bare FROM t""")
def lookup_variant_order(spark, sf_dir):
    """The first spellings that a lookup tries, and the one without the article."""
    v = surface_variants(F.concat(F.lit("THE "), "p_name"))
    return load(spark, sf_dir, "part").select("p_partkey", v[0].alias("first"), v[1].alias("second"), F.filter(v, lambda x: x == F.col("p_name"))[0].alias("bare"))
