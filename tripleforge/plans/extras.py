"""Queries on small filters, value routing, sentence splitting, title links, splits that cover, and report lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleforge.functions import literals, text
from tripleforge.operators import index
from tripleforge.operators.ranks import global_rank
from tripleforge.plans.checkpoints import ensure

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


@query("kept_groups", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'signup')")
def kept_groups(spark, sf_dir):
    """Mentions of groups that can be linked: dates, numbers and the like are left out."""
    return load(spark, sf_dir, "events").filter(~F.col("event_type").isin("error", "signup")).select("event_id", "event_type")


@query("long_snippets", r"SELECT doc_id, length(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 900)) AS n FROM documents WHERE source IS NOT NULL AND length(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 900)) >= 140")
def long_snippets(spark, sf_dir):
    """Items with a title whose snippet has 140 characters at least."""
    rows = load(spark, sf_dir, "documents").filter("source IS NOT NULL").select("doc_id", F.length(text.clean_snippet(F.col("text"))).cast("long").alias("n"))
    return rows.filter("n >= 140")


@query("kept_links", "SELECT p_partkey, 'http://w/wiki/' || replace(p_name, ' ', '_') AS link FROM part WHERE p_partkey % 3 = 2")
def kept_links(spark, sf_dir):
    kind = F.col("p_partkey") % 3
    link = F.concat(F.lit("http://w/wiki"), F.when(kind == 0, "/File:").when(kind == 1, "/Category:").otherwise("/"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return load(spark, sf_dir, "part").select("p_partkey", link.alias("link")).filter(~F.col("link").contains("/File:") & ~F.col("link").contains("/Category:"))


@query("thresholded_predicates", "SELECT p_name, CASE WHEN max(p_size) >= 35 THEN min_by(p_brand, (-p_size, p_brand)) END AS predicate, CASE WHEN max(p_size) < 35 THEN 'no candidate above 0.7' END AS reason FROM part GROUP BY 1")
def thresholded_predicates(spark, sf_dir):
    """The best candidate from a similarity of .7 on, else none and the reason."""
    best = load(spark, sf_dir, "part").groupBy("p_name").agg(F.min(F.struct((-F.col("p_size") / 50).alias("far"), F.col("p_brand").alias("pid"))).alias("x"))
    fits = -F.col("x.far") >= 0.7
    return best.select("p_name", F.when(fits, F.col("x.pid")).alias("predicate"), F.when(~fits, "no candidate above 0.7").alias("reason"))


@query("routed_values", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '1955-01-01' WHEN 1 THEN '30955' WHEN 2 THEN '1999-03-03' WHEN 3 THEN p_size::VARCHAR WHEN 4 THEN '2010-02-14' END AS value FROM part""")
def routed_values(spark, sf_dir):
    """Objects that no entity stands for: years, sums of money, dates and numbers are values; a name stays a name (null)."""
    kind = F.col("p_partkey") % 6
    raw = F.when(kind == 0, '"1955"').when(kind == 1, "$30,955").when(kind == 2, "March 3rd, 1999").when(kind == 3, F.concat(F.col("p_size").cast("string"), F.lit(" km"))).when(kind == 4, "14-02-2010").otherwise("Faversham, Kent")
    pid = F.when(kind == 0, "birthYear").otherwise("x")
    return load(spark, sf_dir, "part").select("p_partkey", literals.routed(raw, pid)["value"].alias("value"))


@query("split_sentences", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+$'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS s FROM documents) SELECT doc_id, len(s) AS n, s[1] AS first FROM s""")
def split_sentences(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).alias("first"))


@query("followed_redirects", """WITH RECURSIVE r AS (SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_partkey % 16 <> 15), w AS (SELECT src, dst, 1 AS hops FROM r UNION ALL SELECT w.src, r.dst, hops + 1 FROM w JOIN r ON w.dst = r.src) SELECT src, max_by(dst, hops) AS dst FROM w GROUP BY src""")
def followed_redirects(spark, sf_dir):
    """Redirects to their very end; a cycle is an error."""
    ensure(spark)
    part = F.col("p_partkey")
    return index.follow_all(load(spark, sf_dir, "part").filter(part % 16 != 15).select(part.alias("src"), (part + 1).alias("dst")))


@query("canonical_mentions", "SELECT s_suppkey, n_name AS canonical, 'uri_' || r_regionkey AS uri FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 2 = 0 LEFT JOIN region ON n_regionkey = r_regionkey")
def canonical_mentions(spark, sf_dir):
    """Mentions with their canonical names and these names' URIs, null where there is none."""
    names = load(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0")
    uris = load(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("uri_"), F.col("r_regionkey").cast("string")).alias("uri"))
    rows = load(spark, sf_dir, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(uris, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select("s_suppkey", F.col("n_name").alias("canonical"), "uri")


@query("shared_links", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'a_' || p_partkey || ',é' ELSE 'é' END AS links FROM part")
def shared_links(spark, sf_dir):
    """Hyperlinks of a page that the base links too: one holds the other, or they agree when decoded."""
    key = F.col("p_partkey").cast("string")
    page, base = F.array(F.concat(F.lit("a_"), key), F.lit("é"), F.lit("zzz")), F.array(F.concat(F.lit("http://x/"), F.when(F.col("p_size") > 25, "a_").otherwise("b_"), key), F.lit("http://x/%C3%A9"))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(text.shared_links(page, base), ",").alias("links"))


@query("gold_sentence_ids", "SELECT p_partkey AS id FROM part WHERE p_partkey % 3 <> 0")
def gold_sentence_ids(spark, sf_dir):
    """Ids of the header lines of a gold file."""
    line = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("sent_id:"), F.col("p_partkey").cast("string"), F.lit("\t"), "p_name")).otherwise(F.concat(F.lit("cluster 1 "), "p_name"))
    return load(spark, sf_dir, "part").select(F.regexp_extract(line, r"^sent_id:\s*(\d+)", 1).alias("id")).filter("id <> ''").select(F.col("id").cast("long").alias("id"))


@query("relation_synonyms", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'cheap,thrift' WHEN 'SMALL' THEN 'little' ELSE lower(p_type) END AS words FROM part")
def relation_synonyms(spark, sf_dir):
    """Two synonyms at most, in lower case, each once; a relation without any stands for itself."""
    known = spark.createDataFrame([("economy", ["Cheap", "cheap", "thrift", "saving"]), ("small", ["LITTLE"])], "key string, words array<string>")
    found = F.slice(F.array_distinct(F.transform("words", F.lower)), 1, 2)
    rows = load(spark, sf_dir, "part").join(known, F.lower("p_type") == F.col("key"), "left")
    return rows.select("p_partkey", F.array_join(F.coalesce(found, F.array(F.lower("p_type"))), ",").alias("words"))


@query("known_predicates", "SELECT o_orderkey, c_name AS label, c_mktsegment AS comment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 2 = 0")
def known_predicates(spark, sf_dir):
    """Suggested predicates that the ontology has, with their label and comment."""
    ontology = load(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("comment"))
    return load(spark, sf_dir, "orders").join(ontology, "o_custkey").select("o_orderkey", "label", "comment")


@query("english_titles", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN CASE WHEN p_size > 25 THEN 'Title_' || p_partkey END END AS title FROM part")
def english_titles(spark, sf_dir):
    """English titles only need underscores; others go through the item of their site link to its English one, null where a link is missing."""
    kind, key = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    part = load(spark, sf_dir, "part").withColumns({"lang": F.when(kind == 0, "en").when(kind == 1, "de").otherwise("xx"), "title": F.when(kind == 0, F.col("p_name")).otherwise(F.concat(F.lit("Titel "), key))})
    links = part.filter("lang = 'de'").select(F.lit("de").alias("lang"), "title", F.concat(F.lit("Q"), key).alias("qid"))
    links = links.unionByName(part.filter("lang = 'de' AND p_size > 25").select(F.lit("en").alias("lang"), F.concat(F.lit("Title "), key).alias("title"), F.concat(F.lit("Q"), key).alias("qid")))
    return index.english_titles(part.select("p_partkey", "lang", "title"), links).select("p_partkey", F.col("en_title").alias("title"))


@query("first_predictions", "SELECT l_orderkey AS id, l_returnflag AS rel, l_partkey AS obj FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) = 1")
def first_predictions(spark, sf_dir):
    """Only the first triple that a baseline gives for a sentence."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(order).alias("x"))
    return rows.select("id", F.col("x.l_returnflag").alias("rel"), F.col("x.l_partkey").alias("obj"))


def _drawn(seed: str, key: str):
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


@query("strategy_mix", "SELECT c_custkey, CASE WHEN k % 10 < 5 THEN 'single' WHEN k % 10 < 8 THEN 'pair' ELSE 'free' END AS strategy, k // 10 % 7 AS relation FROM (SELECT c_custkey, ('0x' || substr(md5('15|' || c_custkey), 1, 8))::BIGINT AS k FROM customer)")
def strategy_mix(spark, sf_dir):
    """Half, three tenths and two tenths of the rows by strategy, relations dealt evenly, both by a seeded hash."""
    k = _drawn("15", "c_custkey")
    return load(spark, sf_dir, "customer").select("c_custkey", F.when(k % 10 < 5, "single").when(k % 10 < 8, "pair").otherwise("free").alias("strategy"), F.floor(k / 10).cast("long").alias("k")).select("c_custkey", "strategy", (F.col("k") % 7).alias("relation"))


@query("covering_split", """WITH e AS (SELECT o_orderkey AS a, o_custkey % 50 AS b, ('0x' || substr(md5('42|' || o_orderkey), 1, 8))::BIGINT AS k FROM orders), f AS (SELECT b, min((k, a)) AS first FROM e GROUP BY 1)
SELECT a, e.b, CASE WHEN (k, a) = first THEN 'train' WHEN k % 10 < 8 THEN 'train' WHEN k % 10 < 9 THEN 'valid' ELSE 'test' END AS part FROM e JOIN f USING (b)""")
def covering_split(spark, sf_dir):
    """80/10/10 by a seeded hash, and in the training part an edge of every entity: the one with the smallest hash."""
    edges = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_custkey") % 50).alias("b"), _drawn("42", "o_orderkey").alias("k"))
    first = edges.groupBy("b").agg(F.min(F.struct("k", "a")).alias("first"))
    part = F.when((F.struct("k", "a") == F.col("first")) | (F.col("k") % 10 < 8), "train").when(F.col("k") % 10 < 9, "valid").otherwise("test")
    return edges.join(first, "b").select("a", "b", part.alias("part"))


@query("first_seen_ids", "SELECT name, (row_number() OVER (ORDER BY first) - 1)::BIGINT AS id FROM (SELECT p_name AS name, min(p_partkey) AS first FROM part GROUP BY 1)")
def first_seen_ids(spark, sf_dir):
    """Integer ids of names in the order in which they are first seen."""
    first = load(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("first"))
    return global_rank(first, {"block": F.floor(F.col("first") / 1000)}, [F.col("first")], "id").select("name", (F.col("id") - 1).alias("id"))


@query("tab_lines", "SELECT id || chr(9) || rel || chr(9) || obj || chr(9) || k AS value FROM (SELECT l_orderkey AS id, l_returnflag AS rel, l_partkey AS obj, 0 AS k FROM lineitem WHERE l_quantity > 10 UNION ALL SELECT l_orderkey, l_linestatus, l_partkey, 1 FROM lineitem WHERE l_discount > 0.05)")
def tab_lines(spark, sf_dir):
    """Extractions, then the ones made from them, as tab lines; entries with fewer than three slots are dropped."""
    lines = load(spark, sf_dir, "lineitem")
    slots = lambda *c: F.filter(F.array(*[x.cast("string") for x in c]), lambda s: s.isNotNull())
    own = lines.select(slots(F.col("l_orderkey"), F.when(F.col("l_quantity") > 10, F.col("l_returnflag")), F.col("l_partkey")).alias("s"), F.lit("0").alias("k"))
    made = lines.select(slots(F.col("l_orderkey"), F.when(F.col("l_discount") > 0.05, F.col("l_linestatus")), F.col("l_partkey")).alias("s"), F.lit("1").alias("k"))
    return own.unionByName(made).filter(F.size("s") >= 3).select(F.concat_ws("\t", "s", "k").alias("value"))


@query("analysis_lines", "SELECT l_orderkey AS id, 'sentence ' || l_orderkey || ': tp=' || count(*) FILTER (l_returnflag = 'A') || ' fp=' || count(*) FILTER (l_returnflag = 'N') || ' fn=' || count(*) FILTER (l_returnflag = 'R') AS value FROM lineitem GROUP BY 1")
def analysis_lines(spark, sf_dir):
    """One line of a detailed report for each sentence."""
    n = lambda flag: F.count_if(F.col("l_returnflag") == flag)
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(n("A").alias("tp"), n("N").alias("fp"), n("R").alias("fn")).select("id", F.format_string("sentence %s: tp=%s fp=%s fn=%s", "id", "tp", "fp", "fn").alias("value"))


@query("listed_entities", "SELECT p_partkey, p_name || '|' || p_brand AS entities FROM part")
def listed_entities(spark, sf_dir):
    """The items of a list that was written as text behind a prefix of 28 characters."""
    written = F.concat(F.rpad(F.lit("prefix "), 28, "."), F.lit("['"), "p_name", F.lit("', \""), "p_brand", F.lit('"]'))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(text.listed(F.substring(written, 29, 1 << 20)), "|").alias("entities"))


@query("query_texts", "SELECT p_partkey, 'say  ' || p_name || '  now' AS value FROM part")
def query_texts(spark, sf_dir):
    """Quotes become blanks, so that a text can stand in a query."""
    said = F.concat(F.lit('say "'), "p_name", F.lit("' now"))
    return load(spark, sf_dir, "part").select("p_partkey", F.translate(said, "\"'", "  ").alias("value"))


@query("quoted_objects", "SELECT p_partkey FROM part WHERE p_size > 25")
def quoted_objects(spark, sf_dir):
    obj = F.when(F.col("p_size") > 25, F.concat(F.lit('"'), "p_name", F.lit('"'))).otherwise(F.col("p_name"))
    return load(spark, sf_dir, "part").filter(obj.startswith('"')).select("p_partkey")


@query("paged_terms", "SELECT n_name AS label, n_nationkey AS uri FROM nation")
def paged_terms(spark, sf_dir):
    """Pages of ten terms until an empty one, put together."""
    from tripleforge.sources.dumps import paged

    ranked = global_rank(load(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), F.col("n_nationkey").alias("uri")), {"block": F.floor(F.col("uri") / 1000)}, [F.col("uri")], "place")
    return paged(lambda offset, size: ranked.filter(F.col("place").between(offset + 1, offset + size)).drop("place"), 10)


_GOLD_SQL = """g AS (SELECT s_suppkey::VARCHAR AS sent_id, 'text of ' || s_name AS sentence, c.cluster::BIGINT AS cluster, k.kind, k.mark, CASE k.n WHEN 0 THEN s_name || ' --> has --> ' || c.cluster WHEN 1 THEN 'also ' || s_name ELSE 'maybe ' || c.cluster END AS pattern
  FROM supplier, (VALUES (1), (2)) c(cluster), (VALUES (0, 'essential', NULL), (1, 'essential', NULL), (2, 'compensatory', 'a')) k(n, kind, mark) WHERE k.n <> 1 OR c.cluster = 1)"""


def _gold_lines(spark, sf_dir):
    """The lines of a gold file for each supplier: two clusters, the first with one essential line more."""
    cluster = lambda k, more: [F.lit(f"------ Cluster {k} ------"), F.concat("s_name", F.lit(f" --> has --> {k}")), *([F.concat(F.lit(" also "), "s_name")] if more else []), F.lit("{a} " + f"maybe {k}"), F.lit("")]
    lines = F.array(F.concat(F.lit("sent_id:"), F.col("s_suppkey").cast("string"), F.lit("\ttext of "), "s_name"), *cluster(1, True), *cluster(2, False), F.lit("=" * 40))
    rows = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 3).cast("string").alias("path"), "s_suppkey", F.posexplode(lines).alias("k", "value"))
    return rows.select("path", (F.col("s_suppkey") * 100 + F.col("k")).alias("n"), "value")


@query("gold_patterns", f"WITH {_GOLD_SQL} SELECT sent_id, sentence, cluster, kind, mark, pattern FROM g")
def gold_patterns(spark, sf_dir):
    from tripleforge.sources.dumps import gold_patterns as parsed

    return parsed(_gold_lines(spark, sf_dir)).drop("path")


@query("micro_with_missing", """WITH s AS (SELECT s_suppkey % 3 AS tp, s_suppkey % 2 AS fp, 1 AS fn, s_suppkey % 4 <> 0 AS scored FROM supplier), t AS (SELECT sum(tp) FILTER (scored) AS tp, sum(fp) FILTER (scored) AS fp, sum(CASE WHEN scored THEN fn ELSE 2 END) AS fn FROM s)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM t""")
def micro_with_missing(spark, sf_dir):
    """Scores of sentences, and the essential lines of the largest cluster for those without extractions."""
    from tripleforge.operators import clusters
    from tripleforge.sources.dumps import gold_patterns as parsed

    key = F.col("s_suppkey")
    scores = load(spark, sf_dir, "supplier").filter(key % 4 != 0).select(key.cast("string").alias("sent_id"), (key % 3).cast("long").alias("tp"), (key % 2).cast("long").alias("fp"), F.lit(1).cast("long").alias("fn"))
    return clusters.micro_with_missing(scores, parsed(_gold_lines(spark, sf_dir)))
