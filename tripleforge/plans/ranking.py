"""Queries on scores of candidates and predicates, search over several bases, closures, and caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripleforge.functions import similarity
from tripleforge.operators import graph, ranking, vectors
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


def _lexical(a: str, b: str) -> str:
    """SQL of the lexical similarity of two lower-cased texts."""
    ratio = f"(least(length({a}), length({b})) / greatest(length({a}), length({b})))"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN (contains({a}, {b}) OR contains({b}, {a})) AND {ratio} >= 0.7 THEN 0.9 WHEN (contains({a}, {b}) OR contains({b}, {a})) AND {ratio} >= 0.4 THEN 0.7 ELSE 0.5 END"


_CANDIDATES_SQL = f"""c AS (SELECT *, split_part(p_name, ' ', 2) AS mention, (p_type = 'ECONOMY')::INT + (p_size % 2 = 0)::INT * (1 + (lower(p_type) = split_part(p_name, ' ', 1))::INT) AS said, CASE p_partkey % 4 WHEN 0 THEN 0.10 WHEN 1 THEN 0.0 WHEN 2 THEN 0.60 ELSE 0.25 END AS penalty FROM part),
s AS (SELECT *, round(0.5 * p_size / 50 + 0.5 * {_lexical('mention', 'p_name')} + CASE WHEN said > 0 THEN 0.12 * said ELSE -0.10 END - penalty, 6) AS score FROM c)"""


def _candidates(spark, sf_dir):
    words, kind = F.split("p_name", " "), F.col("p_partkey") % 4
    rows = load(spark, sf_dir, "part").withColumn("mention", words[1])
    label = F.concat("p_name", F.lit(" (the "), F.lower("p_type"), F.lit(" "), words[0], F.lit(")"))
    sentence = F.array(F.lit("economy"), F.when(F.col("p_size") % 2 == 0, words[0]).otherwise("other"))
    types = F.when(kind == 0, F.array(F.lit("Unknown"))).when(kind == 1, F.array(F.lit("Thing"), F.lit("HistoricBuilding"))).when(kind == 2, F.array(F.lit("SoccerClub"))).otherwise(F.array(F.lit("Company")))
    score = ranking.candidate_score(F.col("p_size") / 50, F.col("mention"), label, sentence, types, F.array(F.lit("Building"), F.lit("Place")))
    return rows.select("p_partkey", "mention", F.round(score, 6).alias("score"))


@query("candidate_scores", f"WITH {_CANDIDATES_SQL} SELECT p_partkey, mention, score::DOUBLE AS score FROM s")
def candidate_scores(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query("top_candidates", f"WITH {_CANDIDATES_SQL} SELECT mention, p_partkey, score::DOUBLE AS score, row_number() OVER (PARTITION BY mention ORDER BY score DESC, p_partkey) AS rank FROM s QUALIFY rank <= 5")
def top_candidates(spark, sf_dir):
    """Candidates by score, in input order where scores are equal; the five best are kept."""
    order = Window.partitionBy("mention").orderBy(F.desc("score"), "p_partkey")
    return _candidates(spark, sf_dir).withColumn("rank", F.row_number().over(order).cast("long")).filter("rank <= 5")


@query("predicate_ranking", f"""WITH a AS (SELECT DISTINCT p_type AS domain, p_brand AS pid FROM part), m AS (SELECT p_partkey, p_type AS domain, p_size, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand || '9x' END AS raw FROM part),
s AS (SELECT p_partkey, pid, round(0.5 * ((p_size * 7 + length(pid) * 13) % 100) / 100 + 0.5 * {_lexical('lower(raw)', 'lower(pid)')} + CASE WHEN lower(raw) = lower(pid) THEN 1 ELSE 0 END, 6)::DOUBLE AS score FROM m JOIN a USING (domain))
SELECT p_partkey, pid, score FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, pid) = 1""")
def predicate_ranking(spark, sf_dir):
    """Every raw predicate against the allowed ones of its domain; the best one, the first of equal ones."""
    part = load(spark, sf_dir, "part")
    allowed = part.select(F.col("p_type").alias("domain"), F.col("p_brand").alias("pid")).distinct()
    raw = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.concat("p_brand", F.lit("9x")))
    pairs = part.select("p_partkey", F.col("p_type").alias("domain"), "p_size", raw.alias("raw")).join(allowed, "domain")
    vector = ((F.col("p_size") * 7 + F.length("pid") * 13) % 100) / 100
    scored = pairs.select("p_partkey", "pid", F.round(ranking.predicate_score(F.col("raw"), F.col("pid"), vector), 6).alias("score"))
    return ranking.best(scored, ["p_partkey"], "score", ["pid"])


_PREDICATES = [("birthPlace", "the place in which a person was born and is of", "Person", "Place"), ("founder", "the person that founded the company or organization", "Organization", "Person"), ("location", "the city or the country where a thing is in", "", "Place"), ("related", "a thing that is related to the other thing", "", "")]
_FUSION_SQL = f"""pr AS (SELECT * FROM (VALUES {', '.join(str(p) for p in _PREDICATES)}) t(pid, description, domain, "range")),
ev AS (SELECT item_id AS id, text, CASE item_id % 3 WHEN 0 THEN 'Person' WHEN 1 THEN 'Organization' ELSE 'Thing' END AS st, CASE item_id % 2 WHEN 0 THEN 'Place' ELSE 'Person' END AS ot, CASE item_id % 3 WHEN 0 THEN 'the inventor' WHEN 1 THEN 'Apple Inc' ELSE 'Item of ' || item_id END || ' ' || CASE item_id % 2 WHEN 0 THEN 'in Germany' ELSE 'a scientist' END AS names FROM benchmark),
dt AS (SELECT pid, unnest(regexp_extract_all(lower(description), '\\w\\w+')) AS token FROM pr), idf AS (SELECT token, ln((1 + (SELECT count(*) FROM pr)) / (1 + count(DISTINCT pid))) + 1 AS idf FROM dt GROUP BY 1),
dw AS (SELECT pid, token, count(*) * any_value(idf) AS w FROM dt JOIN idf USING (token) GROUP BY 1, 2), tw AS (SELECT id, token, count(*) * any_value(idf) AS w FROM (SELECT id, unnest(regexp_extract_all(lower(text), '\\w\\w+')) AS token FROM ev) JOIN idf USING (token) GROUP BY 1, 2),
nw AS (SELECT id, token, count(*) * any_value(idf) AS w FROM (SELECT id, unnest(regexp_extract_all(lower(names), '\\w\\w+')) AS token FROM ev) JOIN idf USING (token) GROUP BY 1, 2),
dn AS (SELECT pid, sqrt(sum(w * w)) AS n FROM dw GROUP BY 1), tn AS (SELECT id, sqrt(sum(w * w)) AS n FROM tw GROUP BY 1), nn AS (SELECT id, sqrt(sum(w * w)) AS n FROM nw GROUP BY 1),
pd AS (SELECT id, pid, sum(tw.w * dw.w) AS d FROM tw JOIN dw USING (token) GROUP BY 1, 2), xd AS (SELECT id, sum(tw.w * nw.w) AS d FROM tw JOIN nw USING (id, token) GROUP BY 1),
f AS (SELECT ev.id, pr.pid, CASE WHEN (domain = '' OR domain = st) AND ("range" = '' OR "range" = ot) THEN 1.0 ELSE 0.0 END AS type_compat, coalesce(pd.d / (tn.n * dn.n), 0) AS pred_sim,
  len(list_intersect(list_distinct(string_split(description, ' ')), regexp_split_to_array(lower(text), '\\s+'))) / len(list_distinct(string_split(description, ' '))) AS overlap, coalesce(xd.d / (tn.n * nn.n), 0) AS desc_sim
  FROM ev JOIN pr ON true LEFT JOIN pd ON pd.id = ev.id AND pd.pid = pr.pid LEFT JOIN tn ON tn.id = ev.id LEFT JOIN dn ON dn.pid = pr.pid LEFT JOIN nn ON nn.id = ev.id LEFT JOIN xd ON xd.id = ev.id),
g AS (SELECT id, pid, type_compat::DOUBLE AS type_compat, round(pred_sim, 6) AS pred_sim, round(overlap, 6) AS overlap, round(desc_sim, 6) AS desc_sim, round(0.4 * type_compat + 0.3 * pred_sim + 0.2 * overlap + 0.1 * desc_sim, 6)::DOUBLE AS score FROM f)"""


def _fused(spark, sf_dir):
    kind, other = F.col("item_id") % 3, F.col("item_id") % 2
    subject = F.when(kind == 0, "http://kg.example.org/the_inventor").when(kind == 1, "http://kg.example.org/Apple_Inc").otherwise(F.concat(F.lit("http://kg.example.org/Item_of_"), F.col("item_id").cast("string")))
    evidence = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", subject.alias("s"), F.when(other == 0, "http://kg.example.org/in_Germany").otherwise("http://kg.example.org/a_scientist").alias("o"))
    predicates = spark.createDataFrame(_PREDICATES, "pid string, description string, domain string, range string")
    pairs = evidence.select("id", F.explode(F.array(*[F.lit(p[0]) for p in _PREDICATES])).alias("pid"))
    scores = ranking.fusion_scores(evidence, predicates, pairs)
    return scores.select("id", "pid", "type_compat", *[F.round(c, 6).alias(c) for c in ("pred_sim", "overlap", "desc_sim", "score")])


@query("fusion_scores", f"WITH {_FUSION_SQL} SELECT * FROM g")
def fusion_scores(spark, sf_dir):
    """Each benchmark item against four candidate predicates."""
    return _fused(spark, sf_dir)


@query("fused_choice", f"WITH {_FUSION_SQL} SELECT id, pid, score FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pid) = 1")
def fused_choice(spark, sf_dir):
    return ranking.best(_fused(spark, sf_dir), ["id"], "score", ["pid"]).select("id", "pid", "score")


@query("entity_kinds", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Person' WHEN 1 THEN 'Place' WHEN 2 THEN 'Organization' ELSE 'Thing' END AS kind, p_partkey % 4 <> 3 AND p_partkey % 4 <> 2 AS fits FROM part")
def entity_kinds(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    uri = F.concat(F.lit("http://kg.example.org/resource/"), F.when(kind == 0, "Mad_Scientist_").when(kind == 1, "Capital_City_").when(kind == 2, "Big_Corporation_").otherwise("Ring_"), F.col("p_partkey").cast("string"))
    constraint = F.when(kind == 0, "").when(kind == 1, "PopulatedPlace").otherwise("Person")
    found = ranking.entity_type(uri)
    return load(spark, sf_dir, "part").select("p_partkey", found.alias("kind"), ranking.type_matches(found, constraint).alias("fits"))


@query("context_scores", """SELECT p_partkey, round(least(0.5 + CASE p_partkey % 4 WHEN 0 THEN 0.4 WHEN 1 THEN 0.2 WHEN 2 THEN 0.0 ELSE 0.4 END + 0.1 + 0.15 * (p_size % 2) + CASE WHEN p_partkey % 4 < 2 AND p_size % 3 = 0 THEN 0.2 ELSE 0 END + 0.2 * coalesce(CASE WHEN p_size > 10 THEN 0.1 END, 0.5), 1.0), 6)::DOUBLE AS score FROM part""")
def context_scores(spark, sf_dir):
    kind, word = F.col("p_partkey") % 4, F.split("p_name", " ")[1]
    type_uri = F.when(kind == 0, "http://x/Company").when(kind == 1, "http://x/Brand").when(kind == 2, "http://x/Company").otherwise("http://x/CityDistrict")
    expected = F.when(kind < 2, "company").when(kind == 2, "person").otherwise("place")
    abstract = F.concat(F.when(F.col("p_size") % 2 == 1, F.upper(word)).otherwise("-"), F.when(F.col("p_size") % 3 == 0, " its Hardware ").otherwise(" "))
    score = ranking.context_score(F.concat(F.lit("http://x/"), word), type_uri, abstract, expected, F.array(word), F.when(F.col("p_size") > 10, 0.1))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query("multi_base_search", """WITH k AS (SELECT p_name AS mention, p_partkey AS uri, p_partkey % 3 AS base, p_retailprice AS score FROM part), t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY mention, base ORDER BY score DESC, uri) <= 3)
SELECT mention, uri, base, score, row_number() OVER (PARTITION BY mention ORDER BY score DESC, base, uri) AS rank FROM t QUALIFY rank <= 3""")
def multi_base_search(spark, sf_dir):
    """The three best of each base put together, then the three best of all."""
    part = load(spark, sf_dir, "part").select(F.col("p_name").alias("mention"), F.col("p_partkey").alias("uri"), (F.col("p_partkey") % 3).alias("base"), F.col("p_retailprice").alias("score"))
    bases = [part.filter(F.col("base") == b) for b in range(3)]
    own = Window.partitionBy("mention").orderBy(F.desc("score"), "uri")
    found = None
    for base in bases:
        best = base.withColumn("k", F.row_number().over(own)).filter("k <= 3").drop("k")
        found = best if found is None else found.unionByName(best)
    over_all = Window.partitionBy("mention").orderBy(F.desc("score"), "base", "uri")
    return found.withColumn("rank", F.row_number().over(over_all).cast("long")).filter("rank <= 3")


_TOP_SQL = """SELECT c.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(c.e, d.embedding::DOUBLE[]), 6) AS sim, row_number() OVER (PARTITION BY c.vec_id ORDER BY round(list_cosine_similarity(c.e, d.embedding::DOUBLE[]), 6) DESC, d.vec_id) AS rank
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0) c JOIN embeddings d ON c.vec_id <> d.vec_id QUALIFY rank <= 5"""


def _nearest(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.top_k(rows, rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)


@query("vector_top_k", _TOP_SQL)
def vector_top_k(spark, sf_dir):
    """Every row whose id is divisible by 50 against all rows."""
    return _nearest(spark, sf_dir)


@query("similar_properties", f"WITH t AS ({_TOP_SQL}) SELECT query_id, min_by('thing_' || vec_id, rank) AS uri, min(rank) AS rank FROM t WHERE vec_id % 3 <> 0 GROUP BY query_id")
def similar_properties(spark, sf_dir):
    """Of the five most similar labels, the URIs that the terminology has for them; the first whose name begins with a small letter."""
    rows = load(spark, sf_dir, "embeddings")
    uri = F.concat(F.when(F.col("vec_id") % 3 == 0, "http://x/Thing_").otherwise("http://x/thing_"), F.col("vec_id").cast("string"))
    terms = rows.select("vec_id", uri.alias("uri"))
    named = _nearest(spark, sf_dir).join(terms, "vec_id").withColumn("name", F.element_at(F.split("uri", "/"), -1)).filter(F.col("name").rlike("^[a-z]"))
    return named.groupBy("query_id").agg(F.min_by("name", "rank").alias("uri"), F.min("rank").alias("rank"))


@query("best_retries", "SELECT l_orderkey AS id, min_by(l_partkey, k) AS kept, max(l_quantity) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, max(l_quantity) OVER (PARTITION BY l_orderkey) AS best FROM lineitem) WHERE l_quantity = best GROUP BY 1")
def best_retries(spark, sf_dir):
    """Retries in order: a later one replaces the kept one only with a strictly larger score."""
    order = F.struct(F.col("l_quantity"), F.struct(-F.col("l_linenumber"), -F.col("l_partkey"), -F.col("l_suppkey")))
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max_by("l_partkey", order).alias("kept"), F.max("l_quantity").alias("score"))


@query("topology_pairs", """WITH s AS (SELECT l_orderkey AS id, l_partkey AS sub, l_suppkey AS obj, l_quantity / 50 AS a, l_discount * 10 AS b FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_linenumber) <= 5),
p AS (SELECT x.id, x.sub, y.obj, (x.a + y.b) / 2 + 0.15 * (1 - abs(x.a - y.b)) AS base, x.sub = y.sub AND x.obj = y.obj AS linked FROM s x JOIN s y ON x.id = y.id),
m AS (SELECT id, sub, obj, round(base + CASE WHEN base >= 0.35 AND linked THEN 0.20 ELSE 0 END, 6) AS score FROM p), d AS (SELECT id, sub, obj, max(score) AS score FROM m GROUP BY ALL)
SELECT id, sub, obj, score::DOUBLE AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, sub, obj) AS rank FROM d QUALIFY rank <= 5""")
def topology_pairs(spark, sf_dir):
    """Five candidates a side of a sentence; a pair's score is the mean and .15 of the joint similarity, and .20 more for linked pairs that have .35."""
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_partkey", "l_suppkey", "l_linenumber")
    five = load(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(order)).filter("k <= 5")
    x = five.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("sub"), F.col("l_suppkey").alias("x_obj"), (F.col("l_quantity") / 50).alias("a"))
    y = five.select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("obj"), F.col("l_partkey").alias("y_sub"), (F.col("l_discount") * 10).alias("b"))
    a, b = F.col("a"), F.col("b")
    pairs = x.join(y, "id").withColumn("base", (a + b) / 2 + 0.15 * (1 - F.abs(a - b)))
    linked = (F.col("sub") == F.col("y_sub")) & (F.col("obj") == F.col("x_obj"))
    scored = pairs.select("id", "sub", "obj", F.round(F.col("base") + F.when((F.col("base") >= 0.35) & linked, 0.20).otherwise(0.0), 6).alias("score"))
    best = scored.groupBy("id", "sub", "obj").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "sub", "obj")).cast("long")).filter("rank <= 5")


@query("compound_names", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size > 10 THEN 'Canonical_' || p_partkey ELSE replace(p_name, ' ', ',_') END AS name FROM part")
def compound_names(spark, sf_dir):
    part = load(spark, sf_dir, "part").withColumn("name", F.replace("p_name", F.lit(" "), F.lit(",_")))
    redirects = part.filter("p_size > 10").select(F.col("p_partkey").alias("key"), F.concat(F.lit("Canonical_"), F.col("p_partkey").cast("string")).alias("target"))
    mention = F.when(F.col("p_partkey") % 3 == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit(",  ")))).otherwise(F.col("p_name"))
    return part.join(redirects, F.col("p_partkey") == F.col("key"), "left").select("p_partkey", ranking.canonical_compound(F.col("name"), mention, F.col("target")).alias("name"))


@query("alias_remap", "SELECT p_partkey, CASE lower(p_type) WHEN 'economy' THEN 'club' WHEN 'small' THEN 'team' ELSE p_type END AS pid FROM part")
def alias_remap(spark, sf_dir):
    """Predicates by an alias table with lower-case keys; what isn't in it stays."""
    aliases = spark.createDataFrame([("economy", "club"), ("small", "team"), ("none", "x")], "key string, target string")
    return load(spark, sf_dir, "part").join(aliases, F.lower("p_type") == F.col("key"), "left").select("p_partkey", F.coalesce("target", "p_type").alias("pid"))


@query("token_set_matches", "SELECT p_partkey, len(list_intersect(string_split(lower(p_name), ' '), string_split(lower(p_type || ' ' || CASE WHEN p_size > 25 THEN split_part(p_name, ' ', 1) ELSE 'none' END), ' '))) > 0 AS matches FROM part")
def token_set_matches(spark, sf_dir):
    """Whether two names have a word in common: what a partial token set ratio of 100 says."""
    words = lambda c: F.split(F.lower(c), " ")
    other = F.concat("p_type", F.lit(" "), F.when(F.col("p_size") > 25, F.split("p_name", " ")[0]).otherwise("none"))
    return load(spark, sf_dir, "part").select("p_partkey", F.arrays_overlap(words(F.col("p_name")), words(other)).alias("matches"))


@query("entailment_scores", "SELECT vec_id, round(exp(embedding[3]::DOUBLE) - exp(embedding[1]::DOUBLE), 6) AS score FROM embeddings")
def entailment_scores(spark, sf_dir):
    e = lambda k: F.exp(F.col("embedding")[k].cast("double"))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(e(2) - e(0), 6).alias("score"))


@query("context_embeddings", "SELECT a.vec_id, round(list_cosine_similarity(list_transform(range(1, len(a.embedding) + 1), lambda i: 0.8 * a.embedding[i]::DOUBLE + 0.2 * b.embedding[i]::DOUBLE), a.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def context_embeddings(spark, sf_dir):
    """A mention's vector with a fifth of its sentence's (the next row's), against the mention's own."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    sentence = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    mixed = F.zip_with("embedding", "other", lambda a, b: 0.8 * a.cast("double") + 0.2 * b.cast("double"))
    return rows.join(sentence, "vec_id").select("vec_id", F.round(similarity.cosine(mixed, F.col("embedding")), 6).alias("sim"))


_LINKS_SQL = "e AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS a, l_suppkey % 7 AS b FROM lineitem WHERE l_quantity >= 25 AND l_linenumber <> l_suppkey % 7)"


def _links(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").filter("l_quantity >= 25").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("a"), (F.col("l_suppkey") % 7).cast("long").alias("b")).filter("a <> b").distinct()


@query("cluster_representatives", f"""WITH RECURSIVE {_LINKS_SQL}, c AS (SELECT doc, a, b FROM e UNION SELECT c.doc, c.a, e.b FROM c JOIN e ON e.doc = c.doc AND e.a = c.b),
n AS (SELECT doc, a AS node FROM e UNION SELECT doc, b FROM e), d AS (SELECT n.doc, n.node, count(c.a) AS degree FROM n LEFT JOIN c ON c.doc = n.doc AND c.b = n.node GROUP BY 1, 2)
SELECT doc, node::BIGINT AS node, degree FROM d QUALIFY row_number() OVER (PARTITION BY doc ORDER BY degree DESC, node) <= 2""")
def cluster_representatives(spark, sf_dir):
    """In each cluster, the two words that most others entail, over the transitive closure of the entailments that are strong enough."""
    ensure(spark)
    links = _links(spark, sf_dir)
    closed = graph.transitive_closure(links)
    nodes = links.select("doc", F.col("a").alias("node")).union(links.select("doc", "b")).distinct()
    degree = closed.groupBy("doc", F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    rows = nodes.join(degree, ["doc", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("degree"), "node"))).filter("k <= 2").drop("k")


@query("coref_clusters", f"""WITH RECURSIVE {_LINKS_SQL}, u AS (SELECT doc, a, b FROM e UNION SELECT doc, b, a FROM e), c AS (SELECT doc, a, a AS b FROM u UNION SELECT c.doc, c.a, u.b FROM c JOIN u ON u.doc = c.doc AND u.a = c.b)
SELECT doc, a::BIGINT AS node, min(b)::BIGINT AS cluster FROM c GROUP BY 1, 2""")
def coref_clusters(spark, sf_dir):
    ensure(spark)
    return graph.components(_links(spark, sf_dir))


@query("cached_answers", "SELECT event_type AS key, max_by(event_id, (ts, event_id)) AS answer FROM events, (SELECT max(ts) AS now FROM events) WHERE ts + INTERVAL 7 DAYS > now GROUP BY 1")
def cached_answers(spark, sf_dir):
    """Answers that were cached in the last seven days, the newest of each key."""
    from tripleforge.streaming.streams import live

    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "event_id", "ts", (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    now = rows.agg(F.max("ts").alias("now"))
    return live(rows, now).groupBy("key").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("answer"))


@query("review_by_score", "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END, 0) DESC, o_orderkey))::BIGINT AS place FROM orders")
def review_by_score(spark, sf_dir):
    """A reviewer's queue by falling score; a missing score counts as 0, equal ones stay in order."""
    score = F.coalesce(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")), F.lit(0))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc(score), "o_orderkey")).cast("long").alias("place"))


@query("numeric_ids", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1")
def numeric_ids(spark, sf_dir):
    """Sentence ids that are texts, in the order of their numbers."""
    rows = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("id"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("id").cast("long").alias("n"), "id")))
    return rows.groupBy("o_custkey").agg(F.array_join(F.transform(ordered, lambda x: x["id"]), ",").alias("ids"))


@query("qualified_pool", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'q' || p_partkey || ',' ELSE '' END || 'a,b' AS pool FROM part")
def qualified_pool(spark, sf_dir):
    """Candidates of a context-qualified title go before the pool, unless they are in it already."""
    pool = F.array(F.lit("a"), F.lit("b"))
    qualified = F.array(F.lit("b"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("q"), F.col("p_partkey").cast("string"))).otherwise("a"))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(F.concat(F.array_except(qualified, pool), pool), ",").alias("pool"))


@query("relation_families", """WITH t AS (SELECT l_orderkey AS id, l_returnflag AS r, l_suppkey AS h, l_partkey % 40 AS t, l_quantity > 20 AS g, l_discount > 0.03 AS p FROM lineitem),
f AS (SELECT 'triples' AS family, id || '|' || h || '|' || r || '|' || t AS key, g, p FROM t UNION ALL SELECT 'pairs', id || '|' || h || '|' || t, g, p FROM t UNION ALL SELECT 'heads', id || '|' || h || '|' || r, g, p FROM t UNION ALL SELECT 'tails', id || '|' || r || '|' || t, g, p FROM t),
k AS (SELECT family, key, bool_or(g) AS g, bool_or(p) AS p FROM f GROUP BY 1, 2) SELECT family, count(*) FILTER (p) AS p, count(*) FILTER (g) AS g, count(*) FILTER (g AND p) AS c FROM k GROUP BY family""")
def relation_families(spark, sf_dir):
    """Predicted, gold and common items of a joint extractor by family: triples, pairs, head with relation, relation with tail."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("r"), F.col("l_suppkey").alias("h"), (F.col("l_partkey") % 40).alias("t"), (F.col("l_quantity") > 20).alias("g"), (F.col("l_discount") > 0.03).alias("p"))
    key = lambda *c: F.struct(*[F.col(x).cast("string").alias(f"k{i}") for i, x in enumerate(c)] + [F.lit("").alias(f"k{i}") for i in range(len(c), 4)])
    families = F.array(*[F.struct(F.lit(name).alias("family"), key("id", *c).alias("key")) for name, c in (("triples", "hrt"), ("pairs", "ht"), ("heads", "hr"), ("tails", "rt"))])
    each = rows.select("g", "p", F.inline(families)).groupBy("family", "key").agg(F.bool_or("g").alias("g"), F.bool_or("p").alias("p"))
    return each.groupBy("family").agg(F.count_if("p").alias("p"), F.count_if("g").alias("g"), F.count_if(F.col("g") & F.col("p")).alias("c"))


@query("clean_extractions", r"SELECT DISTINCT l_orderkey AS id, regexp_replace(regexp_replace('Order ' || l_orderkey || chr(9) || 'has ' || l_returnflag || chr(9) || 'a b', ' +', ' ', 'g'), '[,.!।]', '', 'g') AS line FROM lineitem")
def clean_extractions(spark, sf_dir):
    """Slots joined by tabs, runs of spaces collapsed, punctuation deleted, equal ones of a sentence kept once."""
    line = F.concat_ws("\t", F.concat(F.lit("Order,  "), F.col("l_orderkey").cast("string")), F.concat(F.lit("has   "), "l_returnflag", F.lit("!")), F.when(F.col("l_quantity") > 25, "a b।").otherwise("a.  b"))
    clean = F.regexp_replace(F.regexp_replace(line, " +", " "), r"[!-/:-@\[-`{-~।]", "")
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), clean.alias("line")).distinct()


@query("attached_extractions", "SELECT conv_id, turn, min(item_id) AS item_id FROM conversations LEFT JOIN benchmark ON contains(conversations.text, benchmark.text) AND conversations.text = benchmark.text GROUP BY 1, 2")
def attached_extractions(spark, sf_dir):
    """The first benchmark row with exactly the sentence's text."""
    first = load(spark, sf_dir, "benchmark").groupBy("text").agg(F.min("item_id").alias("item_id"))
    rows = load(spark, sf_dir, "conversations").join(first, "text", "left")
    return rows.groupBy("conv_id", "turn").agg(F.min("item_id").alias("item_id"))
