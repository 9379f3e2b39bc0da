"""Scores and choices of candidates: entities by type and context, predicates by name, type and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleforge.functions.similarity import lexical, safe_ratio

# Words of a qualifier that say nothing, words by which a type belongs to a family, types that contradict a family, and
# words of a URI by which an entity has a type.
QUALIFIER_FILLERS = ("the", "a", "an", "of", "in")
FAMILIES = {
    "place": ("place", "building", "city", "country", "architectural", "populated", "location", "monument", "river", "mountain"),
    "person": ("person", "athlete", "artist", "politician", "scientist", "astronaut", "officeholder"),
    "work": ("work", "film", "album", "book", "song", "musical"),
}
CONTRADICTING = {
    "place": ("soccerclub", "sportsteam", "person", "athlete", "band", "musicalwork"),
    "person": ("place", "populatedplace", "building", "architecturalstructure", "country", "city", "company", "organisation"),
    "work": ("person", "place", "country", "city", "soccerclub", "sportsteam"),
}
ENTITY_TYPES = {
    "Person": ("einstein", "jobs", "person", "human", "scientist", "inventor"),
    "Place": ("ulm", "germany", "place", "city", "country", "location"),
    "Organization": ("apple", "inc", "company", "organization", "corporation"),
}
CONTEXT_TYPES = {
    "company": ("company", "corporation", "organisation", "organization"),
    "person": ("person", "human", "agent"),
    "place": ("place", "location", "city", "country", "region"),
    "product": ("product", "good", "device", "software"),
}
WORK_WORDS = ("company", "corporation", "business", "technology", "software", "hardware", "employees")


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def qualifier_bonus(label: Column, sentence_words: Column) -> Column:
    """For a label with a qualifier in parentheses: .12 for each of its words in the sentence (.36 at most) where at least half are there,
    -.10 where none is."""
    words = F.filter(F.regexp_extract_all(F.lower(F.regexp_extract(label, r"\(([^)]+)\)\s*$", 1)), F.lit(r"([\w']+)"), F.lit(1)), lambda w: ~w.isin(*QUALIFIER_FILLERS))
    said = F.size(F.filter(words, lambda w: F.array_contains(sentence_words, w)))
    share = safe_ratio(said, F.size(words))
    return F.when(F.size(words) == 0, 0.0).when(share >= 0.5, F.least(0.12 * said, F.lit(0.36))).when(said == 0, -0.10).otherwise(0.0)


def type_penalty(types: Column, expected: Column) -> Column:
    """0 where a type has an expected one in it, .10 for unknown types, .60 for types that contradict the expected family, else .25."""
    own, wanted = F.lower(F.array_join(types, " ")), F.lower(F.array_join(expected, " "))
    fits = F.exists(types, lambda t: F.exists(expected, lambda e: F.contains(F.lower(t), F.lower(e))))
    family, against = None, F.lit(False)
    for name, words in FAMILIES.items():
        family = F.when(_holds(wanted, words), name) if family is None else family.when(_holds(wanted, words), name)
    for name, words in CONTRADICTING.items():
        against = against | ((family == name) & _holds(own, words))
    unknown = (F.size(types) == 0) | F.array_contains(types, "Unknown")
    return F.when(unknown, 0.10).when(fits, 0.0).when(F.coalesce(against, F.lit(False)), 0.60).otherwise(0.25)


def candidate_score(vector: Column, mention: Column, label: Column, sentence_words: Column, types: Column, expected: Column, weights: tuple[float, float] = (0.5, 0.5)) -> Column:
    """Weighted vector and lexical similarity (without the label's qualifier), the qualifier's bonus, less the type's penalty."""
    bare = F.regexp_replace(label, r"\s*\([^)]*\)\s*$", "")
    return weights[0] * vector + weights[1] * lexical(mention, bare) + qualifier_bonus(label, sentence_words) - type_penalty(types, expected)


def predicate_score(raw: Column, pid: Column, vector: Column) -> Column:
    """Half vector, half lexical similarity, and 1 more where the raw predicate is the property's name."""
    bare = lambda c: F.lower(F.regexp_replace(c, "[ _]", ""))
    return 0.5 * vector + 0.5 * lexical(raw, F.replace(pid, F.lit("_"), F.lit(" "))) + F.when(bare(raw) == bare(pid), 1.0).otherwise(0.0)


def entity_type(uri: Column) -> Column:
    name, out = F.lower(F.element_at(F.split(uri, "/", -1), -1)), None
    for kind, words in ENTITY_TYPES.items():
        out = F.when(_holds(name, words), kind) if out is None else out.when(_holds(name, words), kind)
    return out.otherwise("Thing")


def type_matches(kind: Column, constraint: Column) -> Column:
    a, b = F.lower(kind), F.lower(F.coalesce(constraint, F.lit("")))
    return (b == "") | F.contains(b, a) | F.contains(a, b)


def context_score(uri: Column, type_uri: Column, abstract: Column, expected: Column, keywords: Column, confidence: Column) -> Column:
    """.5; .4 for the expected type (.2 for a company's product or brand); .1 for each keyword in the URI and .15 in the abstract; .2 for
    business words about a company; .2 times the confidence; 1 at most."""
    kind, text = F.lower(type_uri), F.lower(abstract)
    typed = F.lit(0.0)
    for name, words in CONTEXT_TYPES.items():
        near = F.when(_holds(kind, ("product", "brand")), 0.2).otherwise(0.0) if name == "company" else F.lit(0.0)
        typed = typed + F.when(expected == name, F.when(_holds(kind, words), 0.4).otherwise(near)).otherwise(0.0)
    said = F.aggregate(keywords, F.lit(0.0), lambda s, w: s + F.when(F.contains(F.lower(uri), F.lower(w)), 0.1).otherwise(0.0) + F.when(F.contains(text, F.lower(w)), 0.15).otherwise(0.0))
    business = F.when((expected == "company") & _holds(text, WORK_WORDS), 0.2).otherwise(0.0)
    return F.least(0.5 + typed + said + business + 0.2 * F.coalesce(confidence, F.lit(0.5)), F.lit(1.0))


def _terms(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    words = rows.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\w\w+)"), F.lit(1))).alias("token"))
    return words.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf"))


def _weights(rows: DataFrame, keys: list[str], text: str, idf: DataFrame) -> tuple[DataFrame, DataFrame]:
    weights = _terms(rows, keys, text).join(idf, "token").select(*keys, "token", (F.col("tf") * F.col("idf")).alias("w"))
    return weights, weights.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def fusion_scores(evidence: DataFrame, predicates: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, pid, type_compat, pred_sim, overlap, desc_sim, score) of candidate pairs (id, pid): .4 for types that fit the domain and range, .3
    of the cosine of tf-idf weights of evidence and description, .2 of the share of the description's words in the evidence, .1 of
    the cosine of the evidence and the two entities' names.

    Evidence has (id, text, s, o), predicates (pid, description, domain, range). The idf is ln((1 + n) / (1 + df)) + 1 over the
    descriptions; words that no description has don't count."""
    n = predicates.agg(F.count(F.lit(1)).alias("n"))
    df = _terms(predicates, ["pid"], "description").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select("token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    name = lambda c: F.replace(F.element_at(F.split(c, "/", -1), -1), F.lit("_"), F.lit(" "))
    named = evidence.select("id", F.concat_ws(" ", name(F.col("s")), name(F.col("o"))).alias("names"))
    text, text_norm = _weights(evidence, ["id"], "text", idf)
    described, described_norm = _weights(predicates, ["pid"], "description", idf)
    names, names_norm = _weights(named, ["id"], "names", idf)
    dot = pairs.join(text, "id").join(described.withColumnRenamed("w", "v"), ["pid", "token"]).groupBy("id", "pid").agg(F.sum(F.col("w") * F.col("v")).alias("pred_dot"))
    desc = text.join(names.withColumnRenamed("w", "v"), ["id", "token"]).groupBy("id").agg(F.sum(F.col("w") * F.col("v")).alias("desc_dot"))
    norm = lambda d, c: d.withColumnRenamed("norm", c)
    out = pairs.join(evidence, "id").join(predicates, "pid").join(dot, ["id", "pid"], "left").join(desc, "id", "left").join(norm(text_norm, "nt"), "id", "left").join(norm(described_norm, "nd"), "pid", "left").join(norm(names_norm, "nn"), "id", "left")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+", -1), lambda w: w != ""))
    compat = F.when(type_matches(entity_type(F.col("s")), F.col("domain")) & type_matches(entity_type(F.col("o")), F.col("range")), 1.0).otherwise(0.0)
    overlap = safe_ratio(F.size(F.array_intersect(words("text"), words("description"))), F.size(words("description")))
    cosine = lambda d, a, b: F.coalesce(F.try_divide(F.col(d), F.col(a) * F.col(b)), F.lit(0.0))
    parts = out.select("id", "pid", compat.alias("type_compat"), cosine("pred_dot", "nt", "nd").alias("pred_sim"), overlap.alias("overlap"), cosine("desc_dot", "nt", "nn").alias("desc_sim"))
    return parts.withColumn("score", 0.4 * F.col("type_compat") + 0.3 * F.col("pred_sim") + 0.2 * F.col("overlap") + 0.1 * F.col("desc_sim"))


def best(rows: DataFrame, by: list[str], score: str, order: list[str]) -> DataFrame:
    """The row with the largest score of each group; of equal ones the first in the order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *order))).filter("__k = 1").drop("__k")


def canonical_compound(name: Column, mention: Column, target: Column) -> Column:
    """The redirect's target of a name with a comma, where the name is just the mention with underscores."""
    joined = F.replace(F.trim(F.regexp_replace(mention, r"\s+", " ")), F.lit(" "), F.lit("_"))
    swaps = name.contains(",") & (F.lower(joined) == F.lower(name)) & target.isNotNull() & (target != "")
    return F.when(swaps, target).otherwise(name)
