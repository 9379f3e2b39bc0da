"""Graph patterns as joins over edges (s, p, o)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleforge.functions.text import ONTOLOGY

WIKILINK = ONTOLOGY + "wikiPageWikiLink"


def between(edges: DataFrame, pairs: DataFrame, namespace: str = ONTOLOGY) -> DataFrame:
    """Predicates of a namespace between the resources of each pair (a, b), either way."""
    own = edges.filter(F.startswith("p", F.lit(namespace)))
    ahead = pairs.join(own, (pairs["a"] == own["s"]) & (pairs["b"] == own["o"])).select("a", "b", "p", F.lit("forward").alias("direction"))
    back = pairs.join(own, (pairs["b"] == own["s"]) & (pairs["a"] == own["o"])).select("a", "b", "p", F.lit("inverse").alias("direction"))
    return ahead.unionByName(back).distinct()


def only_linked(edges: DataFrame) -> DataFrame:
    """(s, o) joined by a wikilink and by no other predicate."""
    links = edges.filter(F.col("p") == WIKILINK).select("s", "o").distinct()
    return links.join(edges.filter(F.col("p") != WIKILINK), ["s", "o"], "left_anti")


def linked_either_way(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with any edge either way."""
    both = edges.select(F.col("s").alias("a"), F.col("o").alias("b")).unionByName(edges.select(F.col("o").alias("a"), F.col("s").alias("b")))
    return pairs.join(both, ["a", "b"], "left_semi").distinct()


def exists(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, known): whether a resource is in the graph; null for no resource at all."""
    known = edges.select(F.col("s").alias("node")).unionByName(edges.select(F.col("o").alias("node"))).distinct().withColumn("hit", F.lit(True))
    return nodes.join(known, "node", "left").select("node", F.when(F.col("node").isNotNull(), F.coalesce("hit", F.lit(False))).alias("known"))


def two_hop(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with a common neighbour: one join from each side, restricted to the pairs' nodes before they meet."""
    both = edges.select(F.col("s").alias("x"), F.col("o").alias("y")).unionByName(edges.select(F.col("o").alias("x"), F.col("s").alias("y"))).distinct()
    left = both.join(pairs.select(F.col("a").alias("x")).distinct(), "x", "left_semi").select(F.col("x").alias("a"), F.col("y").alias("via"))
    right = both.join(pairs.select(F.col("b").alias("x")).distinct(), "x", "left_semi").select(F.col("x").alias("b"), F.col("y").alias("via"))
    return pairs.distinct().join(left, "a").join(right, ["b", "via"]).groupBy("a", "b").agg(F.countDistinct("via").alias("n_via"))


def verify(edges: DataFrame, triples: DataFrame, symmetric: tuple[str, ...] = (), indexed: DataFrame | None = None, unchecked: DataFrame | None = None, ranges: DataFrame | None = None, type_predicate: str | None = None) -> DataFrame:
    """Status of triples (s, p, o) by the first rule that holds:

    VERIFIED: the edge is there. INVERTED: it is there the other way round, and the predicate isn't ``symmetric``; or, where
    ``ranges`` (p, range) and the predicate of types are given, the object has no type of the range and the subject has. RELATED: any edge joins
    the two. UNVERIFIED: whether one of them exists could not be asked (``unchecked``: node), or the object is unknown here but a name of the
    surface index (``indexed``: node). FAITHFUL: both exist. OBJ_MISSING: only the subject does. REJECTED: else.

    One join of the claims' unordered pairs with the edges' gives the first three; an edge is looked at once."""
    both = lambda df, s, o: df.withColumns({"lo": F.least(s, o), "hi": F.greatest(s, o)})
    claims = triples.select("s", "p", "o").distinct()
    near = edges.select(F.col("s").alias("es"), F.col("p").alias("ep"), F.col("o").alias("eo"))
    met = both(claims, "s", "o").join(both(near, "es", "eo"), ["lo", "hi"])
    named, ahead, back = F.col("ep") == F.col("p"), (F.col("es") == F.col("s")) & (F.col("eo") == F.col("o")), (F.col("es") == F.col("o")) & (F.col("eo") == F.col("s"))
    flags = met.groupBy("s", "p", "o").agg(F.bool_or(named & ahead).alias("exact"), F.bool_or(named & back).alias("inverse"))
    nodes = edges.select(F.col("s").alias("n")).unionByName(edges.select(F.col("o").alias("n"))).distinct()
    marked = lambda df, c, key, name: df.select(F.col(c).alias(key)).distinct().withColumn(name, F.lit(True))
    out = triples.join(flags, ["s", "p", "o"], "left").join(marked(nodes, "n", "s", "has_s"), "s", "left").join(marked(nodes, "n", "o", "has_o"), "o", "left")
    swapped = unknown = known_name = F.lit(False)
    if ranges is not None:
        types = edges.filter(F.col("p") == type_predicate).select(F.col("s").alias("n"), F.col("o").alias("range"))
        member = ranges.join(types, "range").select("p", "n").distinct()
        out = out.join(marked(ranges, "p", "p", "limited"), "p", "left")
        out = out.join(member.select("p", F.col("n").alias("s"), F.lit(True).alias("s_in")), ["p", "s"], "left").join(member.select("p", F.col("n").alias("o"), F.lit(True).alias("o_in")), ["p", "o"], "left")
        swapped = F.coalesce("limited", F.lit(False)) & F.col("o_in").isNull() & F.coalesce("s_in", F.lit(False))
    if unchecked is not None:
        out = out.join(marked(unchecked, "node", "s", "ask_s"), "s", "left").join(marked(unchecked, "node", "o", "ask_o"), "o", "left")
        unknown = F.coalesce("ask_s", F.lit(False)) | F.coalesce("ask_o", F.lit(False))
    if indexed is not None:
        out = out.join(marked(indexed, "node", "o", "in_index"), "o", "left")
        known_name = F.coalesce("in_index", F.lit(False)) & F.col("has_s").isNotNull()
    turned = F.coalesce("inverse", F.lit(False)) & (~F.col("p").isin(*symmetric) if symmetric else F.lit(True))
    status = (
        F.when(F.col("exact"), "VERIFIED").when(turned | swapped, "INVERTED").when(F.col("exact").isNotNull(), "RELATED").when(unknown, "UNVERIFIED")
        .when(F.col("has_s") & F.col("has_o"), "FAITHFUL").when(known_name, "UNVERIFIED").when(F.col("has_s"), "OBJ_MISSING").otherwise("REJECTED")
    )
    return out.select("s", "p", "o", status.alias("status"))


def transitive_closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(doc, a, b): what each node of a document's edges (doc, a, b) leads to, by paths of doubled length until none is new. Rounds cut the
    lineage by checkpoint(). Documents are small; the closure of one has up to the square of its nodes."""
    closed = edges.distinct().checkpoint()
    known = closed.count()
    for _ in range(max_rounds):
        further = closed.join(closed.select("doc", F.col("a").alias("b"), F.col("b").alias("c")), ["doc", "b"]).select("doc", "a", F.col("c").alias("b"))
        closed = closed.unionByName(further).distinct().checkpoint()
        now = closed.count()
        if now == known:
            break
        known = now
    return closed


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(doc, node, cluster) of undirected links (doc, a, b): the smallest node that each reaches. A node takes the smallest label around it, then
    its label's label, so long chains shorten quickly. Rounds cut the lineage by checkpoint()."""
    both = links.select("doc", "a", "b").unionByName(links.select("doc", F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("doc", F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("cluster")).checkpoint()
    for _ in range(max_rounds):
        around = both.join(labels.select("doc", F.col("node").alias("b"), "cluster"), ["doc", "b"]).groupBy("doc", F.col("a").alias("node")).agg(F.min("cluster").alias("near"))
        nearer = labels.join(around, ["doc", "node"]).select("doc", "node", F.least("cluster", "near").alias("cluster"), F.col("cluster").alias("old"))
        jumped = nearer.join(labels.select("doc", F.col("node").alias("cluster"), F.col("cluster").alias("onward")), ["doc", "cluster"]).select("doc", "node", F.least("cluster", "onward").alias("cluster"), "old").checkpoint()
        labels = jumped.drop("old")
        if jumped.filter("cluster <> old").isEmpty():
            break
    return labels


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): each edge counts at both ends, a loop twice."""
    return edges.select(F.explode(F.array("s", "o")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def k_core(edges: DataFrame, k: int, min_relation: int = 0, max_rounds: int = 100) -> DataFrame:
    """Drop rare relations once, then nodes of degree below k until none is left to drop. Rounds cut the lineage by checkpoint()."""
    if min_relation:
        common = edges.groupBy("p").count().filter(F.col("count") >= min_relation).select("p")
        edges = edges.join(common, "p", "left_semi")
    edges = edges.checkpoint()
    left = edges.count()
    for _ in range(max_rounds):
        keep = degrees(edges).filter(F.col("degree") >= k).select("node")
        edges = edges.join(keep, edges["s"] == keep["node"], "left_semi").join(keep, F.col("o") == keep["node"], "left_semi").checkpoint()
        now = edges.count()
        if now == left:
            break
        left = now
    return edges


def range_members(edges: DataFrame, triples: DataFrame, ranges: DataFrame, type_predicate: str) -> DataFrame:
    """Whether each triple's object has a type of its predicate's range; null where the predicate has none."""
    types = edges.filter(F.col("p") == type_predicate).select(F.col("s").alias("o"), F.col("o").alias("range"))
    fits = triples.join(ranges, "p").join(types, ["o", "range"]).select("s", "p", "o").distinct().withColumn("fits", F.lit(True))
    limited = ranges.select("p").distinct().withColumn("limited", F.lit(True))
    return triples.join(fits, ["s", "p", "o"], "left").join(limited, "p", "left").select("s", "p", "o", F.when(F.col("limited"), F.coalesce("fits", F.lit(False))).alias("in_range"))
