"""URL filter: host rules, and trust and distrust that spread over the links between hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, lower_ascii, materialize, small_enough

#: Verdict, host and path of each rule.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING = 0.85
#: Ranks (of 1 in all) are spread until no more than this is on its way; so much decides nothing.
TOLERANCE = 1e-6
#: A host is blocked if its distrust exceeds this many times its trust by more than TOLERANCE.
DISTRUST_RATIO = 1.0
CHECKPOINT_EVERY = 4
#: Links from which a host can be a hub, at least. Hubs have more than a HUB_SHARE-th of all links, so there are fewer than that.
HUB_LEAST, HUB_SHARE = 1000, 1000
BROADCAST_HOSTS = 200_000

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def parsed(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.withColumns({"host": lower_ascii(F.regexp_extract(url, URL, 1)), "path": F.regexp_extract(url, URL, 2)})


def rule_for(host, path, rules):
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    fits = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fit = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(fit, value) if fits is None else fits.when(fit, value)
    return fits


def with_hubs(edges: DataFrame) -> DataFrame:
    """``edges`` with ``hub``: whether their src has so many of them that they must not meet in one task."""
    most = max(HUB_LEAST, edges.count() // HUB_SHARE)
    hubs = edges.groupBy("src").count().filter(F.col("count") > most).select(F.col("src").alias("hub_src"))
    return edges.join(F.broadcast(hubs), F.col("src") == F.col("hub_src"), "left").withColumn("hub", F.col("hub_src").isNotNull()).drop("hub_src")


def from_src(edges: DataFrame, values: DataFrame) -> DataFrame:
    """``edges`` (of ``with_hubs``) with the row (src, ...) of ``values`` for their src. Rows of hubs are broadcast, the others joined."""
    hubs = values.join(F.broadcast(edges.filter("hub").select("src").distinct()), "src", "left_semi")
    return edges.filter("hub").join(F.broadcast(hubs), "src").unionByName(edges.filter("NOT hub").join(values, "src"))


def weighted(counts: DataFrame, amount: str) -> DataFrame:
    """(src, dst, weight, hub): the share of each edge in the ``amount`` of its src."""
    edges = materialize(with_hubs(materialize(counts)))
    return materialize(from_src(edges, edges.groupBy("src").agg(F.sum(amount).alias("all"))).select("src", "dst", (F.col(amount) / F.col("all")).alias("weight"), "hub"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight, hub): the share of a host's links that go to another host; one row a pair of hosts."""
    links = pages.filter("host != ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    return weighted(links.select("src", lower_ascii(F.col("dst")).alias("dst")).filter("src != dst").groupBy("src", "dst").count(), "count")


def spread(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank of (host, seed) along (src, dst, weight, hub): rank = (1 - d) seed + d sum(rank weight).

    Each step moves on what the step before it moved, and adds it to the ranks, until the hosts still to be reached could get
    ``tolerance`` in all. Mass at a host without links is not dealt anew, so a step is linear and needs no sum over all hosts."""
    moving = materialize(seeds.select("host", ((1 - damping) * F.col("seed")).alias("rank")))
    parts, step = [moving], 0
    while (moving.agg(F.sum("rank")).first()[0] or 0.0) * damping / (1 - damping) > tolerance:
        step += 1
        moved = from_src(edges, moving.withColumnRenamed("host", "src")).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("weight"))).alias("rank"))
        moving = materialize(moved)
        parts.append(moving)
        if step % CHECKPOINT_EVERY == 0:
            parts = [materialize(_summed(parts))]
    return _summed(parts)


def _summed(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("host").agg(F.sum("rank").alias("rank"))


def host_scores(pages: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, n_pages, trust, distrust, host_verdict) of the hosts of ``pages``: a row's host, path, fit and html.

    Seeds are the hosts' shares of all pages that an allow rule (trust) or a block rule (distrust) fits. Trust runs along the
    links, distrust against them: a host that links to a blocked one is suspect."""
    hosts = pages.filter("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("fit.verdict") == "allow").alias("allowed"), F.count_if(F.col("fit.verdict") == "block").alias("blocked"))
    hosts = materialize(hosts)
    edges = host_edges(pages)
    # against the links: shared among the hosts that link to one
    back = weighted(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("part")), "part")
    scores = hosts
    total = hosts.agg(F.sum("allowed").alias("allowed_all"), F.sum("blocked").alias("blocked_all"))
    for kind, seed, along in (("trust", "allowed", edges), ("distrust", "blocked", back)):
        seeds = hosts.filter(F.col(seed) > 0).crossJoin(F.broadcast(total)).select("host", (F.col(seed) / F.col(f"{seed}_all")).alias("seed"))
        scores = scores.join(spread(seeds, along, damping, tolerance).withColumnRenamed("rank", kind), "host", "left")
    scores = scores.fillna(0.0, ["trust", "distrust"])
    bad = F.col("distrust") - DISTRUST_RATIO * F.col("trust") > tolerance
    return scores.select("host", "n_pages", "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("host_verdict"))


def url_filter(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Judge every url: by the longest rule that fits, else by its host's trust and distrust.

    A host that is no page's url has ranks of its own on the way, and passes them on. Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed (it has no
    host to distrust); a null html has no links; a null id is carried along. Repeated pages
    count each time. An empty table gives an empty result. Of the other columns none is looked at.
    """
    rows = parsed(pages.select("page_id", "url", "html")).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    hosts = materialize(host_scores(rows, damping, tolerance).select("host", "trust", "distrust", "host_verdict"))
    judged = rows.select("page_id", "host", "path", "fit").join(F.broadcast(hosts) if small_enough(hosts, BROADCAST_HOSTS) else hosts, "host", "left")
    return judged.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), F.col("host_verdict"), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(load(spark, sf_dir, "pages"))
