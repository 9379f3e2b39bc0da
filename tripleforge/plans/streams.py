"""Queries on sources, sinks, streams and Python operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleforge.functions.text import RESOURCE
from tripleforge.operators import oie, registry as models
from tripleforge.sources import dumps, sinks
from tripleforge.streaming import streams

from . import tables
from .tables import EDGES_SQL, load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("tumbling_windows", "SELECT strftime(time_bucket(INTERVAL 10 MINUTES, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    return streams.windowed_counts(load(spark, sf_dir, "events"))


@query("sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, sf_dir):
    return streams.sessions(load(spark, sf_dir, "events"))


@query("running_counts", "SELECT event_type AS o, count(*) AS n FROM events GROUP BY 1")
def running_counts(spark, sf_dir):
    return streams.running_counts(load(spark, sf_dir, "events").select(F.col("event_type").alias("o")))


@query("triples_nt", f"WITH {EDGES_SQL} SELECT '<' || s || '> <' || p || '> <' || o || '> .' AS value FROM edges")
def triples_nt(spark, sf_dir):
    return sinks.triple_lines(tables.edges(spark, sf_dir), "nt")


@query("triples_tsv", f"WITH {EDGES_SQL} SELECT s || chr(9) || p || chr(9) || o AS value FROM edges")
def triples_tsv(spark, sf_dir):
    return sinks.triple_lines(tables.edges(spark, sf_dir), "tsv")


@query("parsed_triples", f"WITH {EDGES_SQL} SELECT s, p, o FROM edges")
def parsed_triples(spark, sf_dir):
    return dumps.triples(sinks.triple_lines(tables.edges(spark, sf_dir), "nt"))[0]


def _lines(spark, sf_dir, template):
    return load(spark, sf_dir, "part").select(F.format_string(template, "p_partkey", F.col("p_name"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("value"))


@query("label_lines", "SELECT p_name AS surface, 'Part_' || p_partkey AS uri FROM part")
def label_lines(spark, sf_dir):
    return dumps.label_lines(_lines(spark, sf_dir, f'<{RESOURCE}Part_%1$s> <http://w3/rdf#label> "%2$s"@en .'))


@query("redirect_lines", "SELECT p_name AS surface, 'Part_' || p_partkey AS uri FROM part")
def redirect_lines(spark, sf_dir):
    return dumps.redirect_lines(_lines(spark, sf_dir, f"<{RESOURCE}%3$s> <http://kg/redirects> <{RESOURCE}Part_%1$s> ."))


@query("disambiguation_lines", "SELECT p_name AS surface, 'Part_' || p_partkey AS uri FROM part")
def disambiguation_lines(spark, sf_dir):
    return dumps.disambiguation_lines(_lines(spark, sf_dir, f"<{RESOURCE}%3$s_(disambiguation)> <http://kg/disambiguates> <{RESOURCE}Part_%1$s> ."))


@query("extracted_triples", "SELECT item_id AS id, split_part(text, ' ', 1) AS sub, 'relatedTo' AS rel, regexp_extract(text, '(\\S+)\\s*$', 1) AS obj, 'OK' AS status FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark) WHERE contains(text, ' ')")
def extracted_triples(spark, sf_dir):
    return models.extract(load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("sentence")), models.first_last)


@query("rebel_triples", "SELECT p_partkey, p_name AS head, p_type AS type, p_brand AS tail FROM part UNION ALL SELECT p_partkey, p_name, 'r2', 'Size ' || p_size FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 'H2', 'r3', p_brand FROM part WHERE p_size > 25")
def rebel_triples(spark, sf_dir):
    """A second tail, a second head, a triple without a relation, and a relation that is said again."""
    more = F.when(F.col("p_size") > 25, F.format_string(" <subj> Size  %s <obj> r1 <obj> r2 <subj> none <obj> <triplet> H2 <subj> %s <obj> r3 <pad>", "p_size", "p_brand")).otherwise("")
    marked = F.format_string("<s><triplet> %s <subj> %s <obj> %s%s</s>", "p_name", "p_brand", "p_type", more)
    return load(spark, sf_dir, "part").select("p_partkey", F.inline(oie.rebel_triples(marked)))


@query("entity_locks", "SELECT p_partkey, p_partkey % 4 <> 3 AS same, round(2 * length(p_name) / (2 * length(p_name) + 1), 6) AS ratio FROM part")
def entity_locks(spark, sf_dir):
    """Labels with a parenthesis, as they are, with a letter too many, and of something else."""
    kind, name = F.col("p_partkey") % 4, F.replace("p_name", F.lit(" "), F.lit("_"))
    label = F.when(kind == 0, F.concat(name, F.lit("_("), "p_brand", F.lit(")"))).when(kind == 1, F.upper(name)).when(kind == 2, F.concat(name, F.lit("s"))).otherwise("0123456789_0123456789")
    ratio = F.round(oie.sequence_ratio(F.col("p_name"), F.concat("p_name", F.lit("0"))), 6)
    return load(spark, sf_dir, "part").select("p_partkey", oie.locked(label, F.col("p_name")).alias("same"), ratio.alias("ratio"))
