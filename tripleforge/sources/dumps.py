"""Readers of text dumps: label, redirect, disambiguation and link lines, JSON lines, page segments, transfer dumps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleforge.functions.text import RESOURCE, local_name, normalize

_LABEL = r'^<([^>]*)>\s+<[^>]*#label>\s+"((?:[^"\\]|\\.)*)"@en\s*\.\s*$'
_LINK = r"^<([^>]*)>\s+<([^>]*)>\s+<([^>]*)>\s*\.\s*$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain, .gz or .bz2 text in column ``value``; .bz2 splits, .gz does not."""
    return spark.read.text(path)


def _unescaped(values: pd.Series) -> pd.Series:
    import re

    known = {"t": "\t", "n": "\n", "r": "\r"}

    def one(match):
        if match[1] or match[2]:
            return chr(int(match[1] or match[2], 16))
        return known.get(match[3], match[3])

    return values.map(lambda v: v if v is None else re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, v))


def unescape(c: Column) -> Column:
    """N-Triples escapes; Python runs only for values with a backslash."""
    return F.when(c.contains("\\"), F.pandas_udf(_unescaped, "string")(c)).otherwise(c)


def label_lines(lines: DataFrame) -> DataFrame:
    """(surface, uri) of English label lines about resources."""
    uri = F.regexp_extract("value", _LABEL, 1)
    rows = lines.filter(F.col("value").rlike(_LABEL)).select(normalize(unescape(F.regexp_extract("value", _LABEL, 2))).alias("surface"), local_name(uri).alias("uri"))
    return rows.filter("uri <> '' AND surface <> ''")


def _links(lines: DataFrame) -> DataFrame:
    part = lambda k: F.regexp_extract("value", _LINK, k)
    return lines.filter(F.col("value").rlike(_LINK)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))


def redirect_lines(lines: DataFrame) -> DataFrame:
    """(surface, uri): the alias with spaces, and its target; both are resources."""
    rows = _links(lines).select(normalize(F.replace(local_name(F.col("s")), F.lit("_"), F.lit(" "))).alias("surface"), local_name(F.col("o")).alias("uri"))
    return rows.filter("uri <> '' AND surface <> ''")


def disambiguation_lines(lines: DataFrame) -> DataFrame:
    """(surface, uri): the page's name without a trailing ``(disambiguation)``, and a candidate."""
    name = F.regexp_replace(F.replace(local_name(F.col("s")), F.lit("_"), F.lit(" ")), r"(?i)\s*\(disambiguation\)\s*$", "")
    rows = _links(lines).select(normalize(name).alias("surface"), local_name(F.col("o")).alias("uri"))
    return rows.filter("uri <> '' AND surface <> ''")


def triples(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejects): lines whose object is a URI, and non-blank lines that are no triple at all."""
    literal = r'^<[^>]*>\s+<[^>]*>\s+".*\.\s*$'
    bad = lines.filter(~F.col("value").rlike(_LINK) & ~F.col("value").rlike(literal) & (F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    return _links(lines), bad


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): blank lines are skipped, lines that don't fit the schema are kept apart."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    parsed = raw.withColumn("row", F.from_json("value", schema + ", _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = parsed.filter("row IS NOT NULL AND row._corrupt IS NULL").select("row.*").drop("_corrupt")
    return good, parsed.filter("row IS NULL OR row._corrupt IS NOT NULL").select("value")


def last_by_id(rows: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """A later row of an id overwrites the earlier ones; of rows at the same place, the one with the largest values."""
    newest = rows.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.struct(order_col, *[c for c in rows.columns if c != order_col])).alias("row"))
    return newest.select(*[F.col("row")[c].alias(c) for c in rows.columns])


def page_segments(lines: DataFrame, least: int = 500) -> DataFrame:
    """(path, doc_id, title, body) of ``<doc id= title=> ... </doc>`` spans of lines (path, n, value); longer than ``least`` only.

    Lines are numbered within a file, so the running count has a file's lines in a task, not the corpus's."""
    by_line = Window.partitionBy("path").orderBy("n")
    opens = F.col("value").startswith("<doc ")
    numbered = lines.withColumn("segment", F.sum(opens.cast("int")).over(by_line)).filter("segment > 0")
    head = F.max(F.when(opens, F.col("value")))
    body = F.filter(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: ~x["value"].startswith("<doc ") & (x["value"] != "</doc>") & (F.trim(x["value"]) != ""))
    pages = numbered.groupBy("path", "segment").agg(head.alias("head"), F.array_join(F.transform(body, lambda x: x["value"]), " ").alias("body"))
    return pages.select("path", F.regexp_extract("head", 'id="([^"]*)"', 1).alias("doc_id"), F.regexp_extract("head", 'title="([^"]*)"', 1).alias("title"), "body").filter(F.length("body") > least)


def benchie_lines(lines: DataFrame) -> DataFrame:
    """(sent_id, arg1, rel, arg2) of tab-separated extraction lines."""
    parts = F.split("value", "\t", -1)
    return lines.filter(F.size(parts) >= 4).select(*[F.trim(parts[k]).alias(c) for k, c in enumerate(("sent_id", "arg1", "rel", "arg2"))])


def find_dump(folder: str, stem: str) -> str:
    """Path of the first dump, by name, whose name begins with ``stem`` and has ``.ttl`` in it; an error if there is none."""
    import glob
    import os

    found = sorted(glob.glob(os.path.join(glob.escape(folder), f"{glob.escape(stem)}*.ttl*")))
    if not found:
        raise FileNotFoundError(f"no {stem}*.ttl* in {folder}")
    return found[0]


def wikilink_lines(lines: DataFrame) -> DataFrame:
    """(uri) of the resources that link lines lead to."""
    return _links(lines).select(local_name(F.col("o")).alias("uri")).filter("uri <> ''")


def property_catalogue(triples: DataFrame, kind: str = "Property") -> DataFrame:
    """(uri, labels_en, labels_hi, comment, domains, ranges) of the properties among triples (s, p, o, lang; p a local name).

    A label without a language is English; sets are sorted; a property that is declared twice comes once."""
    own = triples.join(triples.filter((F.col("p") == "type") & (F.col("o") == kind)).select("s").distinct(), "s", "left_semi")
    values = lambda p, langs=None: F.sort_array(F.collect_set(F.when((F.col("p") == p) & (F.lit(True) if langs is None else F.coalesce("lang", F.lit("")).isin(*langs)), F.col("o"))))
    comment = F.min(F.when((F.col("p") == "comment") & F.coalesce("lang", F.lit("")).isin("en", ""), F.col("o")))
    return own.groupBy(F.col("s").alias("uri")).agg(values("label", ("en", "")).alias("labels_en"), values("label", ("hi",)).alias("labels_hi"), comment.alias("comment"), values("domain").alias("domains"), values("range").alias("ranges"))


def relation_pairs(lines: DataFrame) -> DataFrame:
    """(id, first, second, label, cause) of numbered lines (n, value): a tagged sentence, and after it the relation of its two elements."""
    tagged = lines.filter(F.col("value").contains("<e1>")).select("n", F.regexp_extract("value", r"^(\d+)", 1).cast("long").alias("id"), *[F.lower(F.regexp_extract("value", f"<e{k}>(.*?)</e{k}>", 1)).alias(c) for k, c in ((1, "first"), (2, "second"))])
    relation = lines.select((F.col("n") - 1).alias("n"), F.col("value").alias("relation"))
    ahead = F.col("relation").contains("(e1,e2)")
    return tagged.join(relation, "n").select("id", "first", "second", F.col("relation").contains("Cause-Effect").cast("long").alias("label"), F.when(ahead, F.col("first")).otherwise(F.col("second")).alias("cause"))


def sentence_lines(lines: DataFrame) -> DataFrame:
    """(id, sentence) of the lines (id, value) that aren't blank."""
    return lines.select("id", F.trim("value").alias("sentence")).filter("sentence <> ''")


def paged(fetch, size: int = 10_000) -> DataFrame:
    """The pages ``fetch(offset, size)`` put together, up to the first empty one."""
    out, offset = fetch(0, size), size
    while not (page := fetch(offset, size)).isEmpty():
        out, offset = out.unionByName(page), offset + size
    return out


def mention_table(spark: SparkSession, path: str) -> DataFrame:
    """(mention, context) of a .csv or .json(l) file, by its suffix; other suffixes are an error."""
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True, quote='"', escape='"')
    elif path.endswith((".json", ".jsonl")):
        rows = spark.read.json(path, multiLine=path.endswith(".json"))
    else:
        raise ValueError(f"unknown kind of file: {path}")
    return rows.select(F.col("mention").cast("string"), F.col("context").cast("string") if "context" in rows.columns else F.lit(None).cast("string").alias("context"))


def gold_patterns(lines: DataFrame) -> DataFrame:
    """(path, sent_id, sentence, cluster, kind, mark, pattern) of the gold lines of files (path, n, value).

    A ``sent_id:`` line opens a sentence, a line of a cluster's number a cluster of it. A line that begins with a mark in braces is
    compensatory, any other one essential; lines of equal signs and empty ones say nothing. Lines are numbered within a file, so a window has one file's."""
    text = F.trim("value")
    by_line = Window.partitionBy("path").orderBy("n")
    opens, names = text.contains("sent_id:"), text.contains("------ Cluster")
    numbered = lines.select("path", "n", text.alias("value"), opens.alias("opens"), names.alias("names")).withColumn("segment", F.sum(F.col("opens").cast("int")).over(by_line)).filter("segment > 0")
    own = Window.partitionBy("path", "segment").orderBy("n")
    last = lambda flag, pattern, k: F.last(F.when(F.col(flag), F.regexp_extract("value", pattern, k)), True).over(own)
    filled = numbered.withColumns({"sent_id": last("opens", r"sent_id:(\d+)", 1), "sentence": last("opens", r"sent_id:\d+\s+(.*)", 1), "cluster": last("names", r"(\d+)", 1).cast("long")})
    rows = filled.filter(~F.col("opens") & ~F.col("names") & F.col("cluster").isNotNull() & (F.col("value") != "") & ~F.col("value").contains("=" * 20))
    marked = F.substring("value", 1, 4).rlike(r"\{[a-z]\}")
    return rows.select("path", "sent_id", "sentence", "cluster", F.when(marked, "compensatory").otherwise("essential").alias("kind"), F.when(marked, F.substring("value", 2, 1)).alias("mark"), F.when(marked, F.substring("value", 5, 1 << 20)).otherwise(F.col("value")).alias("pattern"))


def resource_uri(title: Column) -> Column:
    return F.concat(F.lit(RESOURCE), F.replace(title, F.lit(" "), F.lit("_")))
