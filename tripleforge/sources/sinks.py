"""Writers: triples in several formats, transfer dumps with a count check, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def triple_lines(triples: DataFrame, kind: str) -> DataFrame:
    """Lines (value) of triples (s, p, o) as jsonl, tsv or nt; nt has URIs only."""
    if kind == "jsonl":
        return triples.select(F.to_json(F.struct("s", "p", "o")).alias("value"))
    if kind == "tsv":
        return triples.select(F.concat_ws("\t", "s", "p", "o").alias("value"))
    if kind == "nt":
        uris = triples.filter(" AND ".join(f"{c} RLIKE '^https?://'" for c in "spo"))
        return uris.select(F.format_string("<%s> <%s> <%s> .", "s", "p", "o").alias("value"))
    raise ValueError(f"unknown format {kind}")


def write_triples(triples: DataFrame, kind: str, path: str) -> None:
    triple_lines(triples, kind).write.mode("overwrite").text(path)


def word2vec_lines(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Lines of the word2vec text format, the header first by ``n`` = 0."""
    size = vectors.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(vector)).alias("dim"))
    head = size.select(F.lit(0).alias("n"), F.concat_ws(" ", F.col("rows").cast("string"), F.coalesce("dim", F.lit(0)).cast("string")).alias("value"))
    body = vectors.select(F.lit(1).alias("n"), F.concat_ws(" ", F.replace(F.col(label).cast("string"), F.lit(" "), F.lit("_")), F.array_join(F.transform(vector, lambda x: x.cast("string")), " ")).alias("value"))
    return head.unionByName(body)


def export_index(index: DataFrame, path: str) -> None:
    """Write (surface, uri, tier, final) as gzipped JSON lines, and a manifest with the count."""
    index.write.mode("overwrite").json(f"{path}/rows", compression="gzip")
    index.agg(F.count(F.lit(1)).alias("count")).write.mode("overwrite").json(f"{path}/manifest")


def import_index(spark: SparkSession, path: str) -> DataFrame:
    """Read an exported index; a dump whose count differs from its manifest's is an error."""
    rows = spark.read.schema("surface STRING, uri STRING, tier DOUBLE, final DOUBLE").json(f"{path}/rows")
    wanted, found = spark.read.schema("count BIGINT").json(f"{path}/manifest").first()["count"], rows.count()
    if wanted != found:
        raise ValueError(f"the dump has {found} rows, its manifest says {wanted}")
    return rows


def _xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def rdf_xml_lines(s: Column, p: Column, o: Column) -> Column:
    """A triple as an RDF/XML description; a URI object is a resource, anything else a literal."""
    about = F.replace(_xml(s), F.lit('"'), F.lit("&quot;"))
    literal = F.concat(F.lit("<"), p, F.lit(">"), _xml(o), F.lit("</"), p, F.lit(">"))
    linked = F.concat(F.lit("<"), p, F.lit(' rdf:resource="'), F.replace(_xml(o), F.lit('"'), F.lit("&quot;")), F.lit('"/>'))
    return F.concat(F.lit('<rdf:Description rdf:about="'), about, F.lit('">'), F.when(o.rlike("^https?://"), linked).otherwise(literal), F.lit("</rdf:Description>"))


def csv_line(*values: Column) -> Column:
    """A CSV line: values with a comma, quote or line break are quoted, quotes doubled."""
    quoted = lambda c: F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    return F.concat_ws(",", *[quoted(c) for c in values])


def extraction_lines(rows: DataFrame) -> DataFrame:
    """Tab lines (value) of extractions (sent_id, arg1, rel, arg2) whose slots are all there."""
    whole = rows.dropna(subset=["sent_id", "arg1", "rel", "arg2"]).filter("trim(arg1) <> '' AND trim(rel) <> '' AND trim(arg2) <> ''")
    return whole.select(F.concat_ws("\t", "sent_id", "arg1", "rel", "arg2").alias("value"))


def conll_lines(words: Column, mentions: Column) -> Column:
    """Lines ``word mark`` of mentions (first, last, cluster): ``(c`` opens, ``c)`` closes, ``(c)`` is one word, ``-`` none; several marks
    of a word are joined by bars."""

    def line(w: Column, i: Column) -> Column:
        own = F.filter(mentions, lambda m: (m["first"] == i) | (m["last"] == i))
        marks = F.transform(own, lambda m: F.concat(F.when(m["first"] == i, "(").otherwise(""), m["cluster"], F.when(m["last"] == i, ")").otherwise("")))
        return F.concat_ws(" ", w, F.when(F.size(marks) > 0, F.array_join(marks, "|")).otherwise("-"))

    return F.transform(words, line)


def markdown_row(*values: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))
