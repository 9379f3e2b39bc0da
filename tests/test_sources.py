"""Readers, writers, streams and Python operators."""

import pytest
from pyspark.sql import functions as F

from tripleforge.functions.text import RESOURCE, iso_date
from tripleforge.operators import oie, registry
from tripleforge.operators.arrays import sublist_starts
from tripleforge.sources import dumps, sinks
from tripleforge.streaming import streams


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_labels(spark):
    got = dumps.label_lines(lines(spark, f'<{RESOURCE}Caf%C3%A9+x> <http://w#label> "  Caf\\u00E9  \\"One\\" "@en .', f'<{RESOURCE}B> <http://w#label> "b"@de .', '<http://other/C> <http://w#label> "c"@en .', "junk")).collect()
    assert [(r.surface, r.uri) for r in got] == [('café "one"', "Café+x")]


def test_redirects_and_disambiguations(spark):
    assert [tuple(r) for r in dumps.redirect_lines(lines(spark, f"<{RESOURCE}The_Old_A> <p> <{RESOURCE}A> .", f"<{RESOURCE}B> <p> <http://x/y> .")).collect()] == [("the old a", "A")]
    assert [tuple(r) for r in dumps.disambiguation_lines(lines(spark, f"<{RESOURCE}Mercury_(Disambiguation)> <p> <{RESOURCE}Mercury_(planet)> .")).collect()] == [("mercury", "Mercury_(planet)")]


def test_rejects(spark):
    edges, bad = dumps.triples(lines(spark, "<a> <b> <c> .", '<a> <b> "lit" .', "broken", "", "# note"))
    assert edges.count() == 1 and [r.value for r in bad.collect()] == ["broken"]


def test_json_and_duplicates(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a", "n": 1}\n\n{bad\n{"id": "a", "n": 2}\n')
    rows, bad = dumps.json_lines(spark, str(tmp_path / "x.jsonl"), "id STRING, n INT")
    assert sorted(tuple(r) for r in rows.collect()) == [("a", 1), ("a", 2)] and bad.count() == 1
    assert [r.n for r in dumps.last_by_id(rows, "id", "n").collect()] == [2]


def test_pages(spark):
    rows = [("f", k, v) for k, v in enumerate(['<doc id="1" title="T">', "a" * 300, "b" * 300, "</doc>", '<doc id="2" title="S">', "short", "</doc>"])]
    got = dumps.page_segments(spark.createDataFrame(rows, "path string, n int, value string")).collect()
    assert [(r.doc_id, r.title, r.body) for r in got] == [("1", "T", "a" * 300 + " " + "b" * 300)]


def test_transfer_dump(spark, tmp_path):
    index = spark.createDataFrame([("a", "u", 1.0, 2.0), ("b", "v", 0.5, 0.5)], "surface string, uri string, tier double, final double")
    sinks.export_index(index, str(tmp_path / "dump"))
    assert sorted(map(tuple, sinks.import_index(spark, str(tmp_path / "dump")).collect())) == sorted(map(tuple, index.collect()))
    index.limit(1).write.mode("overwrite").json(str(tmp_path / "dump/rows"), compression="gzip")
    with pytest.raises(ValueError):
        sinks.import_index(spark, str(tmp_path / "dump"))


def test_word2vec(spark):
    rows = sinks.word2vec_lines(spark.createDataFrame([("a b", [1.0, 2.0])], "l string, v array<double>"), "l", "v").orderBy("n")
    assert [r.value for r in rows.collect()] == ["1 2", "a_b 1.0 2.0"]


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), events.schema)
    run = streams.write_chunks(stream.select("event_id"), str(tmp_path / "check"), str(tmp_path / "out"))
    run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    counts = streams.running_counts(streams.event_stream(spark, str(tmp_path / "in"), events.schema), "event_type").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert {r.event_type: r.n for r in spark.table("counts").collect()} == {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}


def test_rebel_and_bio(spark):
    marked = spark.createDataFrame([("<s><triplet> A <subj> B <obj> r1 <subj> C <obj> r2 <triplet> D <subj> E <obj> r3</s>",), ("<subj> x <obj> y <triplet> A <obj> r <subj> B",), ("",), (None,)], "m string")
    found = [[tuple(t) for t in r.t] if r.t is not None else None for r in marked.select(oie.rebel_triples(marked.m).alias("t")).collect()]
    assert found == [[("A", "r1", "B"), ("A", "r2", "C"), ("D", "r3", "E")], [], [], None]
    row = spark.createDataFrame([(["a", "b", "c", "d"], ["B-PER", "I-PER", "O", "I-LOC"])], "w array<string>, t array<string>").select(oie.bio_mentions(F.col("w"), F.col("t")).alias("m")).first()
    assert [(m.s, m.e, m.k) for m in row.m] == [(0, 2, "PER"), (3, 4, "LOC")]


def test_extract_falls_back(spark):
    def broken(sentence):
        raise RuntimeError("no model")

    rows = spark.createDataFrame([(1, "a b c"), (2, "one")], "id long, sentence string")
    assert [tuple(r) for r in registry.extract(rows, broken).collect()] == [(1, "a", "relatedTo", "c", "ERROR")]
    assert [tuple(r) for r in registry.extract(spark.createDataFrame([(1, "the sky is blue")], "id long, sentence string"), registry.EXTRACTORS["copula"]).collect()] == [(1, "the sky", "is", "blue", "OK")]


def test_dates_and_sublists(spark):
    rows = spark.createDataFrame([("March 3rd, 1999",), ("3 March 987",), ("03-14-2001",), ("1850",), ("soon",)], "d string").select(iso_date(F.col("d")).alias("x")).collect()
    assert [r.x for r in rows] == ["1999-03-03", "0987-03-03", "2001-03-14", "1850", None]
    found = spark.createDataFrame([(["a", "b", "a", "b"], ["a", "b"]), (["a"], ["a", "b"])], "w array<string>, p array<string>").select(sublist_starts(F.col("w"), F.col("p")).alias("at")).collect()
    assert [r.at for r in found] == [[0, 2], []]
