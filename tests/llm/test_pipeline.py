"""The pipeline's stages against plain Python."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from tripleforge.llm import decontamination, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import re

    from test_operators import brute_join

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_copies", "near_copies", "decontamination", "mixing"]
    clean = stages["toxicity"](spark, docs, SF)
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id for r in clean.collect()} == set(texts) - toxic
    first = {}
    for i in sorted(texts):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", texts[i]), i)
    single = stages["exact_copies"](spark, docs, SF)
    assert sorted(r.doc_id for r in single.collect()) == sorted(first.values())
    near = stages["near_copies"](spark, docs, SF)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c, _) in brute_join(texts, 5, 80).items() if i == c)
    kept = stages["decontamination"](spark, docs, SF)
    leaks = {r.doc_id for r in decontamination.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaks and {r.doc_id for r in kept.collect()} == set(texts) - leaks


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[-2:] == ["copy", "shuffle_key"] and out.filter(F.col("copy") < 1).count() == 0


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "s"), (1, None, "s"), (2, "", None), (None, "x y", "s"), (3, "x y", "s")], "doc_id long, text string, source string")
    for _, stage in corpus_pipeline.STAGES[:4]:
        rows = stage(spark, rows, SF)
        assert rows.columns == ["doc_id", "text", "source"]
        assert stage(spark, rows.limit(0), SF).count() == 0
    assert {r.doc_id for r in rows.collect()} == {1, 3}


def test_exact_copies_ids(spark):
    """A text of its own stays without an id, or with an id that another text has too; one row of each text stays."""
    rows = [(None, "a", "s"), (None, "b b", "s"), (None, "b b", "t"), (None, "b \tb", "s"), (1, "c", "s"), (1, "d", "s"), (1, "d", "s"), (2, "d", "s"), (None, "d", "s"), (None, None, "s"), (None, "", "s")]
    out = corpus_pipeline.exact_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, text_sha256 string"), SF)
    assert out.columns == ["doc_id", "text", "text_sha256"]
    assert sorted((r.doc_id or 0, " ".join((r.text or "").split())) for r in out.collect()) == [(0, ""), (0, "a"), (0, "b b"), (1, "c"), (1, "d")]


def test_imports_without_session():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert 'pipeline' in q; print(sum(n[:2] == 'op' and n[2:].split('_')[0].isdigit() for n in q))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip() == "10", said.stderr
