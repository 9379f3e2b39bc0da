"""Training-corpus pipeline: toxicity, exact copies, near copies, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame that is
written as Parquet and read again. All but the last return the columns of ``docs``; the last adds ``copy`` and
``shuffle_key``. A toxic document goes; of equal texts and of each group of near copies one row stays; a document
that holds a benchmark item goes; the rest is repeated to its source's target weight. Rows are judged each by its own text,
also where ids are shared or null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tripleforge.llm.common import load, shared_dir
from tripleforge.llm.decontamination import without_contaminated
from tripleforge.llm.exact_dedup import without_copies
from tripleforge.llm.mixing import mix_sources
from tripleforge.llm.ngram_join import without_near_copies
from tripleforge.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, load(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [("toxicity", toxicity), ("exact_copies", exact_copies), ("near_copies", near_copies), ("decontamination", decontamination), ("mixing", mixing)]

#: Language models and components of a similarity graph have no SQL here; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
