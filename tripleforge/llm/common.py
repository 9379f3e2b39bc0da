"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The blanks that separate words: space and the ASCII control blanks.
BLANKS = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local session (a test) that names none gets one of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


def materialize(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and read it again: lineage is cut, and no
    executor's loss takes the rows along. The folder belongs to the application and can be
    removed after it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def own_ids(docs: DataFrame) -> bool:
    """Whether each row has a doc_id of its own."""
    return docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty()


def numbered(docs: DataFrame) -> DataFrame:
    """(number, doc_id, text, row): the rows of ``docs`` with numbers that are written down, so they stay the same."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("number"), "doc_id", "text", F.struct(*docs.columns).alias("row")))


def hash_sample(rows: DataFrame, size: int, features: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``features`` of at most ``size`` rows, those with the smallest hashes of their doc_id (which ``features`` keeps).

    The rows are counted, and only those below a hash that some more than ``size`` rows are expected under are looked at and
    sorted. So features are made where the rows are, and a task sends its share of the sample and not ``size`` rows of
    its own. Where many rows share an id, there can be fewer."""
    n, h = rows.count(), F.xxhash64("doc_id")
    share = (size + 8 * size**0.5 + 64) / max(1, n)
    if share < 1:
        rows = rows.filter(h <= int(-(1 << 63) + share * (1 << 64)))
    return features(rows).orderBy(h, "doc_id").limit(size)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only, as the contracts ask."""
    return F.translate(c, UPPER, UPPER.lower())


def unit_hash(*parts: Column) -> Column:
    """Uniform double in [0, 1) from the md5 of the parts: 52 bits, exact in a double, and
    the same in any SQL engine that has md5."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def fold(c: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus
