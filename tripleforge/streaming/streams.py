"""Structured Streaming: windows over events, deduplicated feeds, incremental counts and chunked scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str | None = "48 hours") -> DataFrame:
    """Events and their mean value per type and tumbling (or sliding) window; with ``late``, older ones are dropped from a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late and events.isStreaming:
        timed = timed.withWatermark("ts", late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counts = timed.groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: runs of events with gaps shorter than ``gap``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", gap)
    found = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def fresh_items(items: DataFrame, key: str = "url", late: str = "48 hours") -> DataFrame:
    """Each key once within the recency window."""
    if items.isStreaming:
        return items.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return items.dropDuplicates([key])


def running_counts(edges: DataFrame, key: str = "o") -> DataFrame:
    """Incremental in-degree: state of a stream, or one aggregation of a table."""
    return edges.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def write_chunks(stream: DataFrame, checkpoint: str, out: str) -> StreamingQuery:
    """Append each micro-batch under its id; a replayed batch overwrites itself, so a restart is idempotent."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(rows: DataFrame, now: DataFrame) -> DataFrame:
    """Rows of a cache (expires_at, ...) that haven't expired at ``now``, a table of one row."""
    return rows.crossJoin(F.broadcast(now.limit(1))).filter(F.col("expires_at") > F.col("now")).drop("now")


def append_reviews(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of decisions to a table of reviews; the checkpoint keeps a restart from writing a batch twice."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
