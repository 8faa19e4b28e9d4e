"""Structured Streaming forms of the change feed, the work queue and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def appended(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the rows of Parquet files as they are added; ``files_per_trigger`` bounds each batch like a token bucket."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def windows(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", at: str = "ts", key: str = "event_type") -> DataFrame:
    """(start, end, key, n, total) over tumbling or sliding event-time windows behind a watermark."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = events.withWatermark(at, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", at: str = "ts", key: str = "user_id") -> DataFrame:
    """(start, end, key, n) of sessions that a quiet gap ends."""
    out = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def once(events: DataFrame, key: str, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Each key once within the watermark, for idempotent enqueueing."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def feed(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``sink(batch, batch_id)`` for every batch that is there, from the checkpoint on; a replayed batch has its old id."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
