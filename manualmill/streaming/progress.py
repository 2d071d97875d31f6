"""Progress feeds as streams: tumbling counts, repeated deliveries, stalled crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def feed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def tumbling(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(key, start, n): events of each window; with late as the watermark of a stream."""
    events = events.withWatermark(at, late) if late else events
    out = events.groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "300 seconds", late: str | None = None) -> DataFrame:
    """(key, start, end, n): stretches of progress; a stretch ends when nothing came for the gap, which is a stall."""
    events = events.withWatermark(at, late) if late else events
    out = events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, at: str, ident: str, late: str) -> DataFrame:
    """A stream without events delivered again within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([ident])
