"""Streams: an extension for data that arrives over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fresh(rows: DataFrame, digest: str, time: str, late: str = "1 day") -> DataFrame:
    """A stream without copies: the first row of each content within the watermark. State is bounded by `late`."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([digest])


def counts(events: DataFrame, time: str, kind: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window_start, kind, n of a stream of events, once a window is complete."""
    out = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n")


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now to path, exactly once over restarts, and stops."""
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
