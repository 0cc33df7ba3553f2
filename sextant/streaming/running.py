"""As-known-at-the-time counts over a stream of events, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str, by: list[str], length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per window and key; works on a stream and on a table alike."""
    w = F.window(F.col(at).cast("timestamp"), length, slide) if slide else F.window(F.col(at).cast("timestamp"), length)
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(at, late)
    return rows.groupBy(w.alias("window"), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
