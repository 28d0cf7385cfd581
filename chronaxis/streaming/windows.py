"""Event-time windows on streams: the streaming kin of the centred-window mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_mean(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "2 days", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Mean and count by key and window; rows later than ``late`` are dropped by the watermark.  Works on batches too."""
    made = events.withWatermark(time, late).groupBy(F.window(time, length, slide), key).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))
    return made.select(F.col("window.start").alias("start"), key, "mean_value", "n")
