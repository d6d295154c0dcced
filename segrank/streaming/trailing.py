"""Streaming counterparts: casualties by unit and time window, with late rows dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from segrank.functions.guards import FeatureError, require_columns


def windowed_counts(events: DataFrame, ts: str, unit: str, value: str, width: str = "30 days", slide: str | None = None, lateness: str = "7 days") -> DataFrame:
    """unit, start, end, events, total for tumbling or sliding windows; works on batch and streaming frames (append mode)."""
    require_columns(events, [ts, unit, value], FeatureError, "events")
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = rows.groupBy(w.alias("w"), unit).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
    return out.select(unit, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "total")
