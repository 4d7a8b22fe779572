"""Streaming forms: windows, sessions, running statistics and curve tables that grow. Extensions of the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, late: str, width: str, keys: Sequence[str], value: str) -> DataFrame:
    """start, keys, n, mean, low, high per window; rows later than `late` are dropped by the watermark."""
    made = events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return made.select(F.col("window.start").alias("start"), *keys, "n", "mean", "low", "high")


def sessions(events: DataFrame, time: str, late: str, gap: str, keys: Sequence[str]) -> DataFrame:
    """start, end, keys, n per run of rows without a gap that long."""
    made = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return made.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def once(events: DataFrame, time: str, late: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys weren't seen within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def cell_counts(readings: DataFrame, time: str, late: str, width: str, low: float, step: float) -> DataFrame:
    """start, metric, cell, n: a growing histogram of x per metric and window."""
    cells = readings.where("metric IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)").withColumn("cell", F.floor((F.col("x") - low) / step))
    made = cells.withWatermark(time, late).groupBy(F.window(time, width), "metric", "cell").agg(F.count("*").alias("n"))
    return made.select(F.col("window.start").alias("start"), "metric", "cell", "n")
