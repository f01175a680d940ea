"""Event-time roll-ups of the prediction stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import rollups


def predictions(log: DataFrame, time: str = "created_at", delay: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Predictions per window, class and version; a window is emitted once, when it can no longer change."""
    return rollups.count_per_window(log.withWatermark(time, delay), time, ["prediction", "model_version"], length)


def scores(log: DataFrame, time: str = "created_at", delay: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Cumulative score histogram per window and version."""
    h = rollups.histogram(
        log.withWatermark(time, delay), [F.window(time, length).alias("_w"), "model_version"], "probability", rollups.SCORE_BOUNDS
    )
    cells = rollups.unfold(
        h.select(F.col("_w.start").alias("window_start"), "model_version", "le"), ["window_start", "model_version"], rollups.SCORE_BOUNDS
    )
    return cells


def errors(log: DataFrame, error: Column, time: str = "created_at", delay: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Errors per window that had any rows; 0 when none of them failed."""
    counted = log.withWatermark(time, delay).groupBy(F.window(time, length).alias("_w")).agg(
        F.count_if(error).alias("errors"), F.count(F.lit(1)).alias("n")
    )
    return counted.select(F.col("_w.start").alias("window_start"), "errors", "n")


def errors_by_type(log: DataFrame, kind: str, time: str = "created_at", delay: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Errors per window and type; `kind` is null for rows that are no errors."""
    # Rows without an error are counted as 0 rather than filtered, so that they too move the watermark.
    grouped = log.withWatermark(time, delay).groupBy(F.window(time, length).alias("_w"), F.col(kind).alias("error_type"))
    counted = grouped.agg(F.count(kind).alias("errors")).where("errors > 0")
    return counted.select(F.col("_w.start").alias("window_start"), "error_type", "errors")


def latency(log: DataFrame, value: str = "latency", time: str = "created_at", delay: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Mean and 95th percentile per window; the state holds one counter per bucket, not the values."""
    return rollups.latency_per_window(log.withWatermark(time, delay), time, value, length)


def drift_counts(
    current: DataFrame, features: Sequence[str], text: set[str], time: str, delay: str, length: str
) -> DataFrame:
    """(window, feature, value) counts for event-time drift."""
    from tidewatch.operators import drift

    marked = current.select(time, *features).withWatermark(time, delay)
    counted = drift.window_counts(marked, features, text, [F.window(time, length).alias("_w")])
    return counted.select(F.col("_w.start").alias("window_start"), *drift.CELL, "o")
