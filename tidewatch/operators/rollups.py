"""Roll-ups of the prediction log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import order
from tidewatch.session import stage

# Upper bounds of the latency (seconds) and score histograms.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]
SCORE_BOUNDS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
# Window starts made from one row, at most.
WINDOWS_AT_ONCE = 10_000


def count_per_window(log: DataFrame, time: str, by: Sequence[str], length: str = "5 minutes") -> DataFrame:
    """Rows per tumbling window and group."""
    counted = log.groupBy(F.window(time, length).alias("_w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("_w.start").alias("window_start"), *by, "n")


def error_counts(
    log: DataFrame, time: str, error: Column, kinds: dict[str, Column], length: str = "5 minutes"
) -> DataFrame:
    """Errors per window, in total and per kind, with 0 for windows that have none (or no rows at all)."""
    counted = log.groupBy(F.window(time, length).alias("_w")).agg(
        F.count_if(error).alias("errors"),
        *[F.count_if(error & kind).alias(name) for name, kind in kinds.items()],
    )
    counted = stage(counted.select(F.col("_w.start").alias("window_start"), "errors", *kinds), "errors")
    return spine(counted, length).join(counted, "window_start", "left").fillna(0, subset=["errors", *kinds])


def _grid(counted: DataFrame, length: str, span: tuple | None) -> tuple[int, int, int] | None:
    """First window start and step in microseconds, and the number of windows up to the last one."""
    low, high = span or counted.agg(F.min("window_start"), F.max("window_start")).first()
    if low is None:
        return None
    bounds = counted.sparkSession.range(1).select(
        F.unix_micros(F.lit(low)).alias("low"),
        F.unix_micros(F.lit(high)).alias("high"),
        (F.unix_micros(F.lit(low) + F.expr(f"interval {length}")) - F.unix_micros(F.lit(low))).alias("step"),
    ).first()
    return bounds["low"], bounds["step"], (bounds["high"] - bounds["low"]) // bounds["step"] + 1


def spine(counted: DataFrame, length: str, span: tuple | None = None) -> DataFrame:
    """All window starts from the first to the last of `counted` (or of `span`), made by many tasks."""
    grid = _grid(counted, length, span)
    if grid is None:
        return counted.select("window_start").limit(0)
    low, step, number = grid
    steps = counted.sparkSession.range(number)
    return steps.select(F.timestamp_micros(F.lit(low) + F.col("id") * step).alias("window_start"))


def errors_by_type(
    log: DataFrame, time: str, kind: str, length: str = "5 minutes", span: tuple | None = None
) -> DataFrame:
    """Errors per window and type, whatever types there are, with 0 where a type did not occur.

    `kind` is null for rows that are no errors. Types stay a table of any size; each makes its own windows, a
    bounded number of them from one row.
    """
    counted = log.where(F.col(kind).isNotNull()).groupBy(F.window(time, length).alias("_w"), F.col(kind).alias("error_type"))
    counted = stage(
        counted.agg(F.count(F.lit(1)).alias("errors")).select(F.col("_w.start").alias("window_start"), "error_type", "errors"),
        "errors-by-type",
    )
    grid = _grid(counted, length, span)
    if grid is None:
        return counted
    low, step, number = grid
    types = counted.select("error_type").distinct()
    blocks = types.select("error_type", F.explode(F.sequence(F.lit(0), F.lit((number - 1) // WINDOWS_AT_ONCE))).alias("block"))
    first = F.col("block") * WINDOWS_AT_ONCE
    place = F.explode(F.sequence(first, F.least(first + (WINDOWS_AT_ONCE - 1), F.lit(number - 1))))
    every = blocks.select("error_type", place.alias("place")).select(
        F.timestamp_micros(F.lit(low) + F.col("place").cast("long") * step).alias("window_start"), "error_type"
    )
    return every.join(counted, ["window_start", "error_type"], "left").fillna(0, subset=["errors"])


def histogram(
    log: DataFrame, keys: Sequence[Column | str], value: str, bounds: Sequence[float]
) -> DataFrame:
    """Cumulative counts per upper bound (`le`), with total, sum and mean, in one aggregation."""
    v = F.col(value)
    return log.where(v.isNotNull()).groupBy(*keys).agg(
        F.array(*[F.count_if(v <= bound) for bound in bounds]).alias("le"),
        F.count(F.lit(1)).alias("n"),
        F.sum(v).alias("total"),
        F.avg(v).alias("mean"),
    )


def bucket_quantile(le: Column, n: Column, bounds: Sequence[float], q: float) -> Column:
    """A quantile interpolated inside its bucket; beyond the last bound, the last bound."""
    rank = n * q
    out = F.lit(float(bounds[-1]))
    for i in range(len(bounds) - 1, -1, -1):
        high, upto = float(bounds[i]), le[i]
        low, before = (float(bounds[i - 1]), le[i - 1]) if i else (0.0, F.lit(0))
        if i == 0 and high <= 0:
            inside = F.lit(high)
        else:
            inside = low + (high - low) * F.try_divide(rank - before, upto - before)
        out = F.when(upto >= rank, F.coalesce(inside, F.lit(high))).otherwise(out)
    return F.when(n > 0, out)


def unfold(histograms: DataFrame, keys: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """One row per bound."""
    cells = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col("le")[i].alias("n")) for i, b in enumerate(bounds)])
    return histograms.select(*keys, F.inline(cells))


def latency_per_window(log: DataFrame, time: str, value: str, length: str = "5 minutes") -> DataFrame:
    """Count, mean and interpolated 95th percentile of latency per window."""
    h = histogram(log, [F.window(time, length).alias("_w")], value, LATENCY_BOUNDS)
    return h.select(
        F.col("_w.start").alias("window_start"),
        "n",
        "mean",
        bucket_quantile(F.col("le"), F.col("n"), LATENCY_BOUNDS, 0.95).alias("p95"),
    )


def exact_percentiles(
    log: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], rows_per_task: int | None = None
) -> DataFrame:
    """Exact percentiles per group, by ordering distinct values in buckets."""
    counts = log.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_rows"))
    return order.quantiles(stage(counts, "values"), keys, value, "_rows", probabilities, rows_per_task)


def score_histogram(log: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    return unfold(histogram(log, by, score, SCORE_BOUNDS), by, SCORE_BOUNDS)


def version_activity(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per model version: first and last use, rows, positive rate and accuracy of labelled rows."""
    known = F.col("actual_label").isNotNull()
    return log.groupBy(*by, "model_version").agg(
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("prediction").cast("double")).alias("positive_rate"),
        F.count_if(known).alias("labelled"),
        F.avg(F.when(known, (F.col("prediction") == F.col("actual_label")).cast("double"))).alias("accuracy"),
    )


def version_succession(activity: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Which version served before each version. The input has one row per version."""
    columns = activity.columns
    rows, keys = order.keyed(activity, by)
    w = Window.partitionBy(*keys).orderBy("first_seen", "model_version")
    return rows.select(*columns, F.lag("model_version").over(w).alias("previous_version"))
