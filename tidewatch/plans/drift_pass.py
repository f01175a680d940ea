"""The drift pass: cut the log into windows, test each against the baseline, decide what to do."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import cooldown, drift, order, split
from tidewatch.operators.drift import DriftConfig
from tidewatch.operators.scenarios import Edit, Overwrite, apply_edits
from tidewatch.session import stage

NO_REFERENCE = "no_reference"
NO_NEW_LOGS = "no_new_logs"
# The outcome codes.
INSUFFICIENT_SAMPLES = "insufficient_samples"
COLUMN_MISMATCH = "column_mismatch"
ANALYSIS_FAILED = "analysis_failed"
NO_DRIFT = "no_drift"
DRIFT_DETECTED = "drift_detected"
# After these somebody has to look; the other outcomes are regular ends of a pass.
FAILURES = (NO_REFERENCE, COLUMN_MISMATCH, ANALYSIS_FAILED)


@dataclass(frozen=True)
class PassConfig:
    window_size: int = 1000
    min_samples: int = 100
    cooldown_seconds: float = 3600
    tests: DriftConfig = field(default_factory=DriftConfig)


@dataclass(frozen=True)
class PassResult:
    """One row per window, and one row per window and feature (None when nothing was tested)."""

    windows: DataFrame
    features: DataFrame | None


def drift_pass(
    baseline: DataFrame | None,
    log: DataFrame,
    order_by: Sequence[str] = ("created_at", "id"),
    by: Sequence[str] = (),
    features: Sequence[str] | None = None,
    config: PassConfig = PassConfig(),
    rows_per_task: int | None = None,
    earlier: DataFrame | None = None,
) -> PassResult:
    """Replay a log against a baseline. Windows hold `window_size` rows, oldest first, per stream `by`.

    `earlier` continues former passes: per stream the number of its next window and when it last fired
    (`next_window`, `last_fired`), as `pass_state` gives them.

    Each window gets one outcome; a breach fires unless the stream fired less than the cooldown ago,
    by the end times of the windows.
    """
    by = list(by)
    time = order_by[0]
    keys = [*by, "window_id"]
    if features is None:
        features = drift.common_features(baseline, log, [*by, *order_by]) if baseline is not None else []
    else:
        features = [f for f in features if f in log.columns and (baseline is None or f in baseline.columns)]
    needed = log.select(*dict.fromkeys([*by, *order_by, *features]))
    cut = stage(
        split.count_windows(needed, order_by, config.window_size, config.min_samples, by, rows_per_task), "log-windows"
    )
    if earlier is not None:
        keyed, names = order.keyed(cut, by)
        numbers = order.keyed(earlier, by)[0].select(*names, F.col("next_window").alias("_next"))
        later = order.join_on(keyed, numbers, names, "left")
        cut = later.withColumn("window_id", F.col("window_id") + F.coalesce("_next", F.lit(0))).select(*cut.columns)
    windows = cut.groupBy(*keys, "complete").agg(
        F.count(F.lit(1)).alias("analyzed_rows"), F.min(time).alias("window_start"), F.max(time).alias("window_end")
    )
    if baseline is None or not features:
        outcome = NO_REFERENCE if baseline is None else COLUMN_MISMATCH
        decided = windows.withColumn("outcome", F.lit(outcome))
        if baseline is not None:
            decided = windows.withColumn(
                "outcome", F.when(F.col("complete"), COLUMN_MISMATCH).otherwise(INSUFFICIENT_SAMPLES)
            )
        empty = decided.withColumns(
            {
                "drift_share": F.lit(None).cast("double"),
                "drifted_features": F.lit(None).cast("long"),
                "number_of_columns": F.lit(None).cast("long"),
                "dataset_drift": F.lit(False),
                "fired": F.lit(False),
            }
        )
        return PassResult(_finish(empty, keys, config), None)

    tested = drift.compare_windows(
        baseline, cut.where("complete").select(*keys, *features), keys, features, config.tests, rows_per_task
    )
    tested = stage(tested, "drift-features")
    summary = drift.summarise(tested, keys, config.tests).drop("critical_drifted", "no_data_columns")
    joined = order.join_on(windows, summary, keys, "left").fillna(False, subset=["dataset_drift"])
    decided = joined.withColumn(
        "outcome",
        F.when(~F.col("complete"), INSUFFICIENT_SAMPLES)
        .when(F.col("drift_share").isNull(), ANALYSIS_FAILED)
        .when(F.col("dataset_drift"), DRIFT_DETECTED)
        .otherwise(NO_DRIFT),
    )
    decided = stage(decided, "drift-windows")
    breaches = decided.where("dataset_drift").select(*keys, "window_end")
    fired = cooldown.fire(breaches, "window_end", "window_id", config.cooldown_seconds, by, rows_per_task, earlier)
    decided = order.join_on(decided, fired.drop("window_end"), keys, "left").fillna(False, subset=["fired"])
    return PassResult(_finish(decided, keys, config), tested)


def pass_state(windows: DataFrame, by: Sequence[str] = (), earlier: DataFrame | None = None) -> DataFrame:
    """Per stream the number of its next window and when it last fired, for the pass that follows."""
    fired = F.max(F.when(F.col("fired"), F.col("window_end"))).alias("last_fired")
    state = windows.groupBy(*by).agg((F.max("window_id") + 1).alias("next_window"), fired)
    if earlier is None:
        return state
    both = state.unionByName(earlier.select(*state.columns))
    return both.groupBy(*by).agg(F.max("next_window").alias("next_window"), F.max("last_fired").alias("last_fired"))


def _finish(decided: DataFrame, keys: Sequence[str], config: PassConfig) -> DataFrame:
    return decided.select(
        *keys,
        "window_start",
        "window_end",
        "analyzed_rows",
        "drift_share",
        F.lit(config.tests.share_threshold).alias("drift_share_threshold"),
        "drifted_features",
        "number_of_columns",
        "dataset_drift",
        "outcome",
        F.col("outcome").isin(*FAILURES).alias("is_failure"),
        "fired",
    )


def pass_outcome(result: PassResult) -> DataFrame:
    """What the pass as a whole reports: one row, `no_new_logs` when the log was empty."""
    newest = result.windows.agg(
        F.count(F.lit(1)).alias("windows"), F.max_by("outcome", F.struct("window_end", "window_id")).alias("outcome")
    )
    return newest.select("windows", F.coalesce("outcome", F.lit(NO_NEW_LOGS)).alias("outcome"))


def sensitivity(
    baseline: DataFrame,
    current: DataFrame,
    edits: Sequence[Edit],
    strengths: Sequence[float],
    share,
    features: Sequence[str] | None = None,
    config: DriftConfig = DriftConfig(),
) -> DataFrame:
    """Which features are noticed when the edits are applied at several strengths.

    An edit depends on a value, and on a row's share only in so far as it says from which strength on the row is
    overwritten. So the rows are read once and counted per value and such strength; the strengths are applied to
    these counts. Features without an edit are tested once, for all strengths. Each strength is there once, also for
    an empty table (`no_data`).
    """
    features = list(features or drift.common_features(baseline, current))
    strengths = sorted({float(s) for s in strengths})
    by_column = {e.column: e for e in edits if e.column in features and e.column in current.columns}
    edited = [f for f in features if f in by_column]
    shape = apply_edits(current.limit(0), edits, share, 1.0)
    text = drift.text_features(baseline, shape, features)
    # One column per feature, filled in the rows of that feature only: edits find the column they name.
    empty = {f: F.lit(None).cast(current.schema[f].dataType) for f in features}

    def cell(name: str):
        edit = by_column.get(name)
        start = edit.from_strength(share, strengths) if isinstance(edit, Overwrite) else F.lit(None)
        values = [(F.col(f) if f == name else empty[f]).alias(f) for f in features]
        return F.struct(F.lit(name).alias("_of"), start.cast("double").alias("_from"), *values)

    each = current.select(F.inline(F.array(*[cell(f) for f in features])))
    counted = stage(each.groupBy("_of", "_from", *features).agg(F.count(F.lit(1)).alias("_n")), "value-counts")

    each_strength = F.array(*[F.lit(s) for s in strengths])
    needed = F.when(F.col("_of").isin(edited), each_strength).otherwise(F.array(F.lit(strengths[0])))
    # From its strength on a row has a share below, before it one above any that decides.
    turned = F.when(F.col("_from") <= F.col("strength"), F.lit(-1.0)).otherwise(F.lit(float("inf")))
    shifted = apply_edits(counted.withColumn("strength", F.explode(needed)), list(by_column.values()), turned, F.col("strength"))
    cur = stage(drift.value_counts(shifted, features, text, ["strength"], "_n", "_of"), "windows")
    windows = current.sparkSession.createDataFrame([(s,) for s in strengths], "strength double")
    tested = drift.compare_window_counts(baseline, cur, windows, ["strength"], features, text, config)
    is_edited = F.col("feature").isin(edited)
    same = tested.where(~is_edited & (F.col("strength") == strengths[0]))
    copies = same.withColumn("strength", F.explode(each_strength))
    return tested.where(is_edited).unionByName(copies)
