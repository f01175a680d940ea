"""Two-sample drift tests for every feature of a table in one job.

Both entry points first collapse the rows to (feature, value) counts with map-side partial
aggregation, write those counts once, and do all ordering on distinct values only.

* `compare` tests a baseline against a current table, optionally per group, where each group has
  its own baseline.
* `compare_windows` tests one baseline against many windows of current data. The baseline is never
  copied per window: each window looks its own values up in the baseline's distribution, so the
  work grows with baseline plus current and not with their product.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import tails
from tidewatch.operators import order
from tidewatch.session import stage

KS = "ks"
CHI_SQUARE = "chi_square"
Z_TEST = "z_test"
WASSERSTEIN = "wasserstein"
JENSEN_SHANNON = "jensen_shannon"

# Baseline values per slice of the quantile function.
SLICE_ROWS = 2000
# One value of one feature: numbers in `num`, everything else in `txt`.
CELL = ["feature", "is_num", "num", "txt"]


@dataclass(frozen=True)
class DriftConfig:
    """Thresholds and test choice. `tests` overrides the automatic choice per feature."""

    p_threshold: float = 0.05
    distance_threshold: float = 0.05
    share_threshold: float = 0.3
    small_baseline: int = 1000
    few_values: int = 5
    tests: dict[str, str] = field(default_factory=dict)
    critical: tuple[str, ...] = ()


def common_features(baseline: DataFrame, current: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns present on both sides, in the order of the baseline."""
    present = set(current.columns)
    return [c for c in baseline.columns if c in present and c not in set(exclude)]


def _is_text(df: DataFrame, name: str) -> bool:
    return not isinstance(df.schema[name].dataType, T.NumericType)


def _long(df: DataFrame, features: Sequence[str], text: set[str], by: Sequence[str]) -> DataFrame:
    """One row per feature value; nulls and non-finite numbers are left out."""
    cells = []
    for name in features:
        if name in text:
            number, string = F.lit(0.0), F.col(name).cast("string")
        else:
            raw = F.col(name).cast("double")
            number, string = F.when(F.abs(raw) < float("inf"), raw), F.lit("")
        cells.append(
            F.struct(
                F.lit(name).alias("feature"),
                F.lit(name not in text).alias("is_num"),
                number.alias("num"),
                string.alias("txt"),
            )
        )
    return df.select(*by, F.inline(F.array(*cells))).where(F.col("num").isNotNull() & F.col("txt").isNotNull())


def text_features(baseline: DataFrame, current: DataFrame, features: Sequence[str]) -> set[str]:
    return {c for c in features if _is_text(baseline, c) or _is_text(current, c)}


def choose_test(config: DriftConfig, feature: Column, is_num: Column, n_ref: Column, n_values: Column) -> Column:
    """The test for a feature, from its kind, the baseline's size and the number of values."""
    small = n_ref <= config.small_baseline
    ordered = is_num & (n_values > config.few_values)
    auto = (
        F.when(small & ordered, KS)
        .when(small & (n_values > 2), CHI_SQUARE)
        .when(small, Z_TEST)
        .when(ordered, WASSERSTEIN)
        .otherwise(JENSEN_SHANNON)
    )
    for name, test in config.tests.items():
        auto = F.when(feature == name, F.lit(test)).otherwise(auto)
    return auto


def _is_ordered_test(test: Column) -> Column:
    return test.isin(KS, WASSERSTEIN)


def _verdict(df: DataFrame, keys: Sequence[str], config: DriftConfig) -> DataFrame:
    """Add p-value, threshold, flag and status to rows holding n_ref, n_cur, test and statistic."""
    has_data = (F.col("n_ref") > 0) & (F.col("n_cur") > 0)
    statistic = F.when(has_data, F.col("statistic"))
    test = F.col("test")
    p = (
        F.when(test == KS, tails.ks_tail("statistic", "n_ref", "n_cur"))
        .when((test == CHI_SQUARE) & (F.col("unexpected") > 0), F.lit(0.0))
        .when((test == CHI_SQUARE) & (F.col("n_values") < 2), F.lit(1.0))
        .when(test == CHI_SQUARE, tails.chi2_tail("statistic", "(n_values - 1)"))
        .when(test == Z_TEST, tails.normal_two_sided("statistic"))
    )
    is_distance = test.isin(WASSERSTEIN, JENSEN_SHANNON)
    threshold = F.when(is_distance, F.lit(config.distance_threshold)).otherwise(F.lit(config.p_threshold))
    out = df.select(
        *keys,
        F.when(F.col("is_num"), "num").otherwise("cat").alias("kind"),
        "n_ref",
        "n_cur",
        "n_values",
        F.when(has_data, test).alias("test"),
        statistic.alias("statistic"),
        F.when(has_data, p).alias("p_value"),
        threshold.alias("threshold"),
        F.when(has_data, "ok").otherwise("no_data").alias("status"),
        F.col("feature").isin(*config.critical).alias("critical") if config.critical else F.lit(False).alias("critical"),
    )
    fires = F.when(F.col("p_value").isNull(), F.col("statistic") >= F.col("threshold")).otherwise(
        F.col("p_value") < F.col("threshold")
    )
    return out.withColumn("drifted", F.coalesce(fires, F.lit(False)))


def _z_statistic(r1: Column, n: Column, o1: Column, m: Column) -> Column:
    """Pooled two-proportion z for the share of one of the two values."""
    pooled = (r1 + o1) / (n + m)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    return F.when(spread > 0, (r1 / n - o1 / m) / spread).otherwise(F.lit(0.0))


def _entropy_term(p: Column, q: Column) -> Column:
    return F.when(p > 0, p * F.ln(2 * p / (p + q))).otherwise(F.lit(0.0))


def compare(
    baseline: DataFrame,
    current: DataFrame,
    features: Sequence[str] | None = None,
    by: Sequence[str] = (),
    config: DriftConfig = DriftConfig(),
    rows_per_task: int | None = None,
) -> DataFrame:
    """Per (group and) feature: the test, its statistic and whether the feature drifted."""
    by = list(by)
    features = list(features or common_features(baseline, current, by))
    text = text_features(baseline, current, features)
    keys = [*by, "feature"]
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = (
        _long(baseline, features, text, by)
        .select("*", one.alias("r"), zero.alias("o"))
        .unionByName(_long(current, features, text, by).select("*", zero.alias("r"), one.alias("o")))
    )
    counts = stage(
        both.groupBy(*keys, "is_num", "num", "txt").agg(F.sum("r").alias("r"), F.sum("o").alias("o")), "counts"
    )
    profile = counts.groupBy(*keys, "is_num").agg(
        F.sum("r").alias("n_ref"),
        F.sum("o").alias("n_cur"),
        F.count(F.lit(1)).alias("n_values"),
        F.try_divide(F.sum(F.col("r") * F.col("num")), F.sum("r")).alias("mean_ref"),
    )
    profile = stage(
        profile.withColumn(
            "test", choose_test(config, F.col("feature"), F.col("is_num"), F.col("n_ref"), F.col("n_values"))
        ),
        "profile",
    )
    tested = order.join_on(counts.drop("is_num"), profile.where("n_ref > 0 and n_cur > 0"), keys)

    ordered = order.running_totals(
        tested.where(_is_ordered_test(F.col("test"))),
        keys,
        ["num"],
        {"cum_r": "r", "cum_o": "o"},
        previous="before",
        rows_per_task=rows_per_task,
        sizes=order.known_sizes(profile.where(_is_ordered_test(F.col("test"))), "n_values"),
    )
    n, m = F.col("n_ref"), F.col("n_cur")
    gap = F.abs(F.col("cum_r") / n - F.col("cum_o") / m)
    gap_before = F.abs((F.col("cum_r") - F.col("r")) / n - (F.col("cum_o") - F.col("o")) / m)
    area = gap_before * (F.col("num") - F.col("before"))
    variance = F.sum(F.col("r") * F.pow(F.col("num") - F.col("mean_ref"), F.lit(2))) / F.first(n)
    numeric = ordered.groupBy(*keys).agg(
        F.when(F.first("test") == KS, F.max(gap))
        .otherwise(F.coalesce(F.sum(area), F.lit(0.0)) / F.greatest(F.sqrt(variance), F.lit(0.001)))
        .alias("statistic"),
        F.lit(0).cast("long").alias("unexpected"),
    )

    r, o = F.col("r"), F.col("o")
    expected = r * m / n
    categories = tested.where(~_is_ordered_test(F.col("test")))
    lowest = F.min_by(F.struct("r", "o"), F.struct("num", "txt"))
    sums = categories.groupBy(*keys).agg(
        F.first("test").alias("test"),
        F.first(n).alias("n"),
        F.first(m).alias("m"),
        F.sum(F.when(r > 0, F.pow(o - expected, F.lit(2)) / expected)).alias("chi"),
        F.sum(F.when(r == 0, o).otherwise(F.lit(0))).alias("unexpected"),
        F.sum((_entropy_term(r / n, o / m) + _entropy_term(o / m, r / n)) / 2).alias("js"),
        F.count(F.lit(1)).alias("values"),
        lowest.alias("low"),
    )
    categorical = sums.select(
        *keys,
        F.when(F.col("test") == CHI_SQUARE, F.col("chi"))
        .when(
            F.col("test") == Z_TEST,
            F.when(F.col("values") < 2, F.lit(0.0)).otherwise(
                F.abs(_z_statistic(F.col("low.r"), F.col("n"), F.col("low.o"), F.col("m")))
            ),
        )
        .otherwise(F.sqrt(F.greatest(F.col("js"), F.lit(0.0))))
        .alias("statistic"),
        "unexpected",
    )
    scored = order.join_on(profile, numeric.unionByName(categorical), keys, "left")
    return _verdict(_with_silent_features(scored, baseline, current, features, text, by), keys, config)


def _with_silent_features(
    scored: DataFrame, baseline: DataFrame, current: DataFrame, features: Sequence[str], text: set[str], by: Sequence[str]
) -> DataFrame:
    """Add a row for features that have no value at all, so that they count as columns."""
    listed = F.inline(
        F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(f not in text).alias("is_num")) for f in features])
    )
    if by:
        groups = baseline.select(*by).unionByName(current.select(*by)).distinct()
        wanted = groups.select(*by, listed)
    else:
        wanted = current.sparkSession.range(1).select(listed)
    return order.join_on(wanted, scored.drop("is_num"), [*by, "feature"], "left").fillna(
        0, subset=["n_ref", "n_cur", "n_values", "unexpected"]
    )


def compare_windows(
    baseline: DataFrame,
    current: DataFrame,
    by: Sequence[str],
    features: Sequence[str] | None = None,
    config: DriftConfig = DriftConfig(),
    rows_per_task: int | None = None,
) -> DataFrame:
    """`compare` for every window (the values of `by`) of `current` against one baseline."""
    by = list(by)
    features = list(features or common_features(baseline, current, by))
    text = text_features(baseline, current, features)
    cur = stage(_long(current, features, text, by).groupBy(*by, *CELL).agg(F.count(F.lit(1)).alias("o")), "windows")
    return compare_window_counts(
        baseline, cur, current.select(*by).distinct(), by, features, text, config, rows_per_task
    )


def window_counts(current: DataFrame, features: Sequence[str], text: set[str], by: Sequence[str | Column]) -> DataFrame:
    """(window, feature, value) counts: the only aggregation a stream has to keep for `compare_window_counts`."""
    names = [c for c in current.columns if c not in features]
    return _long(current, features, text, names).groupBy(*by, *CELL).agg(F.count(F.lit(1)).alias("o"))


def value_counts(
    counted: DataFrame, features: Sequence[str], text: set[str], by: Sequence[str], times: str, of: str
) -> DataFrame:
    """`window_counts` of rows that stand for `times` rows each and hold a value of the feature named in `of`."""
    cells = _long(counted, features, text, [*by, times, of]).where(F.col("feature") == F.col(of))
    return cells.groupBy(*by, *CELL).agg(F.sum(times).alias("o"))


def compare_window_counts(
    baseline: DataFrame,
    cur: DataFrame,
    windows: DataFrame,
    by: Sequence[str],
    features: Sequence[str],
    text: set[str],
    config: DriftConfig = DriftConfig(),
    rows_per_task: int | None = None,
) -> DataFrame:
    """`compare_windows` for current rows already collapsed to (window, feature, value, o) counts."""
    cell, keys = CELL, [*by, "feature"]
    ref = stage(_long(baseline, features, text, []).groupBy(*cell).agg(F.count(F.lit(1)).alias("r")), "baseline")

    # Position of every value seen on either side within the baseline's distribution.
    seen = ref.unionByName(cur.select(*cell, F.lit(0).cast("long").alias("r")))
    seen = stage(seen.groupBy(*cell).agg(F.sum("r").alias("r")), "values")
    placed = order.running_totals(
        seen.where("is_num").withColumn("rv", F.col("r") * F.col("num")),
        ["feature"],
        ["num"],
        {"cum_r": "r", "cum_s": "rv"},
        rows_per_task=rows_per_task,
    ).drop("rv")
    lookup = stage(placed.unionByName(seen.where("not is_num"), allowMissingColumns=True), "positions")
    placed = lookup.where("is_num and r > 0")
    ref_profile = _baseline_profile(ref)

    # Numbers first: sorting for the join then compares by them and not by long equal prefixes.
    looked = stage(cur.join(lookup, ["num", "txt", "feature", "is_num"]), "looked")
    profile = looked.groupBy(*keys, "is_num").agg(
        F.sum("o").alias("n_cur"),
        F.count(F.lit(1)).alias("cur_values"),
        F.sum((F.col("r") == 0).cast("long")).alias("new_values"),
    )
    profile = profile.join(ref_profile, "feature", "left").fillna(0, subset=["n_ref", "ref_values"])
    profile = profile.withColumn("n_values", F.col("ref_values") + F.col("new_values"))
    profile = stage(
        profile.withColumn(
            "test", choose_test(config, F.col("feature"), F.col("is_num"), F.col("n_ref"), F.col("n_values"))
        ),
        "window-profile",
    )
    tested = order.join_on(looked.drop("is_num"), profile.where("n_ref > 0"), keys)
    n, m, r, o = F.col("n_ref"), F.col("n_cur"), F.col("r"), F.col("o")

    ordered = order.running_totals(
        tested.where(_is_ordered_test(F.col("test"))),
        keys,
        ["num"],
        {"cum_o": "o"},
        rows_per_task=rows_per_task,
        sizes=order.known_sizes(profile.where(_is_ordered_test(F.col("test"))), "cur_values"),
    )
    ordered = stage(
        ordered.select(*keys, "test", "n_ref", "n_cur", "num", "r", "o", "cum_r", "cum_s", "cum_o"), "ordered"
    )
    gap = F.abs(F.col("cum_r") / n - F.col("cum_o") / m)
    gap_before = F.abs((F.col("cum_r") - r) / n - (F.col("cum_o") - o) / m)
    zero = F.lit(0).cast("long").alias("unexpected")
    ks = ordered.where(F.col("test") == KS).groupBy(*keys).agg(
        F.max(F.greatest(gap, gap_before)).alias("statistic"), zero
    )
    distance = _window_wasserstein(
        ordered.where(F.col("test") == WASSERSTEIN), placed, ref_profile, keys, rows_per_task
    ).withColumn("unexpected", F.lit(0).cast("long"))

    # Baseline categories missing from a window contribute through totals, so they need no rows.
    expected = r * m / n
    known = r > 0
    sums = tested.where(~_is_ordered_test(F.col("test"))).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("test", "n_ref", "n_cur", "n_values", "ref_values")],
        F.sum(F.when(known, F.pow(o - expected, F.lit(2)) / expected)).alias("chi"),
        F.sum(F.when(known, r).otherwise(F.lit(0))).alias("covered"),
        F.sum(F.when(known, F.lit(0)).otherwise(o)).alias("unexpected"),
        F.sum((_entropy_term(r / n, o / m) + _entropy_term(o / m, r / n)) / 2).alias("js"),
        F.min_by(F.struct("r", "o"), F.struct("num", "txt")).alias("low"),
        F.count(F.lit(1)).alias("present"),
    )
    absent = (n - F.col("covered")) / n
    categorical = sums.select(
        *keys,
        F.when(F.col("test") == CHI_SQUARE, F.coalesce(F.col("chi"), F.lit(0.0)) + absent * m)
        .when(
            F.col("test") == Z_TEST,
            F.when(F.col("n_values") < 2, F.lit(0.0)).otherwise(
                F.abs(_z_statistic(F.col("low.r"), n, F.col("low.o"), m))
            ),
        )
        .otherwise(F.sqrt(F.greatest(F.col("js") + absent * F.ln(F.lit(2.0)) / 2, F.lit(0.0))))
        .alias("statistic"),
        "unexpected",
    )
    stats = ks.unionByName(distance).unionByName(categorical)
    scored = order.join_on(profile, stats, keys, "left").drop("is_num", "n_ref")

    listed = F.inline(
        F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(f not in text).alias("is_num")) for f in features])
    )
    wanted = windows.select(*by, listed)
    full = order.join_on(wanted, scored, keys, "left").join(ref_profile.select("feature", "n_ref"), "feature", "left")
    full = full.fillna(0, subset=["n_ref", "n_cur", "n_values", "unexpected"])
    return _verdict(full, keys, config)


def _baseline_profile(ref: DataFrame) -> DataFrame:
    """Size, number of values, mean and deviation of each baseline feature.

    One row per feature, so it passes through the driver and later joins need no shuffle.
    """
    shape = ref.groupBy("feature").agg(
        F.sum("r").alias("n_ref"),
        F.count(F.lit(1)).alias("ref_values"),
        F.try_divide(F.sum(F.col("r") * F.col("num")), F.sum("r")).alias("mean_ref"),
    )
    spark = ref.sparkSession
    shape = spark.createDataFrame(shape.toArrow(), shape.schema)
    spread = ref.join(F.broadcast(shape), "feature").groupBy("feature").agg(
        F.sqrt(F.sum(F.col("r") * F.pow(F.col("num") - F.col("mean_ref"), F.lit(2))) / F.first("n_ref")).alias("std_ref")
    )
    spread = spark.createDataFrame(spread.toArrow(), spread.schema)
    return F.broadcast(shape.join(F.broadcast(spread), "feature"))


def _window_wasserstein(
    ordered: DataFrame, placed: DataFrame, ref_profile: DataFrame, keys: Sequence[str], rows_per_task: int | None
) -> DataFrame:
    """Normalised Wasserstein distance of each window, without copying the baseline per window.

    In quantile form the distance is the integral over u of |Q_ref(u) - Q_cur(u)|. A window's value v
    with shares (a, b] contributes the integral of |Q_ref(u) - v|, and Q_ref crosses v at F_ref(v), so with
    H(u) = integral of Q_ref up to u only H(a), H(b) and H(F_ref(v)) are needed. The last one is the
    baseline's running sum at v; the others are looked up by level.
    """
    n, m, v = F.col("n_ref"), F.col("n_cur"), F.col("num")
    a, b = (F.col("cum_o") - F.col("o")) / m, F.col("cum_o") / m
    at = F.col("cum_r") / n
    # Per value: constant + weight_a * H(a) + weight_b * H(b).
    below, above = at <= a, at >= b
    constant = (
        F.when(below, v * (a - b)).when(above, v * (b - a)).otherwise(v * (2 * at - a - b) - 2 * F.col("cum_s") / n)
    )
    weight_a = F.when(below, F.lit(-1.0)).otherwise(F.lit(1.0))
    weight_b = F.when(above, F.lit(-1.0)).otherwise(F.lit(1.0))
    terms = ordered.select(
        *keys,
        F.inline(
            F.array(
                F.struct(a.alias("level"), weight_a.alias("weight"), F.lit(0.0).alias("constant")),
                F.struct(b.alias("level"), weight_b.alias("weight"), constant.alias("constant")),
            )
        ),
    ).where("level > 0")
    heights = _quantile_integral(placed, ref_profile, terms.select("feature", "level").distinct(), rows_per_task)
    scale = F.greatest(F.col("std_ref"), F.lit(0.001))
    return (
        terms.join(heights, ["level", "feature"])
        .groupBy(*keys)
        .agg(F.sum(F.col("constant") + F.col("weight") * F.col("height")).alias("area"))
        .join(ref_profile.select("feature", "std_ref"), "feature")
        .select(*keys, (F.greatest(F.col("area"), F.lit(0.0)) / scale).alias("statistic"))
    )


def _quantile_integral(placed: DataFrame, ref_profile: DataFrame, levels: DataFrame, rows_per_task: int | None) -> DataFrame:
    """H(level) for each (feature, level): the integral of the baseline's quantile function.

    Levels are cut into equal slices; a baseline value is present in every slice its share touches, so
    each slice answers its levels alone.
    """
    levels = stage(levels, "levels")
    # Whichever side is larger decides; slices cost nothing to assign, and narrow ones sort faster than wide ones.
    largest = max(order.measure(placed, ["feature"]).largest, order.measure(levels, ["feature"]).largest)
    slices = max(1, largest // min(rows_per_task or SLICE_ROWS, SLICE_ROWS))

    def slice_of(level: Column) -> Column:
        return F.least(F.floor(level * slices), F.lit(slices - 1)).cast("int")

    steps = placed.join(ref_profile.select("feature", "n_ref"), "feature").select(
        "feature",
        (F.col("cum_r") / F.col("n_ref")).alias("level"),
        ((F.col("cum_r") - F.col("r")) / F.col("n_ref")).alias("_from"),
        F.struct(
            (F.col("cum_r") / F.col("n_ref")).alias("top"),
            F.col("num").alias("v"),
            (F.col("cum_s") / F.col("n_ref")).alias("h"),
        ).alias("step"),
    )
    steps = steps.withColumn("slice", F.explode(F.sequence(slice_of(F.col("_from")), slice_of(F.col("level"))))).drop("_from")
    asked = levels.withColumn("slice", slice_of(F.col("level")))
    merged = steps.unionByName(asked, allowMissingColumns=True)
    # Descending, baseline first on ties: the last step seen is the lowest one reaching the level.
    w = (
        Window.partitionBy("slice", "feature")
        .orderBy(F.col("level").desc(), F.col("step").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = merged.withColumn("hit", F.last("step", ignorenulls=True).over(w)).where("step is null")
    return found.select(
        "feature", "level", (F.col("hit.h") - F.col("hit.v") * (F.col("hit.top") - F.col("level"))).alias("height")
    )


def summarise(per_feature: DataFrame, by: Sequence[str] = (), config: DriftConfig = DriftConfig()) -> DataFrame:
    """Per group: the observed share of drifted features and whether it reaches the threshold."""
    drifted = F.col("drifted").cast("long")
    grouped = per_feature.groupBy(*by).agg(
        F.avg(drifted.cast("double")).alias("drift_share"),
        F.sum(drifted).alias("drifted_features"),
        F.count(F.lit(1)).alias("number_of_columns"),
        F.sum((F.col("drifted") & F.col("critical")).cast("long")).alias("critical_drifted"),
        F.sum((F.col("status") == "no_data").cast("long")).alias("no_data_columns"),
    )
    return grouped.withColumn("dataset_drift", F.col("drift_share") >= config.share_threshold)
