"""Exact order-dependent operators (running totals, ranks, quantiles, cuts) without one-task windows.

A window that orders a whole key puts that key into one task. Here each key is cut into ordered
buckets first. The bounds come from a hash-selected share of the order values, so they are the same
whenever the plan is evaluated again, and they influence only the balance, never the result: equal
order values always land in the same bucket. Each bucket is ordered on its own and the totals of
the buckets before it are added.

The number of buckets follows the measured size of the largest key; when every key fits into one
task the plan collapses to a single window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import stage

# A key up to this size is ordered by one task; a larger one is cut into buckets of a tenth of it.
ROWS_PER_TASK = 1_000_000
MAX_BUCKETS = 8192
OVERSAMPLE = 8
# Bucket bounds and bucket totals are broadcast only up to this many expected values.
BROADCAST_ROWS = 200_000
# Stands in for the key of a table that is ordered as a whole.
WHOLE = "_whole"


@dataclass(frozen=True)
class Sizes:
    """Row counts of a keyed table: of the largest key, of all keys, and the number of keys."""

    largest: int
    total: int
    keys: int


def keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The frame with a constant key when it has none, so that keyed code serves both."""
    if keys:
        return df, list(keys)
    return df.withColumn(WHOLE, F.lit(0)), [WHOLE]


def measure(df: DataFrame, keys: Sequence[str]) -> Sizes:
    return known_sizes(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "_n")


def known_sizes(per_key: DataFrame, rows: str) -> Sizes:
    """Sizes from a table that already holds the row count of each key."""
    row = per_key.agg(
        F.max(rows).alias("largest"), F.sum(rows).alias("total"), F.count(F.lit(1)).alias("keys")
    ).first()
    return Sizes(row["largest"] or 0, row["total"] or 0, row["keys"] or 0)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null: a null key is a group of its own and must not lose its rows."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def _maybe_broadcast(df: DataFrame, expected_rows: float) -> DataFrame:
    return F.broadcast(df) if expected_rows <= BROADCAST_ROWS else df


def add_bucket(df: DataFrame, keys: Sequence[str], order: Sequence[str], sizes: Sizes, rows_per_task: int) -> DataFrame:
    """Add `_bucket`, increasing with the order columns inside each key.

    The bounds of a key are one array, so a key beyond MAX_BUCKETS buckets is cut into coarse buckets first,
    and each of these into buckets of the wanted size.
    """
    rows = max(1, rows_per_task // 10)
    if sizes.largest <= rows * MAX_BUCKETS:
        return _cut_at_bounds(df, keys, order, sizes, rows)
    coarse = _cut_at_bounds(df, keys, order, sizes, -(-sizes.largest // MAX_BUCKETS)).withColumnRenamed("_bucket", "_coarse")
    within = [*keys, "_coarse"]
    fine = _cut_at_bounds(coarse, within, order, measure(coarse, within), rows)
    wide = F.col("_coarse").cast("long") * F.lit(1 << 32) + F.col("_bucket")
    return fine.withColumn("_bucket", wide).drop("_coarse")


def _cut_at_bounds(df: DataFrame, keys: Sequence[str], order: Sequence[str], sizes: Sizes, rows: int) -> DataFrame:
    """Buckets of about `rows` rows, found by bisection in an array of bounds per key."""
    modulus = max(1, rows // OVERSAMPLE)
    every = OVERSAMPLE if rows >= OVERSAMPLE else max(1, rows)
    key = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    chosen = df.where(F.pmod(F.xxhash64(*order), F.lit(modulus)) == 0)
    bounds = chosen.groupBy(*keys).agg(F.sort_array(F.collect_set(key)).alias("_sorted"))
    bounds = bounds.select(
        *keys, F.filter("_sorted", lambda _, i: i % every == every - 1).alias("_bounds")
    )
    bounds = _maybe_broadcast(bounds, sizes.keys + sizes.total / rows)
    found = join_on(df, bounds, keys, "left").withColumn("_bucket", F.lit(0))
    # Bisection, one projection per probe, so that it stays in generated code. Bounds beyond the last
    # probe only make the last bucket larger.
    probes = (2 * sizes.largest // rows + 2).bit_length()
    for step in (1 << i for i in range(probes - 1, -1, -1)):
        below = F.get("_bounds", F.col("_bucket") + (step - 1)) < key
        found = found.withColumn("_bucket", F.col("_bucket") + F.when(below, step).otherwise(0))
    return found.drop("_bounds")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str],
    previous: str | None = None,
    rows_per_task: int | None = None,
    sizes: Sizes | None = None,
) -> DataFrame:
    """Add inclusive running sums per key in the given order.

    `sums` maps output names to columns. `previous` names an output holding the first order column
    of the row before. The order columns must be unique within a key (collapse ties first, or end
    with an id). `sizes` saves the counting when the caller already knows them.
    """
    rows_per_task = rows_per_task or ROWS_PER_TASK
    columns = df.columns
    df, keys = keyed(df, keys)
    sizes = sizes or measure(df, keys)
    if sizes.largest <= rows_per_task:
        w = Window.partitionBy(*keys).orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = [F.sum(c).over(upto).alias(name) for name, c in sums.items()]
        if previous:
            out.append(F.lag(order[0]).over(w).alias(previous))
        return df.select(*columns, *out)

    bucketed = add_bucket(df, keys, order, sizes, rows_per_task)
    offsets = _bucket_offsets(bucketed, keys, order, sums)
    offsets = _maybe_broadcast(offsets, sizes.keys + sizes.total / rows_per_task * 20)
    # The bucket leads, so that sorting can tell most rows apart by its first column.
    group = ["_bucket", *keys]
    w = Window.partitionBy(*group).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = [
        (F.sum(c).over(upto) + F.coalesce(F.col(f"_before_{name}"), F.lit(0))).alias(name)
        for name, c in sums.items()
    ]
    if previous:
        out.append(F.coalesce(F.lag(order[0]).over(w), F.col("_last")).alias(previous))
    return join_on(bucketed, offsets, group, "left").select(*columns, *out)


def _bucket_offsets(bucketed: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Per bucket, the sums of all buckets before it; one row per bucket."""
    totals = bucketed.groupBy(*keys, "_bucket").agg(
        *[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()],
        F.max(order[0]).alias("_max"),
    )
    w = Window.partitionBy(*keys).orderBy("_bucket")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys,
        "_bucket",
        *[F.sum(f"_sum_{name}").over(before).alias(f"_before_{name}") for name in sums],
        F.lag("_max").over(w).alias("_last"),
        *[F.col(f"_sum_{name}") for name in sums],
    )


def rank_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    rows_per_task: int | None = None,
    sizes: Sizes | None = None,
) -> DataFrame:
    """Add an exact 1-based rank per key; the order must end with a unique id."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_totals(one, keys, order, {name: "_one"}, rows_per_task=rows_per_task, sizes=sizes).drop("_one")


def cut_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    target: Callable[[Column], Column] | DataFrame,
    rows_per_task: int | None = None,
) -> DataFrame:
    """One row per key: the order columns (as `_cut`) of the row whose rank is `target(n)`.

    `target` may also be a table with the keys, `_n` and `_target`.

    Only the keys and order columns are moved, and beyond one task per key only the bucket that
    holds the wanted rank is sorted. Keys whose target is outside 1..n give no row. Also returns
    `_n` (rows of the key) and `_target`.
    """
    rows_per_task = rows_per_task or ROWS_PER_TASK
    wanted_keys = list(keys)
    df, keys = keyed(df, keys)
    slim = df.select(*dict.fromkeys([*keys, *order])).withColumn("_one", F.lit(1).cast("long"))
    if isinstance(target, DataFrame):
        counts = target
    else:
        counts = stage(slim.groupBy(*keys).agg(F.sum("_one").alias("_n")), "key-sizes")
        counts = counts.withColumn("_target", target(F.col("_n")).cast("long"))
    sizes = known_sizes(counts, "_n")
    goals = _maybe_broadcast(counts.select(*keys, "_n", "_target"), sizes.keys)
    if sizes.largest <= rows_per_task:
        w = Window.partitionBy(*keys).orderBy(*order)
        ranked = slim.withColumn("_rank", F.row_number().over(w))
    else:
        bucketed = add_bucket(slim, keys, order, sizes, rows_per_task)
        offsets = _bucket_offsets(bucketed, keys, order, {"rank": "_one"}).withColumn(
            "_before", F.coalesce("_before_rank", F.lit(0))
        )
        wanted = join_on(offsets, goals, keys).where(
            (F.col("_target") > F.col("_before")) & (F.col("_target") <= F.col("_before") + F.col("_sum_rank"))
        ).select(*keys, "_bucket", "_before")
        w = Window.partitionBy("_bucket", *keys).orderBy(*order)
        ranked = join_on(bucketed, _maybe_broadcast(wanted, sizes.keys), [*keys, "_bucket"]).withColumn(
            "_rank", F.row_number().over(w) + F.col("_before")
        )
    return join_on(ranked, goals, keys).where(F.col("_rank") == F.col("_target")).select(
        *wanted_keys, F.struct(*[F.col(c) for c in order]).alias("_cut"), "_n", "_target"
    )


def quantiles(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    count: str,
    probabilities: dict[str, float],
    rows_per_task: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per key from collapsed (value, count) rows."""
    wanted_keys = list(keys)
    counts, keys = keyed(counts, keys)
    w = running_totals(counts, keys, [value], {"_cum": count}, rows_per_task=rows_per_task)
    joined = join_on(w, counts.groupBy(*keys).agg(F.sum(count).alias("_n")), keys)
    aggs, out = [], []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.floor(position), F.ceil(position)
        aggs += [
            F.min(F.when(F.col("_cum") > low, F.col(value))).alias(f"_low_{name}"),
            F.min(F.when(F.col("_cum") > high, F.col(value))).alias(f"_high_{name}"),
        ]
        part = position - low
        out.append(
            (F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * part).alias(name)
        )
    return joined.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs).select(*wanted_keys, *out)
