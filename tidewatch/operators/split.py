"""Exact splits: by time, by class, and into windows of a fixed number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import order
from tidewatch.session import stage


def time_split(
    rows: DataFrame,
    order_by: Sequence[str],
    fraction: float = 0.3,
    min_rows: int = 300,
    by: Sequence[str] = (),
    rows_per_task: int | None = None,
) -> DataFrame:
    """Tag the newest max(1, round(n * fraction)) rows 'evaluation' and the rest 'train'.

    Groups below `min_rows` give no rows. Rounding is half to even. Only the cut row is searched
    for; the rows themselves are tagged in place without a shuffle. `order_by` must end with an id.
    """

    def last_train(n: Column) -> Column:
        held = F.greatest(F.bround(n * fraction, 0), F.lit(1))
        # Rank 1 stands in when every row is held out.
        return F.when(n >= min_rows, F.greatest(n - held, F.lit(1)))

    columns = rows.columns
    rows, by = order.keyed(rows, by)
    # Written once, one row per group: the join can then be chosen by the true size.
    cuts = stage(order.cut_rows(rows, by, order_by, last_train, rows_per_task), "cuts")
    held = F.greatest(F.bround(F.col("_n") * fraction, 0), F.lit(1))
    joined = order.join_on(rows, cuts, by)
    newer = F.struct(*[F.col(c) for c in order_by]) > F.col("_cut")
    part = F.when(newer | (held >= F.col("_n")), "evaluation").otherwise("train")
    return joined.select(*columns, part.alias("part"))


def stratified_split(
    rows: DataFrame,
    target: str,
    key: Sequence[str],
    test_size: float = 0.2,
    seed: int = 42,
    shuffle_key: Column | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Tag ceil(test_size * n) rows 'test', divided over the classes by largest remainder.

    The rows of a class are drawn in the order of a hash of their key, so the draw is the same for
    any partitioning. `shuffle_key` replaces the hash.
    """
    mixed = rows.withColumn("_mix", F.xxhash64(*key, F.lit(seed)) if shuffle_key is None else shuffle_key)
    counts = stage(rows.groupBy(target).agg(F.count(F.lit(1)).alias("_n")), "class-sizes")
    order_by = ["_mix", *key]
    cuts = order.cut_rows(mixed, [target], order_by, test_quotas(counts, target, test_size), rows_per_task)
    inside = F.struct(*[F.col(c) for c in order_by]) <= F.col("_cut")
    joined = order.join_on(mixed, stage(cuts.select(target, "_cut"), "class-cuts"), [target], "left")
    return joined.select(*rows.columns, F.when(inside, "test").otherwise("train").alias("split"))


def test_quotas(counts: DataFrame, target: str, test_size: float) -> DataFrame:
    """How many test rows (`_target`) each class of `_n` rows gives, a null class included.

    Floors of the exact shares, then one more for the largest remainders.
    """
    n = counts.agg(F.sum("_n")).first()[0] or 0
    total = -int(-n * test_size // 1)
    exact = F.lit(total) * F.col("_n") / F.lit(n)
    shares = counts.withColumn("_floor", F.floor(exact)).withColumn("_short", F.col("_floor") - exact)
    shares = stage(order.rank_rows(shares, [], ["_short", target], "_place"), "class-quotas")
    given = shares.agg(F.sum("_floor")).first()[0] or 0
    extra = F.when(F.col("_place") <= total - given, 1).otherwise(0)
    return shares.select(target, "_n", (F.col("_floor") + extra).cast("long").alias("_target"))


def count_windows(
    log: DataFrame,
    order_by: Sequence[str],
    window_size: int,
    min_samples: int = 100,
    by: Sequence[str] = (),
    rows_per_task: int | None = None,
) -> DataFrame:
    """Cut each stream into windows of `window_size` rows, oldest first.

    Adds `window_id` (0-based) and `complete`: the last window of a stream counts only when it has
    at least min(min_samples, window_size) rows; otherwise its rows wait.
    """
    columns = log.columns
    log, by = order.keyed(log, by)
    totals = stage(log.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "stream-sizes")
    sizes = order.known_sizes(totals, "_n")
    joined = order.join_on(order.rank_rows(log, by, order_by, "_rank", rows_per_task, sizes), totals, by)
    window_id = F.floor((F.col("_rank") - 1) / window_size)
    rows_in_window = F.least(F.lit(window_size), F.col("_n") - window_id * window_size)
    return joined.select(
        *columns,
        window_id.alias("window_id"),
        (rows_in_window >= min(min_samples, window_size)).alias("complete"),
    )
