"""Declarative shifts of a table, to see which of them the drift tests would notice."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import order


@dataclass(frozen=True)
class Scale:
    """Multiply, optionally with an upper limit."""

    column: str
    factor: float
    cap: float | None = None

    def apply(self, share: Column, strength: Column) -> Column:
        scaled = F.col(self.column) * (1 + strength * (self.factor - 1))
        return scaled if self.cap is None else F.least(scaled, F.lit(self.cap))


@dataclass(frozen=True)
class Overwrite:
    """Set a value on a fraction of the rows (all of them by default)."""

    column: str
    value: str
    fraction: float = 1.0

    def apply(self, share: Column, strength: Column) -> Column:
        return F.when(share < strength * self.fraction, F.lit(self.value)).otherwise(F.col(self.column))

    def from_strength(self, share: Column, strengths: Sequence[float]) -> Column:
        """The least of the strengths at which a row of this share is overwritten, else null."""
        return F.array_min(F.array(*[F.when(share < s * self.fraction, F.lit(s)) for s in strengths]))


@dataclass(frozen=True)
class Shrink:
    """Multiply, cut to an integer, and keep at least a floor."""

    column: str
    factor: float
    floor: int = 1

    def apply(self, share: Column, strength: Column) -> Column:
        scaled = F.col(self.column) * (1 + strength * (self.factor - 1))
        return F.greatest(F.lit(self.floor), scaled.cast("int"))


Edit = Scale | Overwrite | Shrink

# The factors, limits and texts of the three levels.
LEVELS: dict[str, list[Edit]] = {
    "none": [],
    "mild": [
        Scale("MonthlyCharges", 1.5),
        Scale("TotalCharges", 1.4),
        Overwrite("Contract", "Month-to-month", 0.3),
    ],
    "severe": [
        Scale("MonthlyCharges", 3.0, cap=199.0),
        Scale("TotalCharges", 3.0),
        Overwrite("Contract", "Two year"),
        Shrink("tenure", 0.1, floor=1),
    ],
}


def hash_share(keys: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) that depends on the row's key only, not on partitioning or order."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_003)) / 1_000_003


def apply_edits(df: DataFrame, edits: Sequence[Edit], share: Column, strength: Column | float = 1.0) -> DataFrame:
    """All edits as one projection; edits of absent columns are skipped."""
    strength = F.lit(float(strength)) if isinstance(strength, (int, float)) else strength
    changed = {}
    for edit in edits:
        if edit.column in df.columns:
            value = edit.apply(share, strength)
            if isinstance(df.schema[edit.column].dataType, T.StringType):
                value = value.cast("string")
            changed[edit.column] = value
    return df.withColumns(changed)


def apply_level(
    df: DataFrame, level: str, keys: Sequence[str], seed: int = 42, levels: dict[str, list[Edit]] | None = None
) -> DataFrame:
    """A named level; an unknown name changes nothing."""
    return apply_edits(df, (levels or LEVELS).get(level, []), hash_share(keys, seed))


def resample(
    df: DataFrame,
    order_by: Sequence[str],
    draws: int,
    seed: int = 42,
    pick: Callable[[Column, int], Column] | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """`draws` rows with replacement, numbered by `draw`.

    Draw i takes the row whose rank is a hash of i, so the sample can be repeated exactly.
    """
    ranked = order.rank_rows(df, [], order_by, "_rank", rows_per_task)
    total = df.count()
    drawn = df.sparkSession.range(draws).withColumnRenamed("id", "draw")
    index = F.pmod(F.xxhash64("draw", F.lit(seed)), F.lit(max(total, 1))) if pick is None else pick(F.col("draw"), total)
    return drawn.withColumn("_rank", index + 1).join(ranked, "_rank").drop("_rank")
