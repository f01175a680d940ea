"""Value rules as one array of violation codes per row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.sources import schemas


@dataclass(frozen=True)
class Rule:
    """Allowed texts, or an inclusive range, or an inclusive text length, of one required column."""

    column: str
    allowed: tuple | None = None
    low: float | None = None
    high: float | None = None
    length: tuple[int, int] | None = None

    def code(self) -> Column:
        """The violation code, or null when the value is fine."""
        value = F.col(self.column)
        check = F.when(value.isNull(), F.lit(f"{self.column}:missing"))
        if self.allowed is not None:
            check = check.when(~value.isin(*self.allowed), F.lit(f"{self.column}:not_allowed"))
        if self.length is not None:
            check = check.when(~F.length(value).between(*self.length), F.lit(f"{self.column}:length"))
        if self.low is not None:
            check = check.when(value < self.low, F.lit(f"{self.column}:too_low"))
        if self.high is not None:
            # NaN compares above every number, so it is caught here too.
            check = check.when(value > self.high, F.lit(f"{self.column}:too_high"))
        return check


FEATURE_RULES = [Rule(name, allowed=tuple(values)) for name, values in schemas.ALLOWED.items()] + [
    Rule(name, low=low, high=high) for name, (low, high) in schemas.RANGES.items()
]
LABEL_RULES = [Rule("request_id", length=schemas.REQUEST_ID_LENGTH), Rule("actual_label", allowed=(0, 1))]


def with_violations(df: DataFrame, rules: Sequence[Rule], name: str = "violations") -> DataFrame:
    return df.withColumn(name, F.array_compact(F.array(*[rule.code() for rule in rules])))


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations); both are projections of one scan."""
    checked = with_violations(df, rules)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def floor_violations(metrics: Column, floors: dict[str, float]) -> Column:
    """One text per metric that is missing, not a number, or below its floor."""
    checks = []
    for name, floor in floors.items():
        value = F.try_element_at(metrics, F.lit(name))
        checks.append(
            F.when(value.isNull(), F.lit(f"{name}: no value, {floor} wanted"))
            .when(F.isnan(value), F.lit(f"{name}: not a number, {floor} wanted"))
            .when(value < floor, F.format_string(f"{name}: %.4f, {floor} wanted", value))
        )
    if not checks:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*checks))
