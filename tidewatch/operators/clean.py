"""Cleaning of the raw training table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_number(column: str) -> Column:
    """Text to double; blanks and anything unparsable become null."""
    return F.col(column).try_cast("double")


def map_target(df: DataFrame, target: str) -> DataFrame:
    """Yes/No text to 1/0; any other text becomes null. A numeric target is left alone."""
    if not isinstance(df.schema[target].dataType, T.StringType):
        return df
    return df.withColumn(target, F.when(F.col(target) == "Yes", 1).when(F.col(target) == "No", 0))


def clean(df: DataFrame, target: str, number: str | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Coerce `number`, map the target, and drop rows where either is null."""
    if number and number in df.columns:
        df = df.withColumn(number, to_number(number)).where(F.col(number).isNotNull())
    df = map_target(df.drop(*drop), target)
    return df.where(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("int"))


def clean_counts(df: DataFrame, target: str, number: str | None = None) -> DataFrame:
    """Row counts before, after and per cleaning step, in one aggregation."""
    good_number = to_number(number).isNotNull() if number and number in df.columns else F.lit(True)
    good_target = map_target(df, target).withColumn("_ok_number", good_number).select(
        "_ok_number", F.col(target).isNotNull().alias("_ok_target")
    )
    ok_number, ok_target = F.col("_ok_number"), F.col("_ok_target")
    return good_target.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(~ok_number).alias("dropped_number"),
        F.count_if(ok_number & ~ok_target).alias("dropped_target"),
        F.count_if(ok_number & ok_target).alias("rows_kept"),
    )


def split_features(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(features, target as integer)."""
    return df.drop(target), df.select(F.col(target).cast("int").alias(target))
