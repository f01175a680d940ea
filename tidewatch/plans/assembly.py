"""Training and evaluation sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import clean, labels, split
from tidewatch.session import stage
from tidewatch.sources import tables


@dataclass(frozen=True)
class Feedback:
    """Labelled production rows: the older ones for training, the newest for evaluation."""

    train: DataFrame
    evaluation: DataFrame


def feedback_rows(
    log: DataFrame,
    outcomes: DataFrame | None,
    target: str,
    order_by: Sequence[str],
    label_order: Sequence[str] = ("received_at",),
    fraction: float = 0.3,
    min_rows: int = 300,
    enabled: bool = True,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Labelled log rows tagged 'train' or 'evaluation' by time; no rows when disabled or too few."""
    labelled = log if outcomes is None else labels.attach_labels(log, outcomes, list(label_order))
    labelled = tables.labelled_rows(labelled).withColumn(target, F.col("actual_label").cast("int"))
    if not enabled:
        return labelled.limit(0).withColumn("part", F.lit(None).cast("string"))
    return split.time_split(labelled, order_by, fraction, min_rows, rows_per_task=rows_per_task)


def as_feedback(tagged: DataFrame) -> Feedback | None:
    """Both parts, or None when there are no rows."""
    if tagged.isEmpty():
        return None
    return Feedback(
        tagged.where("part = 'train'").drop("part"), tagged.where("part = 'evaluation'").drop("part")
    )


def append_feedback(split_rows: DataFrame, feedback: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Older feedback rows join the training side by column name; the test side is untouched.

    Extra feedback columns are ignored; missing ones are an error, raised before any job.
    """
    tables.require_columns(feedback, [*features, target], "labelled production data")
    wanted = [*features, target]
    extra = feedback.select(*wanted, F.lit("train").alias("split"), F.lit(True).alias("from_feedback"))
    base = split_rows.select(*wanted, "split", F.lit(False).alias("from_feedback"))
    return base.unionByName(extra)


@dataclass(frozen=True)
class TrainingSet:
    """Tagged rows (`split`, `from_feedback`), the features, and one summary row."""

    rows: DataFrame
    features: list[str]
    summary: DataFrame


def assemble(
    raw: DataFrame,
    target: str,
    key: str,
    drop: Sequence[str] = (),
    number: str | None = None,
    required: Sequence[str] = (),
    test_size: float = 0.2,
    seed: int = 42,
    shuffle_key: Column | None = None,
    feedback: Feedback | None = None,
    reference_path: str | None = None,
    holdout_path: str | None = None,
    production_holdout_path: str | None = None,
    rows_per_task: int | None = None,
) -> TrainingSet:
    """Check, clean, split, add feedback, summarise, and write what paths are given for."""
    tables.require_columns(raw, required, "raw data")
    # The id is needed for a repeatable split and dropped afterwards.
    cleaned = clean.clean(raw, target, number, [c for c in drop if c != key])
    tagged = split.stratified_split(cleaned, target, [key], test_size, seed, shuffle_key, rows_per_task)
    features = [c for c in cleaned.columns if c not in (target, *drop)]
    if feedback is None:
        rows = tagged.select(*features, target, "split", F.lit(False).alias("from_feedback"))
    else:
        rows = append_feedback(tagged, feedback.train, target, features)
    spark = raw.sparkSession
    wanted = [*features, target]
    rows = stage(rows, "training-set")
    if reference_path:
        tables.write_table(rows.where("split = 'train'").select(*wanted), reference_path)
    if holdout_path:
        tables.write_table(rows.where("split = 'test'").select(*wanted), holdout_path)
    if production_holdout_path:
        tables.write_table(feedback.evaluation if feedback else None, production_holdout_path, spark)
    return TrainingSet(rows, features, split_summary(rows, target))


def split_summary(rows: DataFrame, target: str) -> DataFrame:
    """Rows and class balance per side, and how many rows came from feedback."""
    train, test = F.col("split") == "train", F.col("split") == "test"
    y = F.col(target).cast("double")
    return rows.agg(
        F.count_if(train).alias("n_train"),
        F.count_if(test).alias("n_test"),
        F.avg(F.when(train, y)).alias("positive_rate_train"),
        F.avg(F.when(test, y)).alias("positive_rate_test"),
        F.count_if(F.col("from_feedback")).alias("n_feedback_train"),
    )


def class_balance(rows: DataFrame, target: str, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("positive_rate"))


def choose_evaluation(
    production: DataFrame | None, static: DataFrame | None, target: str, min_rows: int = 50
) -> tuple[DataFrame, str] | None:
    """Recent production rows if there are enough with both classes, else the static holdout, else None."""
    if production is not None:
        seen = production.agg(
            F.count(F.lit(1)).alias("n"),
            F.max((F.col(target) == 1).cast("int")).alias("ones"),
            F.max((F.col(target) == 0).cast("int")).alias("zeros"),
        ).first()
        if seen["n"] >= min_rows and seen["ones"] == 1 and seen["zeros"] == 1:
            return production, "production_holdout"
    return None if static is None else (static, "static_holdout")


def overlap_count(holdout: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """How many holdout rows are also training rows."""
    return holdout.join(train, key, "left_semi").agg(F.count(F.lit(1)).alias("overlap"))
