"""Outcomes that arrive after the prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_labels(labels: DataFrame, order: list[str], key: str = "request_id") -> DataFrame:
    """The newest label per request; an aggregation, so re-sent labels collapse before the shuffle."""
    return labels.groupBy(key).agg(
        F.max_by(F.struct("actual_label", F.col(order[0]).alias("label_received_at")), F.struct(*order)).alias("_l")
    ).select(key, "_l.*")


def attach_labels(log: DataFrame, labels: DataFrame, order: list[str], key: str = "request_id") -> DataFrame:
    """Every log row with its newest label, or the label it already had.

    All rows that carry a request id get its label, also when the id was logged twice.
    """
    newest = latest_labels(labels, order, key).withColumnsRenamed(
        {"actual_label": "_label", "label_received_at": "_received"}
    )
    joined = log.join(newest, key, "left")
    kept = [c for c in log.columns if c not in ("actual_label", "label_received_at")]
    old_label = F.col("actual_label") if "actual_label" in log.columns else F.lit(None)
    old_time = F.col("label_received_at") if "label_received_at" in log.columns else F.lit(None)
    return joined.select(
        *kept,
        F.coalesce("_label", old_label).alias("actual_label"),
        F.coalesce("_received", old_time).alias("label_received_at"),
    )


def unknown_labels(labels: DataFrame, log: DataFrame, key: str = "request_id") -> DataFrame:
    """Labels whose request was never logged."""
    return labels.join(log, key, "left_anti")


def labelled_log(log: DataFrame, labels: DataFrame, key: str = "request_id") -> DataFrame:
    """Log rows named in a label batch."""
    return log.join(labels, key, "left_semi")


def label_result(log: DataFrame, labels: DataFrame, key: str = "request_id") -> DataFrame:
    """updated / correct / incorrect / unknown, counted per label sent, before re-sent ones collapse.

    Both sides are aggregated first: labels to (request, label, times sent), the log to one
    prediction per request, so one request labelled very often is one row in the join. Only the rows
    a label names are aggregated: for a small batch that is a scan of the log without a shuffle.
    """
    sent = labels.groupBy(key, "actual_label").agg(F.count(F.lit(1)).alias("sent"))
    named = labelled_log(log.select(key, "prediction"), sent.select(key), key)
    predicted = named.groupBy(key).agg(F.max("prediction").alias("prediction"))
    joined = sent.join(predicted, key, "left")
    known = F.col("prediction").isNotNull()
    right = F.col("prediction") == F.col("actual_label")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("sent"))), F.lit(0)).cast("long")

    return joined.agg(
        total(known).alias("updated"),
        total(known & right).alias("correct"),
        total(known & ~right).alias("incorrect"),
        total(~known).alias("unknown"),
    )


def live_accuracy(labelled: DataFrame, time: str, length: str, slide: str, by: list[str]) -> DataFrame:
    """Correct and incorrect outcomes and their ratio per sliding window.

    Rows are first counted per slide, so each row is not copied into every window it falls in;
    only the counts are.
    """
    known = labelled.where(F.col("actual_label").isNotNull())
    right = F.col("prediction") == F.col("actual_label")
    steps = known.groupBy(F.window(time, slide).alias("_step"), *by).agg(
        F.count_if(right).alias("correct"), F.count_if(~right).alias("incorrect")
    )
    spans = steps.withColumn("_at", F.col("_step.start")).groupBy(F.window("_at", length, slide).alias("_w"), *by).agg(
        F.sum("correct").alias("correct"), F.sum("incorrect").alias("incorrect")
    )
    return spans.select(
        F.col("_w.start").alias("window_start"),
        F.col("_w.end").alias("window_end"),
        *by,
        "correct",
        "incorrect",
        (F.col("correct") / (F.col("correct") + F.col("incorrect"))).alias("accuracy"),
    )


def unanalysed(log: DataFrame, ledger: DataFrame, key: str = "id") -> DataFrame:
    """Log rows not in the ledger of analysed ids."""
    return log.join(ledger, key, "left_anti")
