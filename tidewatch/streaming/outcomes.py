"""Late outcomes on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def join_outcomes(log: DataFrame, outcomes: DataFrame, longest_delay: str, lateness: str = "1 hour") -> DataFrame:
    """Each prediction with its outcome, or with null once no outcome can arrive any more.

    `log` has request_id and created_at, `outcomes` request_id, actual_label and received_at. Both
    watermarks and the time bound let Spark drop state older than the longest label delay.
    """
    left = log.withWatermark("created_at", lateness)
    right = outcomes.withColumnRenamed("request_id", "_request").withWatermark("received_at", lateness)
    matched = (
        (F.col("request_id") == F.col("_request"))
        & (F.col("received_at") >= F.col("created_at"))
        & (F.col("received_at") <= F.col("created_at") + F.expr(f"interval {longest_delay}"))
    )
    return left.join(right, matched, "left_outer").drop("_request")


def live_accuracy(joined: DataFrame, length: str = "7 days", slide: str = "1 day", by: str = "model_version") -> DataFrame:
    """Correct and incorrect predictions per sliding window of the prediction's time.

    A row is counted in the one pane of its time; only closed panes are copied into the windows they lie in, so the
    state holds a row per pane and per open window, whatever the number of predictions. `length` should be a
    multiple of `slide`; otherwise the last part of a window is the pane that begins in it.
    """
    right = F.col("prediction") == F.col("actual_label")
    panes = (
        joined.where(F.col("actual_label").isNotNull())
        .groupBy(F.window("created_at", slide).alias("_pane"), by)
        .agg(F.count_if(right).alias("correct"), F.count_if(~right).alias("incorrect"))
    )
    counted = panes.groupBy(F.window("_pane", length, slide).alias("_w"), by).agg(
        F.sum("correct").alias("correct"), F.sum("incorrect").alias("incorrect")
    )
    return counted.select(
        F.col("_w.start").alias("window_start"),
        F.col("_w.end").alias("window_end"),
        by,
        "correct",
        "incorrect",
        (F.col("correct") / (F.col("correct") + F.col("incorrect"))).alias("accuracy"),
    )


LATEST = ["request_id", "actual_label", "received_at", "seq"]


class LatestLabel(StatefulProcessor):
    """Keeps the newest label of a request and emits it whenever it is replaced.

    A request is forgotten once the watermark is `days` beyond its last label, so that the state doesn't
    grow for ever.
    """

    def __init__(self, days: float) -> None:
        self.milliseconds = int(days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "received_at timestamp, seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            top = part.sort_values(["received_at", "seq"]).iloc[-1]
            if best is None or (top["received_at"], top["seq"]) > (best["received_at"], best["seq"]):
                best = top
        known = self.latest.get() if self.latest.exists() else None
        newer = known is None or (best["received_at"].to_pydatetime(), int(best["seq"])) > (known[0], known[1])
        if newer:
            self.latest.update((best["received_at"].to_pydatetime(), int(best["seq"])))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(best["received_at"].timestamp() * 1000) + self.milliseconds)
            yield pd.DataFrame([best[LATEST]])

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_labels(labels: DataFrame, longest_delay_days: int = 365) -> DataFrame:
    """Live view of corrections: a row per request each time a later label replaces the earlier one.

    Request ids may be of any type. Labels later than the longest delay are dropped, and a request without
    labels for as long is forgotten.
    """
    known = labels.select(*LATEST).withWatermark("received_at", f"{longest_delay_days} days")
    return known.groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=LatestLabel(longest_delay_days),
        outputStructType=T.StructType([labels.schema[c] for c in LATEST]),
        outputMode="append",
        timeMode="EventTime",
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """The state store that arbitrary stateful operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
