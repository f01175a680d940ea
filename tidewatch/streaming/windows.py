"""Drift on streams: windows of a fixed number of rows, and windows of event time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import drift, split
from tidewatch.operators.drift import DriftConfig
from tidewatch.plans import drift_pass as passes
from tidewatch.session import stage, temporary_tables
from tidewatch.sources import tables


@dataclass(frozen=True)
class CountWindowDrift:
    """A `foreachBatch` handler: rows wait until a window is large enough, then are tested.

    Everything a batch writes lies under its batch id and is overwritten when the batch is repeated:
    first the result, then the ledger of analysed ids, the number of the next window and the last firing
    of each stream, and last the rows still waiting, which the next batch starts from. A failure in between leaves the previous waiting rows in place, so no window is
    lost and none is counted twice.
    """

    baseline: DataFrame
    path: str
    features: Sequence[str]
    order_by: Sequence[str] = ("created_at", "id")
    by: Sequence[str] = ()
    config: passes.PassConfig = passes.PassConfig()

    def _at(self, kind: str, batch_id: int) -> str:
        return f"{self.path}/{kind}/batch={batch_id}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with temporary_tables(batch.sparkSession):
            self._run(batch, batch_id)

    def _run(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = list(dict.fromkeys([*self.by, *self.order_by, *self.features]))
        rows = batch.select(*columns)
        waiting = tables.read_table(spark, self._at("waiting", batch_id - 1)) if batch_id > 0 else None
        earlier = tables.read_table(spark, self._at("state", batch_id - 1)) if batch_id > 0 else None
        if waiting is not None:
            rows = rows.unionByName(waiting)
        cut = stage(
            split.count_windows(rows, self.order_by, self.config.window_size, self.config.min_samples, self.by), "pending"
        )
        ready = cut.where("complete")
        if not ready.isEmpty():
            result = passes.drift_pass(
                self.baseline, ready, self.order_by, self.by, self.features, self.config, earlier=earlier
            )
            result.windows.write.mode("overwrite").parquet(self._at("windows", batch_id))
            if result.features is not None:
                result.features.write.mode("overwrite").parquet(self._at("features", batch_id))
            ready.select(*self.by, self.order_by[-1]).write.mode("overwrite").parquet(self._at("ledger", batch_id))
            done = spark.read.parquet(self._at("windows", batch_id))
            passes.pass_state(done, self.by, earlier).write.mode("overwrite").parquet(self._at("state", batch_id))
        elif earlier is not None:
            earlier.write.mode("overwrite").parquet(self._at("state", batch_id))
        cut.where("not complete").select(*columns).write.mode("overwrite").parquet(self._at("waiting", batch_id))

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        """All results of a kind (`windows`, `features`, `ledger`), with the batch they came from."""
        return spark.read.parquet(f"{self.path}/{kind}")


@dataclass(frozen=True)
class EventTimeDrift:
    """A `foreachBatch` handler for closed (window, feature, value) counts."""

    baseline: DataFrame
    path: str
    features: Sequence[str]
    text: frozenset[str]
    config: DriftConfig = DriftConfig()

    def __call__(self, counts: DataFrame, batch_id: int) -> None:
        with temporary_tables(counts.sparkSession):
            self._run(counts, batch_id)

    def _run(self, counts: DataFrame, batch_id: int) -> None:
        closed = stage(counts, "closed-counts")
        tested = drift.compare_window_counts(
            self.baseline,
            closed,
            closed.select("window_start").distinct(),
            ["window_start"],
            self.features,
            set(self.text),
            self.config,
        )
        tested.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("batch")
