"""Scoring a stream of feature records into the prediction log."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators import validate
from tidewatch.operators.validate import Rule
from tidewatch.plans import training
from tidewatch.sources import tables
from tidewatch.streaming import run


@dataclass(frozen=True)
class ScoringJob:
    """Validate, score valid records into the log, keep invalid ones with their violations.

    `shape` turns valid records, with the model's `probability` if there is a model, into log rows. Both sinks
    are tables of commits (`tables.append_committed`) written from one read of a micro-batch under the batch's
    number, so a batch that comes again adds nothing to a sink that has it and completes the other one.
    """

    rules: Sequence[Rule]
    shape: Callable[[DataFrame], DataFrame]
    log_path: str
    quarantine_path: str
    model: PipelineModel | None = None

    @classmethod
    def with_saved_model(cls, spark: SparkSession, model_path: str, **given) -> ScoringJob:
        """A job that scores with a trained pipeline saved at `model_path`."""
        return cls(model=PipelineModel.load(model_path), **given)

    def sinks(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Log rows and quarantined rows of a batch; also what a batch job over a whole table writes."""
        valid, quarantined = validate.split_valid(records, self.rules)
        return self.shape(training.score(self.model, valid) if self.model else valid), quarantined

    def handle(self, batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            log, quarantined = self.sinks(held)
            tables.append_committed(log, self.log_path, f"batch-{number}")
            tables.append_committed(quarantined, self.quarantine_path, f"batch-{number}")
        finally:
            held.unpersist()

    def start(self, records: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        return run.to_batches(records, self.handle, checkpoint, available_now=available_now)

    def written(self, spark: SparkSession, records: T.StructType) -> tuple[DataFrame, DataFrame]:
        """Both sinks as committed so far, for records of a schema."""
        log, quarantined = self.sinks(spark.createDataFrame([], records))
        return tables.read_committed(spark, self.log_path, log.schema), tables.read_committed(spark, self.quarantine_path, quarantined.schema)
