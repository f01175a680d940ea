"""Fit a boosted-tree classifier on a prepared table, score with it, and record the run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import metrics
from tidewatch.operators.prepare import NumberParams, Preparation, SparsePreparation
from tidewatch.plans import boosting
from tidewatch.sources import tables

VECTOR = "prepared_vector"


@dataclass(frozen=True)
class BoostingParams:
    # The defaults of the training configuration.
    rounds: int = 300
    depth: int = 6
    rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    positive_weight: float = 3.0
    patience: int = 20
    seed: int = 42


class SparseFeatures(Transformer, MLWritable, MLReadable):
    """A sparse preparation as a stage; its table is saved with it."""

    def __init__(self, preparation: SparsePreparation):
        super().__init__()
        self.preparation = preparation

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.preparation.transform(dataset, VECTOR)

    def write(self) -> MLWriter:
        return _SparseWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _SparseReader()


class _SparseWriter(MLWriter):
    def __init__(self, stage: SparseFeatures):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        known = self.stage.preparation
        extra = {"numbers": {k: asdict(v) for k, v in known.numbers.items()}, "sizes": known.sizes}
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata=extra)
        known.lookup.write.parquet(f"{path}/lookup")


class _SparseReader(MLReader):
    def load(self, path: str) -> SparseFeatures:
        noted = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        numbers = {k: NumberParams(**v) for k, v in noted["numbers"].items()}
        stage = SparseFeatures(SparsePreparation(numbers, self.sparkSession.read.parquet(f"{path}/lookup"), noted["sizes"]))
        stage._resetUid(noted["uid"])
        return stage


def train(
    rows: DataFrame,
    preparation: Preparation | SparsePreparation,
    target: str,
    params: BoostingParams = BoostingParams(),
    validation: str | None = None,
) -> PipelineModel:
    """Fit preparation and model as one pipeline, so that they are saved and applied together.

    `validation` names a boolean column; its rows only decide which round is kept, so the test rows stay
    unseen: the one of least unweighted log loss. Once `patience` rounds brought no gain, no more are fitted.
    Positive rows carry the weight. Scoring is Spark ML's own, without Python.
    """
    coded, numbers, sizes = preparation.coded(rows, [target, *([validation] if validation else [])])
    grown = boosting.fit(coded, numbers, sizes, params, target, validation)
    if isinstance(preparation, SparsePreparation):
        prepared = [SparseFeatures(preparation)]
    else:
        names = [f"prepared_{i}" for i in range(len(preparation.feature_names))]
        prepared = [SQLTransformer(statement=preparation.sql()), VectorAssembler(inputCols=names, outputCol=VECTOR)]
    model = grown.as_spark(rows.sparkSession)
    model.setFeaturesCol(VECTOR).setPredictionCol("class_prediction")
    model.setRawPredictionCol("raw_prediction").setProbabilityCol("class_probability")
    model._transfer_params_to_java()
    return PipelineModel([*prepared, model])


def rounds_kept(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def hold_out(rows: DataFrame, key: Sequence[str], share: float = 0.1, seed: int = 7, name: str = "is_validation") -> DataFrame:
    """Mark about `share` of the rows, by a hash of their key, to watch training."""
    return rows.withColumn(name, F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(10_007)) < int(share * 10_007))


def score(model: PipelineModel, rows: DataFrame, name: str = "probability") -> DataFrame:
    """The rows with the probability of class 1."""
    scored = model.transform(rows)
    return scored.select(*rows.columns, vector_to_array("class_probability")[1].alias(name))


def score_versions(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """The rows once per version, as (`model_version`, `probability`); the input is scanned once."""
    wide = rows
    for i, model in enumerate(models.values()):
        wide = score(model, wide, f"_score_{i}")
    cells = F.array(
        *[
            F.struct(F.lit(version).alias("model_version"), F.col(f"_score_{i}").alias("probability"))
            for i, version in enumerate(models)
        ]
    )
    return wide.select(*rows.columns, F.inline(cells))


def to_log(
    scored: DataFrame,
    features: Sequence[str],
    request_id: Column,
    created_at: Column,
    version: str,
    threshold: float = 0.5,
    row_id: Column | None = None,
) -> DataFrame:
    """Prediction-log rows, one for each scored row."""
    packed = tables.pack_features(scored, list(features))
    return packed.select(
        (F.uuid() if row_id is None else row_id).alias("id"),
        request_id.cast("string").alias("request_id"),
        "features",
        metrics.decide(F.col("probability"), threshold).alias("prediction"),
        "probability",
        F.lit(version).alias("model_version"),
        F.lit(False).alias("drift_analyzed"),
        created_at.alias("created_at"),
        F.lit(None).cast("int").alias("actual_label"),
        F.lit(None).cast("timestamp").alias("label_received_at"),
    )


def run_summary(
    evaluated: DataFrame, summary: DataFrame, params: BoostingParams, features: Sequence[str] | DataFrame, version: str, kept: int | None = None
) -> DataFrame:
    """One row per training run: parameters, the number of rounds kept, metrics, feature names and row counts."""
    noted = vars(params) | ({} if kept is None else {"rounds_kept": kept})
    listed = [x for k, v in noted.items() for x in (F.lit(k), F.lit(str(v)))]
    names = [x for name in metrics.METRIC_NAMES for x in (F.lit(name), F.col(name).cast("double"))]
    counts = summary.first().asDict()
    if isinstance(features, DataFrame):
        # (position, name) rows; the names meet in the one cell that lists them, not on the driver.
        pairs = F.sort_array(F.collect_list(F.struct("position", "name")))
        evaluated = evaluated.crossJoin(features.agg(F.transform(pairs, lambda x: x["name"]).alias("_names")))
        listed_names = F.col("_names")
    else:
        listed_names = F.array(*[F.lit(f) for f in features])
    return evaluated.select(
        F.lit(version).alias("model_version"),
        F.create_map(*listed).alias("params"),
        F.create_map(*names).alias("metrics"),
        listed_names.alias("features"),
        *[F.lit(v).alias(k) for k, v in counts.items()],
    )
