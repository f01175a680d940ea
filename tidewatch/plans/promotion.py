"""Whether a candidate replaces the live model, decided for many candidates at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import metrics, validate
from tidewatch.session import stage

# The floors every candidate must meet.
FLOORS = {"roc_auc": 0.70, "f1": 0.55, "precision": 0.50}


@dataclass(frozen=True)
class GateConfig:
    auc_gain: float = 0.005
    alpha: float = 0.05
    require_significance: bool = True
    floors: dict[str, float] = field(default_factory=lambda: dict(FLOORS))


def shared_row_metrics(
    scored: DataFrame,
    label: str,
    candidate_score: str = "candidate_score",
    live_score: str = "live_score",
    candidate_threshold: str = "candidate_threshold",
    live_threshold: str = "live_threshold",
    by: Sequence[str] = ("candidate",),
    rows_per_task: int | None = None,
) -> DataFrame:
    """Per candidate: both AUCs on the same rows, and McNemar's discordant counts.

    `scored` holds the label, both scores and both thresholds on every row.
    """
    by = list(by)
    y = F.col(label)
    sides = scored.select(
        *by,
        y.alias("_y"),
        F.inline(
            F.array(
                F.struct(F.lit("candidate").alias("_side"), F.col(candidate_score).alias("_s")),
                F.struct(F.lit("live").alias("_side"), F.col(live_score).alias("_s")),
            )
        ),
    )
    auc = stage(
        metrics.evaluate(sides, "_y", "_s", by=[*by, "_side"], rows_per_task=rows_per_task).select(
            *by, "_side", "roc_auc"
        ),
        "auc",
    )
    wide = auc.groupBy(*by).agg(
        F.max(F.when(F.col("_side") == "candidate", F.col("roc_auc"))).alias("candidate_auc"),
        F.max(F.when(F.col("_side") == "live", F.col("roc_auc"))).alias("live_auc"),
    )
    pairs = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("evaluation_rows"),
        *metrics.discordant_counts(
            y,
            metrics.decide(F.col(candidate_score), F.col(candidate_threshold)),
            metrics.decide(F.col(live_score), F.col(live_threshold)),
        ),
    )
    return wide.join(pairs, by)


def decide(candidates: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:
    """Add every stage's value, `decision` and `reason` to candidate rows.

    Input per candidate: `metrics` (map) as logged; `has_live`; `live_metrics` (map, may be null);
    `evaluated_on` (null when there is no evaluation data); and from the shared rows `candidate_auc`,
    `live_auc`, `b`, `c` (null without evaluation data). A value that is not a number never passes.
    """
    logged = F.try_element_at("metrics", F.lit("roc_auc"))
    live_logged = F.try_element_at("live_metrics", F.lit("roc_auc"))
    with_eval = F.col("evaluated_on").isNotNull()
    rows = candidates.withColumns(
        {
            "violations": validate.floor_violations(F.col("metrics"), config.floors),
            "new_auc": F.when(with_eval, F.col("candidate_auc")).otherwise(logged),
            "old_auc": F.when(with_eval, F.col("live_auc")).otherwise(live_logged),
        }
    ).withColumn("auc_delta", F.col("new_auc") - F.col("old_auc"))
    b = F.when(with_eval, F.coalesce("b", F.lit(0))).otherwise(F.lit(0))
    c = F.when(with_eval, F.coalesce("c", F.lit(0))).otherwise(F.lit(0))
    tested = metrics.mcnemar(rows.withColumns({"b": b, "c": c}), config.alpha)
    tested = tested.withColumnsRenamed({"passed": "significant", "reason": "significance_reason"})
    delta = F.col("auc_delta")
    enough_gain = F.coalesce((delta >= config.auc_gain) & ~F.isnan(delta), F.lit(False))
    stages = [
        (logged.isNull(), "error_no_auc", F.lit("the candidate has no logged AUC")),
        (F.size("violations") > 0, "reject_floor", F.array_join("violations", "; ")),
        (~F.col("has_live"), "accept_first", F.lit("no live model: first deployment")),
        (
            ~with_eval & F.lit(config.require_significance),
            "error_no_evaluation",
            F.lit("evaluation data is required but was not found"),
        ),
        (~with_eval & live_logged.isNull(), "accept_forced", F.lit("the live model has no logged AUC")),
        (
            ~enough_gain,
            "reject_auc",
            F.format_string(f"gain %.4f < {config.auc_gain}", F.coalesce(delta, F.lit(float("nan")))),
        ),
        (
            F.lit(config.require_significance) & ~F.col("significant"),
            "reject_significance",
            F.col("significance_reason"),
        ),
    ]
    decision, reason = F, F
    for condition, code, text in stages:
        decision = decision.when(condition, F.lit(code))
        reason = reason.when(condition, text)
    return tested.withColumns(
        {
            "decision": decision.otherwise("accept"),
            "reason": reason.otherwise(F.format_string("AUC improved by %.4f", delta)),
        }
    )
