"""Training and scoring. Boosted trees have no SQL twin, so these are checked by rows and by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog import Registry, tidy, views
from tidewatch.operators import metrics, prepare, split
from tidewatch.plans import assembly, promotion, training

QUERIES = Registry()

PARAMS = training.BoostingParams()
NUMBERS = ["o_totalprice", "day"]
CATEGORIES = ["o_orderpriority", "c_mktsegment"]
TARGET = "is_open"
KEY = ["o_orderkey"]


def order_rows(spark, sf):
    """Orders with their customer's segment; the target depends on price, day and priority."""
    o = views.table(spark, sf, "orders").join(
        views.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left"
    )
    day = F.dayofyear("o_orderdate")
    signal = F.col("o_totalprice") / 400_000 + day / 366 + F.when(F.col("o_orderpriority") == "1-URGENT", 0.5).otherwise(0.0)
    return o.select(
        "o_orderkey", "o_orderdate", "o_totalprice", day.alias("day"), "o_orderpriority", "c_mktsegment", (signal > 1.2).cast("int").alias(TARGET)
    )


def fitted(spark, sf, numbers=NUMBERS, categories=CATEGORIES, params=PARAMS, rows=None):
    """Split (unless given tagged rows), prepare and train; returns the tagged rows and the model."""
    rows = split.stratified_split(order_rows(spark, sf), TARGET, KEY) if rows is None else rows
    train = training.hold_out(rows.where("split = 'train'"), KEY)
    preparation = prepare.fit_sparse(train.where("not is_validation"), numbers, categories)
    return rows, preparation, training.train(train, preparation, TARGET, params, validation="is_validation")


@QUERIES.add()
def train_and_evaluate(spark, sf):
    """One run-summary row: parameters, metrics on unseen rows, features, counts."""
    rows, preparation, model = fitted(spark, sf)
    scored = training.score(model, rows.where("split = 'test'"))
    summary = assembly.split_summary(rows.withColumn("from_feedback", F.lit(False)), TARGET)
    out = training.run_summary(
        metrics.evaluate(scored, TARGET, "probability"), summary, PARAMS, preparation.names(), "v1", training.rounds_kept(model)
    )
    listed = [F.array_join(F.transform(F.array_sort(F.map_keys(c)), lambda k: F.concat_ws("=", k, F.col(c)[k].cast("string"))), ";").alias(c) for c in ("params", "metrics")]
    return out.select("model_version", *listed, F.array_join("features", ";").alias("features"), *[c for c in out.columns if c.startswith("n_")])


@QUERIES.add()
def batch_scoring_to_log(spark, sf):
    """Score every order with the trained pipeline and shape the result as log rows."""
    rows, _, model = fitted(spark, sf)
    scored = training.score(model, rows)
    log = training.to_log(
        scored, [*NUMBERS, *CATEGORIES], F.col("o_orderkey"), F.col("o_orderdate"), "v1", row_id=F.col("o_orderkey").cast("string")
    )
    return tidy(log)


@QUERIES.add()
def score_several_versions(spark, sf):
    """Two models on the same unseen rows, and the decision between them."""
    rows, _, live = fitted(spark, sf, ["o_totalprice"], ["c_mktsegment"])
    _, _, candidate = fitted(spark, sf, rows=rows)
    test = rows.where("split = 'test'")
    long = training.score_versions({"live": live, "candidate": candidate}, test)
    wide = long.groupBy("o_orderkey", TARGET).pivot("model_version", ["live", "candidate"]).agg(F.first("probability"))
    scored = wide.select(
        F.lit("v2").alias("candidate_name"), TARGET, F.col("candidate").alias("candidate_score"), F.col("live").alias("live_score"),
        F.lit(0.5).alias("candidate_threshold"), F.lit(0.5).alias("live_threshold"),
    )
    shared = promotion.shared_row_metrics(scored, TARGET, by=["candidate_name"])
    auc = F.create_map(F.lit("roc_auc"), F.col("candidate_auc"))
    rows = shared.withColumns(
        {"metrics": auc, "live_metrics": F.create_map(F.lit("roc_auc"), F.col("live_auc")), "has_live": F.lit(True), "evaluated_on": F.lit("static_holdout")}
    )
    decided = promotion.decide(rows, promotion.GateConfig(floors={"roc_auc": 0.7}))
    return tidy(decided.select("candidate_name", "candidate_auc", "live_auc", "b", "c", "p_value", "decision", "reason"))
