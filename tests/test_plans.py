"""Drift pass, data-set assembly, promotion, training."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tidewatch.operators import metrics, prepare
from tidewatch.operators.scenarios import Scale
from tidewatch.plans import assembly, drift_pass, promotion, training
from tidewatch.plans.drift_pass import PassConfig
from tidewatch.sources import schemas, tables

T0 = dt.datetime(2024, 1, 1)


# ---- drift pass

def baseline(spark, n=500):
    rng = np.random.default_rng(0)
    return spark.createDataFrame(
        pd.DataFrame({
            "visits": rng.poisson(30, n), "basket": rng.gamma(2.0, 12.0, n), "distance": rng.exponential(400.0, n),
        })
    )


def log_of(spark, frames):
    """Rows of the given kinds in time order, one per minute."""
    rng = np.random.default_rng(1)
    parts = []
    for kind, n in frames:
        if kind == "same":
            parts.append(pd.DataFrame({
                "visits": rng.poisson(30, n), "basket": rng.gamma(2.0, 12.0, n), "distance": rng.exponential(400.0, n),
            }))
        else:
            i = np.arange(n)
            parts.append(pd.DataFrame({"visits": 250, "basket": 700.0 + i / 2, "distance": 20_000.0 - i}, index=i))
    pdf = pd.concat(parts, ignore_index=True)
    pdf["id"] = np.arange(len(pdf))
    pdf["created_at"] = [T0 + dt.timedelta(minutes=int(i)) for i in range(len(pdf))]
    return spark.createDataFrame(pdf)


def windows(result):
    return result.windows.orderBy("window_id").collect()


def test_pass_outcomes(spark):
    log = log_of(spark, [("same", 100), ("far", 300), ("same", 40)])
    config = PassConfig(window_size=100, min_samples=50, cooldown_seconds=7000)
    result = drift_pass.drift_pass(baseline(spark), log, config=config)
    rows = windows(result)
    assert [r["outcome"] for r in rows] == ["no_drift", "drift_detected", "drift_detected", "drift_detected", "insufficient_samples"]
    assert [r["drift_share"] for r in rows] == [0.0, 1.0, 1.0, 1.0, None]
    # Windows end 100 minutes apart, so with a cooldown of 7000 s every second breach fires.
    assert [r["fired"] for r in rows] == [False, True, False, True, False]
    assert [r["analyzed_rows"] for r in rows] == [100, 100, 100, 100, 40]
    assert drift_pass.pass_outcome(result).first()["outcome"] == "insufficient_samples"
    assert result.features.count() == 12


def test_pass_share_threshold_is_inclusive(spark):
    log = log_of(spark, [("same", 100)]).withColumn("visits", F.lit(500))
    config = PassConfig(window_size=100, min_samples=50)
    row = windows(drift_pass.drift_pass(baseline(spark), log, config=config))[0]
    assert row["drift_share"] == pytest.approx(1 / 3) and row["outcome"] == "drift_detected"


def test_pass_without_reference_rows_or_columns(spark):
    log = log_of(spark, [("same", 60)])
    config = PassConfig(window_size=50, min_samples=50)
    none = drift_pass.drift_pass(None, log, config=config)
    assert {r["outcome"] for r in none.windows.collect()} == {"no_reference"} and none.features is None
    other = spark.createDataFrame([(1,)], "elsewhere int")
    mismatch = windows(drift_pass.drift_pass(other, log, config=config))
    assert [(r["outcome"], r["is_failure"]) for r in mismatch] == [("column_mismatch", True), ("insufficient_samples", False)]
    empty = drift_pass.drift_pass(baseline(spark), log.limit(0), config=config)
    assert drift_pass.pass_outcome(empty).first()["outcome"] == "no_new_logs"


def test_sensitivity(spark):
    ref = baseline(spark, 2000)
    out = drift_pass.sensitivity(ref, ref, [Scale("basket", 3.0)], [0.0, 1.0], F.lit(0.0))
    got = {(r["strength"], r["feature"]): r["drifted"] for r in out.collect()}
    assert got[(1.0, "basket")] and not got[(0.0, "basket")] and not got[(1.0, "visits")]


def odd_pair(spark):
    """Nulls, NaN and repeats; `kind` and `size` get values by edits where they have none."""
    made = spark.range(3000).select(
        "id", F.when(F.col("id") % 11 > 0, F.col("id") % 97 / 7.0).alias("price"), F.when(F.col("id") % 13 > 0, (F.col("id") % 40).cast("int")).alias("size"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("k"), F.col("id") % 4)).alias("kind"), (F.col("id") % 31 + F.when(F.col("id") % 7 == 0, float("nan")).otherwise(0.0)).alias("still"),
    )
    return made.where("id % 2 = 0"), made.where("id % 2 = 1")


def test_sensitivity_equals_edited_copies_of_all_rows(spark):
    from tidewatch.operators import drift
    from tidewatch.operators.scenarios import Overwrite, Shrink, apply_edits, hash_share

    ref, cur = odd_pair(spark)
    edits = [Scale("price", 2.5, cap=20.0), Shrink("size", 0.3, floor=2), Overwrite("kind", "k1", 0.6), Scale("elsewhere", 2.0)]
    strengths, features, share = [1.0, 0.0, 0.4], ["price", "size", "kind", "still"], hash_share(["id"], 7)
    copies = cur.withColumn("strength", F.explode(F.array(*[F.lit(s) for s in strengths])))
    copies = apply_edits(copies, edits, share, F.col("strength")).select("strength", *features)
    want = drift.compare_windows(ref, copies, ["strength"], features)
    got = drift_pass.sensitivity(ref, cur, edits, [*strengths, 0.4], share, features)
    assert got.columns == want.columns

    def listed(df):
        rows = [r.asDict() for r in df.orderBy("strength", "feature").collect()]
        return [{k: pytest.approx(v) if isinstance(v, float) else v for k, v in r.items()} for r in rows], rows

    assert len(listed(want)[1]) == 12 and listed(got)[1] == listed(want)[0]
    empty = drift_pass.sensitivity(ref, cur.limit(0), edits, strengths, share, features).collect()
    assert len(empty) == 12 and {r["status"] for r in empty} == {"no_data"}


def test_sensitivity_reads_rows_once_for_any_number_of_strengths(spark):
    ref, cur = odd_pair(spark)
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    watched = cur.mapInPandas(counting, cur.schema)
    drift_pass.sensitivity(ref, watched, [Scale("price", 2.0)], [i / 10 for i in range(9)], F.lit(0.0), ["price", "still"]).collect()
    assert read.value == cur.count()


# ---- sources and assembly

def raw_csv(tmp_path, n=200):
    rows = {c: ["x"] * n for c in [schemas.ID_COLUMN, *schemas.ALLOWED]}
    rows[schemas.ID_COLUMN] = [f"c{i}" for i in range(n)]
    rows |= {"SeniorCitizen": 0, "tenure": [1 + i % 71 for i in range(n)], "MonthlyCharges": 20.0}
    rows["TotalCharges"] = [" " if i == 7 else str(20 + i) for i in range(n)]
    rows["Churn"] = ["Yes" if i % 4 == 0 else "No" for i in range(n)]
    path = tmp_path / "raw.csv"
    pd.DataFrame(rows)[[*list(rows)[::-1]]].to_csv(path, index=False)
    return str(path)


def test_raw_csv(spark, tmp_path):
    raw = tables.read_raw_csv(spark, raw_csv(tmp_path))
    assert raw.columns == schemas.RAW_TABLE.fieldNames() and raw.count() == 200
    with pytest.raises(tables.DataLoadError):
        tables.read_raw_csv(spark, str(tmp_path / "absent.csv"))
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(tables.DataValidationError, match="Churn"):
        tables.read_raw_csv(spark, str(bad))


def feedback_log(spark, n=300):
    return spark.range(n).select(
        F.col("id").alias("id"), (F.lit(T0) + F.make_dt_interval(mins=F.col("id"))).alias("created_at"),
        *[F.lit("y").alias(c) for c in schemas.ALLOWED],
        F.lit(1).alias("SeniorCitizen"), F.col("id").cast("int").alias("tenure"), F.lit(1.0).alias("MonthlyCharges"),
        F.lit(2.0).alias("TotalCharges"), (F.col("id") % 2).cast("int").alias("actual_label"), F.lit(9).alias("extra"),
    )


def assembled(spark, tmp_path, feedback=None):
    raw = tables.read_raw_csv(spark, raw_csv(tmp_path))
    paths = {k: str(tmp_path / k) for k in ("reference_path", "holdout_path", "production_holdout_path")}
    built = assembly.assemble(
        raw, "Churn", schemas.ID_COLUMN, drop=[schemas.ID_COLUMN], number="TotalCharges",
        required=schemas.RAW_TABLE.fieldNames(), feedback=feedback, **paths,
    )
    return built, paths


def test_assembly_without_and_with_feedback(spark, tmp_path):
    plain, paths = assembled(spark, tmp_path)
    s = plain.summary.first()
    assert (s["n_train"], s["n_test"], s["n_feedback_train"]) == (159, 40, 0)
    assert s["positive_rate_test"] == pytest.approx(0.25)
    assert "customerID" not in plain.rows.columns
    assert tables.read_table(spark, paths["production_holdout_path"]) is None

    tagged = assembly.feedback_rows(feedback_log(spark), None, "Churn", ["created_at", "id"])
    feedback = assembly.as_feedback(tagged)
    built, paths = assembled(spark, tmp_path, feedback)
    s = built.summary.first()
    assert (s["n_train"], s["n_test"], s["n_feedback_train"]) == (159 + 210, 40, 210)
    assert built.rows.where("split = 'test'").exceptAll(plain.rows.where("split = 'test'")).count() == 0
    assert spark.read.parquet(paths["reference_path"]).count() == 369
    held = tables.read_labelled(spark, paths["production_holdout_path"], "Churn")
    assert held.count() == 90 and held.agg(F.min("tenure")).first()[0] == 210

    assembled(spark, tmp_path)
    assert tables.read_table(spark, paths["production_holdout_path"]) is None


def test_feedback_edges(spark):
    small = assembly.feedback_rows(feedback_log(spark, 299), None, "Churn", ["created_at", "id"])
    assert assembly.as_feedback(small) is None
    off = assembly.feedback_rows(feedback_log(spark), None, "Churn", ["created_at", "id"], enabled=False)
    assert assembly.as_feedback(off) is None
    rows = spark.createDataFrame([(1, 0, "test")], "tenure int, Churn int, split string")
    with pytest.raises(tables.DataValidationError, match="tenure"):
        assembly.append_feedback(rows, spark.createDataFrame([(1,)], "Churn int"), "Churn", ["tenure"])


def test_feedback_takes_sent_labels(spark):
    log = feedback_log(spark).drop("actual_label").withColumn("request_id", F.col("id").cast("string"))
    sent = spark.range(300).select(F.col("id").cast("string").alias("request_id"), F.lit(1).alias("actual_label"), F.col("id").alias("received_at"))
    tagged = assembly.feedback_rows(log, sent, "Churn", ["created_at", "id"])
    assert {r["part"]: r["count"] for r in tagged.groupBy("part").count().collect()} == {"train": 210, "evaluation": 90}


@pytest.mark.parametrize("n, one_class, expected", [(120, False, "production_holdout"), (20, False, "static_holdout"), (120, True, "static_holdout")])
def test_evaluation_choice(spark, n, one_class, expected):
    static = spark.range(300).select((F.col("id") % 2).cast("int").alias("y"))
    production = spark.range(n).select((F.lit(1) if one_class else F.col("id") % 2).cast("int").alias("y"))
    assert assembly.choose_evaluation(production, static, "y")[1] == expected
    assert assembly.choose_evaluation(None, None, "y") is None


def test_log_append_schema_and_history(spark, tmp_path):
    path = str(tmp_path / "log")
    record = spark.createDataFrame([("1", "r", "{}", 1, 0.9, "v1", False, T0)], "id string, request_id string, features string, prediction int, probability double, model_version string, drift_analyzed boolean, created_at timestamp")
    tables.append_predictions(record, path)
    tables.append_predictions(record, path)
    stored = tables.read_predictions(spark, path)
    assert stored.count() == 2 and "actual_label" in stored.columns
    _, added = tables.align_to_schema(record.drop("id"), schemas.PREDICTION_LOG)
    assert added == ["actual_label", "label_received_at"]
    history = str(tmp_path / "history")
    for share in (0.1, 0.7):
        tables.append_drift_history(spark.createDataFrame([(share,)], "drift_share double"), history)
    assert tables.latest_drift(spark.read.json(history)).first()["drift_share"] == 0.7
    shown = tables.recent_rows(stored.withColumn("request_id", F.lit("0123456789ab")), 1).first()
    assert (shown["request_id"], shown["created_at"]) == ("01234567…", "2024-01-01 00:00:00")


# ---- promotion

GOOD = {"roc_auc": 0.9, "f1": 0.9, "precision": 0.9}


@pytest.mark.parametrize(
    "change, config, expected",
    [
        ({}, {}, "accept"),
        ({"metrics": {"f1": 0.9, "precision": 0.9}}, {}, "error_no_auc"),
        ({"metrics": GOOD | {"f1": 0.1}}, {}, "reject_floor"),
        ({"metrics": GOOD | {"f1": float("nan")}}, {}, "reject_floor"),
        ({"has_live": False}, {}, "accept_first"),
        ({"evaluated_on": None}, {}, "error_no_evaluation"),
        ({"evaluated_on": None}, {"require_significance": False}, "accept"),
        ({"evaluated_on": None, "live_metrics": {}}, {"require_significance": False}, "accept_forced"),
        ({"evaluated_on": None, "live_metrics": {"roc_auc": 0.9}}, {"require_significance": False}, "reject_auc"),
        ({"candidate_auc": 0.804}, {}, "reject_auc"),
        ({"candidate_auc": None}, {}, "reject_auc"),
        ({"candidate_auc": float("nan")}, {}, "reject_auc"),
        ({"b": 10, "c": 12}, {}, "reject_significance"),
        ({"b": 40, "c": 5}, {}, "reject_significance"),
        ({"b": 10, "c": 12}, {"require_significance": False}, "accept"),
    ],
)
def test_decisions(spark, change, config, expected):
    row = {
        "metrics": GOOD, "has_live": True, "live_metrics": {"roc_auc": 0.8}, "evaluated_on": "static_holdout",
        "candidate_auc": 0.9, "live_auc": 0.8, "b": 5, "c": 40,
    } | change
    schema = "metrics map<string,double>, has_live boolean, live_metrics map<string,double>, evaluated_on string, candidate_auc double, live_auc double, b long, c long"
    out = promotion.decide(spark.createDataFrame([tuple(row.values())], schema), promotion.GateConfig(**config)).first()
    assert out["decision"] == expected and out["reason"]


def test_shared_rows_decide_and_not_logged_metrics(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 400)

    def scores(wrong):
        flip = rng.random(400) < wrong
        return np.where((y == 1) ^ flip, 0.8, 0.2) + rng.normal(0, 0.05, 400)

    pdf = pd.DataFrame({"y": y, "candidate_score": scores(0.05), "live_score": scores(0.25), "candidate_threshold": 0.5, "live_threshold": 0.5, "candidate": "v2"})
    shared = promotion.shared_row_metrics(spark.createDataFrame(pdf), "y")
    r = shared.first()
    assert r["candidate_auc"] > r["live_auc"] and r["c"] > r["b"] and r["evaluation_rows"] == 400
    rows = shared.withColumns({
        "metrics": F.create_map(*[x for k, v in GOOD.items() for x in (F.lit(k), F.lit(v))]),
        "live_metrics": F.create_map(F.lit("roc_auc"), F.lit(0.99)), "has_live": F.lit(True), "evaluated_on": F.lit("static_holdout"),
    })
    assert promotion.decide(rows).first()["decision"] == "accept"


# ---- training

def test_train_score_save_and_load(spark, tmp_path):
    rng = np.random.default_rng(2)
    n = 600
    pdf = pd.DataFrame({
        "id": np.arange(n), "tenure": rng.integers(0, 72, n).astype(float), "Contract": rng.choice(["Month-to-month", "One year", "It's \\ odd"], n), "unused": 1,
    })
    pdf["Churn"] = ((pdf.Contract == "Month-to-month") & (pdf.tenure < 24)).astype(int)
    pdf.loc[3, "tenure"] = np.nan
    rows = training.hold_out(spark.createDataFrame(pdf), ["id"], 0.2)
    fitted = prepare.fit(rows, ["tenure"], ["Contract"])
    params = training.BoostingParams(rounds=5, depth=3, rate=0.3)
    model = training.train(rows, fitted, "Churn", params, validation="is_validation")
    scored = training.score(model, rows)
    assert scored.count() == n and scored.columns == [*rows.columns, "probability"]
    result = metrics.evaluate(scored, "Churn", "probability").first()
    assert result["roc_auc"] > 0.95

    path = str(tmp_path / "model")
    model.write().save(path)
    again = training.score(PipelineModel.load(path), rows)
    gap = scored.join(again.select("id", F.col("probability").alias("p")), "id").agg(F.max(F.abs(F.col("probability") - F.col("p")))).first()[0]
    assert gap < 1e-12

    # The statement inside the pipeline and the projection give the same features.
    by_sql = model.stages[0].transform(rows).orderBy("id").select([f"prepared_{i}" for i in range(len(fitted.feature_names))]).toPandas()
    by_columns = fitted.transform(rows.orderBy("id")).toPandas()
    assert np.allclose(by_sql.to_numpy(), by_columns.to_numpy())

    both = training.score_versions({"v1": model, "v2": model}, rows)
    assert {r["model_version"]: r["count"] for r in both.groupBy("model_version").count().collect()} == {"v1": n, "v2": n}
    log = training.to_log(scored, ["tenure", "Contract"], F.col("id"), F.current_timestamp(), "v1", 0.4)
    assert log.columns == schemas.PREDICTION_LOG.fieldNames() and log.count() == n
    summary = assembly.split_summary(rows.withColumns({"split": F.lit("train"), "from_feedback": F.lit(False)}), "Churn")
    run = training.run_summary(metrics.evaluate(scored, "Churn", "probability"), summary, params, fitted.feature_names, "v1").first()
    assert run["params"]["rounds"] == "5" and run["n_train"] == n and run["metrics"]["roc_auc"] > 0.95


def test_training_keeps_the_round_of_least_validation_loss(spark):
    from tidewatch.catalog import models

    assert models.PARAMS == training.BoostingParams() and (models.PARAMS.rounds, models.PARAMS.depth, models.PARAMS.rate) == (300, 6, 0.05)
    rng = np.random.default_rng(4)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "tenure": rng.integers(0, 72, n).astype(float)})
    # Half of the labels are noise, so later rounds only learn the training rows by heart.
    pdf["Churn"] = np.where(rng.random(n) < 0.5, pdf.tenure < 24, rng.random(n) < 0.5).astype(int)
    rows = training.hold_out(spark.createDataFrame(pdf), ["id"], 0.3)
    fitted = prepare.fit(rows, ["tenure"], [])
    # All rows and columns, as the two trainings number their rows differently.
    params = training.BoostingParams(rounds=25, depth=4, rate=0.5, patience=25, row_share=1.0, column_share=1.0)
    model = training.train(rows, fitted, "Churn", params, validation="is_validation")
    kept = training.rounds_kept(model)
    every = training.train(rows.where("not is_validation"), fitted, "Churn", params)
    watched = every.stages[1].transform(every.stages[0].transform(rows.where("is_validation"))).withColumn("label", F.col("Churn").cast("double"))
    losses = every.stages[2].evaluateEachIteration(watched)
    assert len(losses) == 25 and kept == int(np.argmin(losses)) + 1 < 25
    again = model.stages[2].evaluateEachIteration(watched)
    assert np.allclose(again, losses[:kept])


def test_training_stops_when_patience_is_over(spark, monkeypatch):
    from tidewatch.plans import boosting

    grown = []
    grow = boosting._grow
    monkeypatch.setattr(boosting, "TASK_ROWS", 50)
    monkeypatch.setattr(boosting, "_grow", lambda *given: grown.append(1) or grow(*given))
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"number_0": rng.random(200), "y": rng.integers(0, 2, 200), "w": np.arange(200) % 3 == 0})
    params = training.BoostingParams(rounds=300, depth=2, rate=0.5, patience=4)
    found = boosting.fit(spark.createDataFrame(pdf), ["number_0"], {}, params, "y", "w")
    best = int(np.argmin(found.losses))
    # One loss before the first tree, and one behind each tree that was grown.
    assert len(grown) == len(found.losses) - 1 == best + 4 and len(found.trees) == max(best, 1)


def test_ways_of_boosting_agree_and_need_few_jobs(spark, monkeypatch):
    from tidewatch.plans import boosting

    rng = np.random.default_rng(11)
    n = 3000
    pdf = pd.DataFrame({"a": rng.normal(size=n).round(2), "c": rng.integers(0, 6, n), "w": rng.random(n) < 0.2})
    pdf["y"] = ((pdf.a > 0.3) ^ (pdf.c == 4) | (rng.random(n) < 0.1)).astype(int)
    params = training.BoostingParams(rounds=12, depth=3, rate=0.3)
    frame = spark.createDataFrame(pdf).repartition(3).localCheckpoint()
    context = spark.sparkContext

    def fitted(name, **sizes):
        with monkeypatch.context() as m:
            for key, value in sizes.items():
                m.setattr(boosting, key, value)
            context.setJobGroup(name, name)
            out = boosting.fit(frame, ["a"], {"c": 6}, params, "y", "w")
            context.setLocalProperty("spark.jobGroup.id", None)
        return out, len(context.statusTracker().getJobIdsForGroup(name))

    alone, few = fitted("alone")
    held, some = fitted("held", TASK_ROWS=0, FILE_ROWS=500, CHUNK_ROWS=100)
    by_key, many = fitted("by key", TASK_ROWS=0, TOLD_BYTES=0)
    # Not a job per round; and a round starts with the sums of its first level.
    assert few < 12 and some < many and some <= few + 12 * 3 + 8
    for other in (held, by_key):
        assert np.allclose(alone.losses, other.losses, atol=1e-9)
        for x, y in zip(alone.trees, other.trees, strict=True):
            assert (x.feature == y.feature).all() and (x.place == y.place).all() and np.allclose(x.value, y.value, atol=1e-9)


def plain_boosting(x, codes, y, weight, rounds, depth, rate):
    """The same trees over whole rows on one machine: every threshold and category is tried by masks."""
    raw = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (p - y), weight * p * (1 - p)

        def leaf(rows):
            return -rate * g[rows].sum() / (h[rows].sum() + 1.0)

        def grow(rows, level):
            best = (1e-6, None)
            for column in range(x.shape[1]):
                value = x[:, column]
                for cut in np.unique(value[~np.isnan(value)]):
                    for with_missing in (False, True):
                        best = better(best, rows, (value <= cut) | (np.isnan(value) & with_missing))
            for column in range(codes.shape[1]):
                for code in range(1, codes[:, column].max() + 1):
                    best = better(best, rows, codes[:, column] != code)
            if level == depth or best[1] is None:
                raw[rows] += leaf(rows)
                return
            grow(rows & best[1], level + 1)
            grow(rows & ~best[1], level + 1)

        def better(best, rows, left):
            sides = rows & left, rows & ~left
            if min(h[s].sum() for s in sides) < 1.0:
                return best
            score = lambda s: g[s].sum() ** 2 / (h[s].sum() + 1.0)
            gain = (score(sides[0]) + score(sides[1]) - score(rows)) / 2
            return (gain, left) if gain > best[0] * (1 + 1e-8) else best

        before = raw.copy()
        grow(np.ones(len(y), bool), 0)
        assert not np.allclose(before, raw)
    return raw


@pytest.mark.parametrize("task_rows", [1 << 17, 100])
def test_boosting_equals_a_plain_version(spark, monkeypatch, task_rows):
    from tidewatch.plans import boosting

    monkeypatch.setattr(boosting, "TASK_ROWS", task_rows)

    rng = np.random.default_rng(8)
    n = 240
    x = np.stack([rng.integers(0, 40, n).astype(float), rng.normal(size=n).round(1)], axis=1)
    x[rng.random(n) < 0.2, 0] = np.nan
    codes = np.stack([rng.integers(0, 5, n), rng.integers(-1, 3, n)], axis=1)
    y = ((np.nan_to_num(x[:, 0], nan=30.0) < 15) ^ (codes[:, 0] == 2) | (rng.random(n) < 0.1)).astype(int)
    rows = [
        (None if np.isnan(a) else float(a), float(b), int(c), None if d < 0 else int(d), int(t))
        for (a, b), (c, d), t in zip(x, codes, y)
    ]
    frame = spark.createDataFrame(rows, "a double, b double, c int, d int, y int").repartition(3)
    params = training.BoostingParams(rounds=13, depth=3, rate=0.3, row_share=1.0, column_share=1.0)
    found = boosting.fit(frame, ["a", "b"], {"c": 5, "d": 3}, params, "y")
    cuts = found.layout.cuts
    bins = np.stack([np.where(np.isnan(v), -1, np.searchsorted(c, v)) for v, c in zip(x.T, cuts)] + list(codes.T), axis=1)
    assert len(found.trees) == 13 and any(t.missing_left.any() for t in found.trees)
    assert np.allclose(found.raw(bins), plain_boosting(x, codes, y, np.where(y == 1, 3.0, 1.0), 13, 3, 0.3), atol=1e-9)

    # The Spark model gives the same scores; its vectors have no missing places.
    there = ~np.isnan(x[:, 0])
    one_hot = [(codes[:, 0] == v) for v in range(1, 5)] + [(codes[:, 1] == v) for v in (1, 2)]
    vectors = np.concatenate([x, np.stack(one_hot, axis=1)], axis=1)[there]
    model = found.as_spark(spark)
    listed = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "i int, v array<double>")
    from pyspark.ml.functions import array_to_vector, vector_to_array

    given = listed.select("i", array_to_vector("v").alias("features"))
    p = [r[0] for r in model.transform(given).orderBy("i").select(vector_to_array("probability")[1]).collect()]
    assert np.allclose(p, 1 / (1 + np.exp(-found.raw(bins)[there])), atol=1e-12)


def test_columns_are_sampled_per_tree():
    from tidewatch.plans import boosting

    every = np.arange(10)
    taken = [boosting.columns_taken(every, 10, 0.8, 42, k) for k in range(50)]
    assert all(t.sum() == 8 for t in taken) and len({tuple(t) for t in taken}) > 10
    assert boosting.columns_taken(np.arange(1), 1, 0.8, 42, 0).all()
    wide = boosting.columns_taken(np.arange(200_000), 200_000, 0.8, 42, 0).mean()
    assert abs(wide - 0.8) < 0.01


def test_no_python_in_scoring(spark):
    from tidewatch.operators import prepare as preparing

    rows = spark.createDataFrame([(i, float(i % 7), "abc"[i % 3], int(i % 7 > 3)) for i in range(90)], "id int, n double, c string, y int")
    for fitted in (preparing.fit_sparse(rows, ["n"], ["c"]), preparing.fit(rows, ["n"], ["c"])):
        model = training.train(rows, fitted, "y", training.BoostingParams(rounds=3, depth=2))
        scored = training.score(model, rows)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
        assert metrics.evaluate(scored, "y", "probability").first()["roc_auc"] == 1.0


def test_append_refuses_incomplete_records(spark, tmp_path):
    from pyspark.errors import PySparkException

    good = [("1", "r", "{}", 1, 0.5, "v", False, T0)]
    names = "id string, request_id string, features string, prediction int, probability double, model_version string, drift_analyzed boolean, created_at timestamp"
    record = spark.createDataFrame(good, names)
    with pytest.raises(tables.DataValidationError):
        tables.append_predictions(record.drop("probability"), str(tmp_path / "log"))
    with pytest.raises(PySparkException):
        tables.append_predictions(record.withColumn("probability", F.lit(None).cast("double")), str(tmp_path / "log"))
    assert tables.read_predictions(spark, str(tmp_path / "log")).count() == 0
    tables.append_predictions(record, str(tmp_path / "log"))
    assert tables.read_predictions(spark, str(tmp_path / "log")).count() == 1


def test_an_append_that_stops_halfway_shows_no_row(spark, tmp_path, monkeypatch):
    from pyspark.errors import PySparkException

    path = str(tmp_path / "log")
    schema = spark.range(1).schema
    visible = lambda: tables.read_committed(spark, path, schema).count()
    assert visible() == 0
    # A task fails after another one has written its file.
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(PySparkException):
        tables.append_committed(broken, path, "first")
    assert visible() == 0
    # The driver stops when all files are there, and before the manifest is.
    with monkeypatch.context() as patch:
        patch.setattr(tables, "_publish", lambda *_: (_ for _ in ()).throw(OSError("the driver is gone")))
        with pytest.raises(OSError):
            tables.append_committed(spark.range(0, 100, 1, 4), path, "first")
    assert list((tmp_path / "log" / "data").rglob("part-*.parquet")) and visible() == 0
    # The same commit again: once, whoever comes first.
    assert tables.append_committed(spark.range(0, 100, 1, 4), path, "first") and visible() == 100
    assert not tables.append_committed(spark.range(0, 100, 1, 4), path, "first") and visible() == 100
    assert not tables._publish(spark, "{}", f"{path}/commits/first.json") and visible() == 100
    assert tables.append_committed(spark.range(5), path) and visible() == 105
    # Nothing of what was stopped is read, and no draft of a manifest stays.
    assert not [p for p in (tmp_path / "log" / "commits").iterdir() if p.name.endswith("draft")]
    assert tables.append_committed(spark.range(0), path) and visible() == 105


def test_columns_from_whatever_keys_the_log_holds(spark):
    listed = [
        '{"a":1,"b":{"x":1.5,"y":[1,2]},"c":"t","n":null,"A":true,"it\'s":2,"e":{}}',
        '{"a":2.5,"b":{"z":"q","x":null},"c":{"d":1},"OBJECT":1,"l":[1,"u"]}',
        '{"a":3,"c":7,"e f":[{"u":1},{"v":2}],"ID":9}', "not JSON", None, "[1,2]", "{}", "5",
    ]
    log = spark.createDataFrame([(i, t) for i, t in enumerate(listed)], "id long, features string")
    out = tables.unpack_all_features(log).orderBy("id")
    rows = out.collect()
    assert len(rows) == len(listed) and dict(out.dtypes)["b"] == "struct<x:double,y:array<bigint>,z:string>"
    assert out.columns == ["id", "A", "ID_2", "OBJECT", "a_2", "b", "c", "e", "e f", "it's", "l", "n"]
    assert [r["a_2"] for r in rows[:4]] == [1.0, 2.5, 3.0, None] and [r["c"] for r in rows[:4]] == ["t", '{"d":1}', "7", None]
    assert [r["A"] for r in rows[:2]] == [True, None] and rows[0]["it's"] == 2 and rows[2]["ID_2"] == 9 and rows[1]["OBJECT"] == 1
    assert rows[0]["b"].y == [1, 2] and rows[1]["b"].z == "q" and rows[1]["b"].x is None
    assert [tuple(x) for x in rows[2]["e f"]] == [(1, None), (None, 2)] and rows[1]["l"] == ["1", "u"] and rows[0]["e"] == "{}"
    assert all(v is None for r in rows[3:] for v in list(r)[1:]) and all(r["n"] is None for r in rows)
    assert tables.unpack_all_features(log.where("id > 3")).columns == ["id"]
    with pytest.raises(tables.DataValidationError):
        tables.unpack_all_features(spark.createDataFrame([("{\"a'\\\"b\":1}",)], "features string"))


@pytest.mark.parametrize("by", [[], ["stream"]])
def test_a_pass_in_parts_equals_one_pass(spark, by, tmp_path):
    from tidewatch.streaming.windows import CountWindowDrift

    ref = baseline(spark).select("visits", "basket", "distance")
    log = log_of(spark, [("drifted", 200), ("same", 100), ("drifted", 300)]).withColumn("stream", F.lit("s"))
    config = drift_pass.PassConfig(window_size=100, min_samples=100, cooldown_seconds=150 * 60)
    features = ["visits", "basket", "distance"]
    whole = drift_pass.drift_pass(ref, log, ("created_at", "id"), by, features, config)
    want = [(r["window_id"], r["dataset_drift"], r["fired"]) for r in windows(whole)]
    handler = CountWindowDrift(ref, str(tmp_path / "out"), features, ("created_at", "id"), by, config)
    for number, (low, high) in enumerate([(0, 150), (150, 330), (330, 420), (420, 600)]):
        part = log.where((F.col("id") >= low) & (F.col("id") < high))
        handler(part, number)
        if number == 1:
            handler(part, number)  # a batch that is repeated
    got = handler.read(spark, "windows").orderBy("window_id").collect()
    assert [(r["window_id"], r["dataset_drift"], r["fired"]) for r in got] == want
    assert [f for *_, f in want] == [True, False, False, True, False, True]


def test_boosting_works_on_cells_not_on_rows(spark, monkeypatch):
    from tidewatch.plans import boosting

    rng = np.random.default_rng(12)
    n = 4000
    pdf = pd.DataFrame({"a": rng.integers(0, 9, n).astype(float), "c": rng.integers(0, 3, n), "w": rng.random(n) < 0.2})
    pdf.loc[rng.random(n) < 0.1, "a"] = np.nan
    pdf["y"] = ((pdf.a > 4) ^ (pdf.c == 2) | (rng.random(n) < 0.1)).astype(int)
    frame = spark.createDataFrame(pdf).repartition(3).localCheckpoint()
    params = training.BoostingParams(rounds=8, depth=3, rate=0.3)
    alone = boosting.fit(frame, ["a"], {"c": 3}, params, "y", "w")
    cells, advance = [], boosting._advance

    def counted(held, *given):
        if not cells:
            cells.extend(held.map(lambda x: (len(x.first), len(x.row), len(x.raw))).collect())
        return advance(held, *given)

    monkeypatch.setattr(boosting, "TASK_ROWS", 0)
    monkeypatch.setattr(boosting, "FILE_ROWS", 1000)
    monkeypatch.setattr(boosting, "_advance", counted)
    held = boosting.fit(frame, ["a"], {"c": 3}, params, "y", "w")
    # Ten bins, three categories, two outcomes, two uses; a cell may lie in two partitions.
    assert sum(c[1] for c in cells) == n and sum(c[0] for c in cells) <= 10 * 3 * 2 * 2 + 8 and all(c[0] == c[2] for c in cells)
    assert np.allclose(alone.losses, held.losses, atol=1e-9) and len(alone.trees) == len(held.trees)
    for x, y in zip(alone.trees, held.trees):
        assert (x.feature == y.feature).all() and (x.place == y.place).all() and np.allclose(x.value, y.value, atol=1e-9)


def test_rows_are_taken_by_their_hash():
    from tidewatch.plans import boosting

    row = np.random.default_rng(13).integers(0, 1 << 60, 70_000)
    for share, seed, number in [(0.8, 42, 0), (0.5, -7, 299), (1 / 3, 42, 17)]:
        wanted = boosting._mixed(seed, -1 - number, row) < share
        assert (boosting.rows_taken(row, share, seed, number) == wanted).all() and abs(wanted.mean() - share) < 0.01
    for share in (0.8, 0.5, 1 / 3):
        beyond = boosting._first_beyond(share)
        assert np.uint64(beyond) / 2.0**64 >= share > np.uint64(beyond - 1) / 2.0**64
