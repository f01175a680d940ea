"""Labels, metrics, comparison, splits, cleaning, validation, preparation, scenarios, roll-ups."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import (
    clean, cooldown, labels, metrics, order, prepare, rollups, scenarios, split, validate,
)
from tidewatch.operators.validate import FEATURE_RULES, LABEL_RULES
from tidewatch.sources import schemas, tables

T0 = dt.datetime(2024, 1, 1)


# ---- labels

def log_and_labels(spark):
    log = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1), ("d", 0)], "request_id string, prediction int")
    sent = spark.createDataFrame(
        [("a", 1, 1, 1), ("b", 1, 1, 2), ("b", 0, 2, 3), ("zz", 1, 1, 4)],
        "request_id string, actual_label int, received_at int, seq int",
    )
    return log, sent


def test_attach_labels_latest_wins_and_others_stay(spark):
    log, sent = log_and_labels(spark)
    out = {r["request_id"]: r["actual_label"] for r in labels.attach_labels(log, sent, ["received_at", "seq"]).collect()}
    assert out == {"a": 1, "b": 0, "c": None, "d": None}


def test_attach_keeps_labels_already_there(spark):
    log = spark.createDataFrame([("a", 1, 1), ("b", 0, 0)], "request_id string, prediction int, actual_label int")
    sent = spark.createDataFrame([("b", 1, 5)], "request_id string, actual_label int, received_at int")
    out = {r["request_id"]: (r["actual_label"], r["label_received_at"]) for r in labels.attach_labels(log, sent, ["received_at"]).collect()}
    assert out == {"a": (1, None), "b": (1, 5)}


def test_label_result_counts_each_label_sent(spark):
    log, sent = log_and_labels(spark)
    r = labels.label_result(log, sent).first()
    assert (r["updated"], r["correct"], r["incorrect"], r["unknown"]) == (3, 2, 1, 1)
    assert [x["request_id"] for x in labels.unknown_labels(sent, log).collect()] == ["zz"]
    assert {x["request_id"] for x in labels.labelled_log(log, sent).collect()} == {"a", "b"}
    empty = labels.label_result(log, sent.limit(0)).first()
    assert (empty["updated"], empty["unknown"]) == (0, 0)


def test_duplicate_request_ids_all_get_the_label(spark):
    log = spark.createDataFrame([("a", 1), ("a", 1)], "request_id string, prediction int")
    sent = spark.createDataFrame([("a", 0, 1)], "request_id string, actual_label int, received_at int")
    assert [r["actual_label"] for r in labels.attach_labels(log, sent, ["received_at"]).collect()] == [0, 0]


def test_ledger(spark):
    log = spark.range(5)
    assert {r["id"] for r in labels.unanalysed(log, spark.range(3)).collect()} == {3, 4}


def test_live_accuracy_windows(spark):
    rows = [(T0 + dt.timedelta(days=d), 1, int(d % 2 == 0)) for d in range(9)]
    df = spark.createDataFrame(rows, "ts timestamp, prediction int, actual_label int")
    out = labels.live_accuracy(df, "ts", "7 days", "1 day", []).toPandas()
    first = out[out.window_start == T0].iloc[0]
    assert (first.correct, first.incorrect) == (4, 3)
    assert len(out) == 15


# ---- metrics

@pytest.mark.parametrize("rows_per_task", [9, None])
def test_evaluate_matches_brute_force(spark, rows_per_task):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200)
    p = np.round(np.clip(rng.random(200) * 0.7 + y * 0.2, 0, 1), 2)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    r = metrics.evaluate(df, "y", "p", 0.5, rows_per_task=rows_per_task).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    hit = p >= 0.5
    tp, fp, fn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum()
    eps = np.finfo(float).eps
    q = np.clip(p, eps, 1 - eps)
    loss = -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()
    assert r["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert r["precision"] == pytest.approx(tp / (tp + fp)) and r["recall"] == pytest.approx(tp / (tp + fn))
    assert r["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn)) and r["log_loss"] == pytest.approx(loss)
    assert r["true_negatives"] + r["false_positives"] + r["false_negatives"] + r["true_positives"] == 200


def test_evaluate_special_cases(spark):
    make = lambda rows: spark.createDataFrame(rows, "y int, p double")
    perfect = metrics.evaluate(make([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9), (1, 0.95)]), "y", "p").first()
    assert (perfect["roc_auc"], perfect["f1"]) == (1.0, 1.0)
    flat = metrics.evaluate(make([(0, 0.5), (1, 0.5), (0, 0.5), (1, 0.5)]), "y", "p").first()
    assert flat["roc_auc"] == 0.5
    single = metrics.evaluate(make([(0, 0.1), (0, 0.2)]), "y", "p").first()
    assert single["roc_auc"] is None and single["precision"] == 0 and single["f1"] == 0 and single["true_negatives"] == 2
    strict = metrics.evaluate(make([(0, 0.1), (1, 0.6)]), "y", "p", threshold=0.7).first()
    assert (strict["true_positives"], strict["false_negatives"], strict["recall"]) == (0, 1, 0.0)
    m = metrics.metrics_map(metrics.evaluate(make([(0, 0.1), (1, 0.6)]), "y", "p")).first()["metrics"]
    assert set(m) == set(metrics.METRIC_NAMES) and m["true_positives"] == 1.0


@pytest.mark.parametrize(
    "b, c, p, passed, method",
    [
        (0, 0, 1.0, False, "none"),
        (0, 8, 2 * 0.5**8, True, "exact"),
        (8, 0, 2 * 0.5**8, False, "exact"),
        (12, 12, 1.0, False, "exact"),
        (10, 40, math.erfc(math.sqrt((29**2 / 50) / 2)), True, "chi2"),
        (30, 30, math.erfc(math.sqrt((1 / 60) / 2)), False, "chi2"),
    ],
)
def test_mcnemar(spark, b, c, p, passed, method):
    r = metrics.mcnemar(spark.createDataFrame([(b, c)], "b long, c long")).first()
    assert r["p_value"] == pytest.approx(p, rel=1e-9) and (r["passed"], r["method"]) == (passed, method)


def test_discordant_counts_use_correctness(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (0, 0, 1), (0, 1, 1)], "y int, cand int, live int")
    r = df.agg(*metrics.discordant_counts(F.col("y"), F.col("cand"), F.col("live"))).first()
    assert (r["b"], r["c"]) == (1, 2)


def test_align_scores_needs_the_same_rows(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id int, s double")
    b = spark.createDataFrame([(1, 0.3), (2, 0.4)], "id int, t double")
    assert metrics.align_scores(a, b, "id").count() == 2
    with pytest.raises(ValueError):
        metrics.align_scores(a, b.limit(1), "id")


def test_decision_threshold(spark):
    df = spark.createDataFrame([({"threshold": "0.3"},), ({"threshold": "x"},), ({},), (None,)], "params map<string,string>")
    assert [r[0] for r in df.select(metrics.decision_threshold(F.col("params"))).collect()] == [0.3, 0.5, 0.5, 0.5]


# ---- splits

@pytest.mark.parametrize("rows_per_task", [23, None])
@pytest.mark.parametrize("n, fraction, expected", [(299, 0.3, 0), (300, 0.3, 90), (305, 0.1, 30), (315, 0.1, 32)])
def test_time_split(spark, n, fraction, expected, rows_per_task):
    df = spark.range(n).select(
        "id", (F.lit(T0) + F.make_dt_interval(mins=(F.col("id") * 7) % 50)).alias("ts")
    )
    out = split.time_split(df, ["ts", "id"], fraction, 300, rows_per_task=rows_per_task)
    assert out.columns == ["id", "ts", "part"]
    pdf = out.toPandas()
    if expected == 0:
        assert len(pdf) == 0
        return
    held = pdf[pdf.part == "evaluation"].sort_values(["ts", "id"])
    train = pdf[pdf.part == "train"].sort_values(["ts", "id"])
    assert (len(held), len(train)) == (expected, n - expected)
    assert tuple(train.iloc[-1][["ts", "id"]]) < tuple(held.iloc[0][["ts", "id"]])


@pytest.mark.parametrize("rows_per_task", [13, None])
def test_groups_without_a_name_keep_their_rows(spark, rows_per_task):
    df = spark.range(120).select("id", F.when(F.col("id") % 3 > 0, "a").alias("k"))
    out = split.time_split(df, ["id"], 0.25, 10, ["k"], rows_per_task)
    counts = {(r["k"], r["part"]): r["count"] for r in out.groupBy("k", "part").count().collect()}
    assert counts == {(None, "train"): 30, (None, "evaluation"): 10, ("a", "train"): 60, ("a", "evaluation"): 20}
    windows = split.count_windows(df, ["id"], 30, 10, ["k"], rows_per_task)
    got = {(r["k"], r["window_id"]): r["count"] for r in windows.groupBy("k", "window_id").count().collect()}
    assert got == {(None, 0): 30, (None, 1): 10, ("a", 0): 30, ("a", 1): 30, ("a", 2): 20}


def test_time_split_holds_out_at_least_one(spark):
    out = split.time_split(spark.range(3), ["id"], 0.01, 1).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in out} == {"train": 2, "evaluation": 1}
    one = split.time_split(spark.range(1), ["id"], 0.3, 1).collect()
    assert [r["part"] for r in one] == ["evaluation"]


@pytest.mark.parametrize("rows_per_task", [31, None])
def test_stratified_split(spark, rows_per_task):
    df = spark.range(203).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    out = split.stratified_split(df, "y", ["id"], 0.2, rows_per_task=rows_per_task)
    counts = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert counts[(0, "test")] + counts[(1, "test")] == 41
    assert counts[(1, "test")] == 10 and sum(counts.values()) == 203
    again = split.stratified_split(df.repartition(5), "y", ["id"], 0.2)
    assert out.exceptAll(again).count() == 0


@pytest.mark.parametrize("rows_per_task", [40, None])
def test_count_windows(spark, rows_per_task):
    df = spark.range(1050).select("id", F.when(F.col("id") < 950, "a").otherwise("b").alias("k"))
    out = split.count_windows(df, ["id"], 300, 100, ["k"], rows_per_task)
    rows = out.groupBy("k", "window_id", "complete").count().collect()
    got = {(r["k"], r["window_id"]): (r["complete"], r["count"]) for r in rows}
    assert got == {
        ("a", 0): (True, 300), ("a", 1): (True, 300), ("a", 2): (True, 300), ("a", 3): (False, 50), ("b", 0): (True, 100),
    }
    small = split.count_windows(spark.range(30), ["id"], 10, 100)
    assert small.where("complete").count() == 30


# ---- cooldown

def fire_brute(times, c):
    out, last = [], None
    for t in times:
        ok = last is None or (t - last).total_seconds() >= c
        last = t if ok else last
        out.append(ok)
    return out


@pytest.mark.parametrize("rows_per_task", [4, 17, None])
@pytest.mark.parametrize("seconds", [30, 100, 3600, 20000])
def test_cooldown_chain(spark, rows_per_task, seconds):
    rng = np.random.default_rng(seconds)
    gaps = rng.choice([5, 40, 400, 9000], 150)
    times = [T0 + dt.timedelta(seconds=int(x)) for x in np.cumsum(gaps)]
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate(times)], "k string, t timestamp, i int")
    out = cooldown.fire(df, "t", "i", seconds, ["k"], rows_per_task).orderBy("i").collect()
    assert [r["fired"] for r in out] == fire_brute(times, seconds)


@pytest.mark.parametrize("rows_per_task", [3, None])
def test_cooldown_many_keys_and_one_hot_time(spark, rows_per_task):
    """A third of all rows share one time, and a key may be null."""
    hot = [("hot", T0, i) for i in range(40)] + [("hot", T0 + dt.timedelta(hours=i), 100 + i) for i in range(1, 20)]
    cold = [(f"k{i % 7}" if i % 7 else None, T0 + dt.timedelta(minutes=31 * i), 1000 + i) for i in range(60)]
    df = spark.createDataFrame(hot + cold, "k string, t timestamp, i int")
    pdf = cooldown.fire(df, "t", "i", 7200, ["k"], rows_per_task).toPandas().sort_values(["t", "i"])
    assert len(pdf) == 119
    for _, part in pdf.groupby("k", dropna=False):
        assert part.fired.tolist() == fire_brute(list(part.t), 7200)


def test_cooldown_longer_than_a_bucket_meets_in_no_group(spark):
    rng = np.random.default_rng(5)
    times = np.sort(rng.integers(0, 4_000, 3_000))
    df = spark.createDataFrame([(None if t % 2 else "k", int(t), i) for i, t in enumerate(times)], "k string, s long, i long").withColumn("t", F.timestamp_seconds("s"))
    earlier = spark.createDataFrame([("k", 1_000)], "k string, s long").select("k", F.timestamp_seconds("s").alias("last_fired"))
    for seconds in (7, 350, 2_000):
        want = []
        for odd in (0, 1):
            last = None if odd else 1_000
            for i, t in enumerate(times):
                if t % 2 == odd and (last is None or t - last >= seconds):
                    want.append(i)
                    last = t
        out = cooldown.fire(df, "t", "i", seconds, ["k"], 100, earlier)
        assert sorted(r["i"] for r in out.where("fired").collect()) == sorted(want)
        assert out.count() == len(times)
    # No group of Python rows is a whole key: the entry states come from joins.
    rows = order.add_bucket(df.withColumns({"_t": F.unix_micros("t"), "_first": F.lit(cooldown._START)}), ["k"], ["_t"], order.measure(df, ["k"]), 100)
    plan = cooldown._entries(rows, ["k"], 350_000_000, 100)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_cooldown_boundary(spark):
    rows = [(T0, 0), (T0 + dt.timedelta(seconds=3599), 1), (T0 + dt.timedelta(seconds=3600), 2)]
    df = spark.createDataFrame(rows, "t timestamp, i int")
    assert [r["fired"] for r in cooldown.fire(df, "t", "i", 3600).orderBy("i").collect()] == [True, False, True]
    assert all(r["fired"] for r in cooldown.fire(df, "t", "i", 0).collect())


# ---- cleaning and validation

def test_clean(spark):
    raw = spark.createDataFrame(
        [("1", "20.5", "Yes"), ("2", " ", "No"), ("3", " 7 ", "No"), ("4", "9", "maybe"), ("5", "x", "Yes")],
        "customerID string, TotalCharges string, Churn string",
    )
    out = clean.clean(raw, "Churn", "TotalCharges", ["customerID", "absent"])
    assert out.columns == ["TotalCharges", "Churn"]
    assert sorted(map(tuple, out.collect())) == [(7.0, 0), (20.5, 1)]
    r = clean.clean_counts(raw, "Churn", "TotalCharges").first()
    assert tuple(r) == (5, 2, 1, 2)
    x, y = clean.split_features(out, "Churn")
    assert (x.columns, y.columns) == (["TotalCharges"], ["Churn"])
    numeric = spark.createDataFrame([(1,), (None,)], "Churn int")
    assert clean.clean(numeric, "Churn").count() == 1


def good_record():
    record = {name: values[0] for name, values in schemas.ALLOWED.items()}
    return record | {"SeniorCitizen": 0, "tenure": 12, "MonthlyCharges": 75.35, "TotalCharges": 904.2}


def test_validation(spark):
    bad = good_record() | {"Contract": "Weekly", "tenure": 101, "MonthlyCharges": -1.0}
    missing = good_record() | {"gender": None, "TotalCharges": float("nan")}
    df = spark.createDataFrame([good_record(), bad, missing], schemas.FEATURE_RECORD)
    valid, quarantine = validate.split_valid(df, FEATURE_RULES)
    assert valid.count() == 1
    codes = sorted(";".join(sorted(r["violations"])) for r in quarantine.collect())
    assert codes == ["Contract:not_allowed;MonthlyCharges:too_low;tenure:too_high", "gender:missing"]


def test_label_validation(spark):
    df = spark.createDataFrame([("a", 1), ("", 0), ("x" * 37, 1), ("b", 2), ("c", -1), ("d", None)], schemas.LABEL_BATCH)
    valid, quarantine = validate.split_valid(df, LABEL_RULES)
    assert [r["request_id"] for r in valid.collect()] == ["a"] and quarantine.count() == 5


def test_floors(spark):
    df = spark.createDataFrame([({"roc_auc": 0.6, "f1": float("nan")},), ({"roc_auc": 0.7, "f1": 0.9, "precision": 0.5},)], "m map<string,double>")
    out = [r[0] for r in df.select(validate.floor_violations(F.col("m"), {"roc_auc": 0.7, "f1": 0.55, "precision": 0.5})).collect()]
    assert len(out[0]) == 3 and out[1] == []


# ---- preparation

def test_prepare(spark):
    train = spark.createDataFrame(
        [(1.0, "b", "x"), (2.0, "a", None), (None, "c", "x"), (7.0, "a", "x")], "n double, c string, d string"
    )
    fitted = prepare.fit(train, ["n"], ["c", "d"])
    assert fitted.feature_names == ["n", "c_b", "c_c", "d_x"]
    filled = np.array([1.0, 2.0, 2.0, 7.0])
    p = fitted.numbers["n"]
    assert (p.median, p.mean) == (2.0, pytest.approx(filled.mean())) and p.scale == pytest.approx(filled.std())
    other = spark.createDataFrame([(None, "new", None), (3.0, "b", "x")], "n double, c string, d string")
    rows = fitted.transform(other).collect()
    assert list(rows[0])[1:] == [0.0, 0.0, 0.0] and rows[0]["n"] == pytest.approx((2 - p.mean) / p.scale)
    assert list(rows[1])[1:] == [1.0, 0.0, 1.0]
    again = prepare.Preparation.from_table(fitted.table(spark), ["n"], ["c", "d"])
    assert again == fitted


def test_sparse_preparation_equals_the_projection_and_takes_any_number_of_categories(spark, tmp_path):
    from pyspark.ml.functions import vector_to_array
    from tidewatch.plans import training

    train = spark.createDataFrame([(1, 1.0, "b", "x"), (2, None, "a", None), (3, 5.0, None, "y"), (4, 2.0, "c's", "x")], "id int, n double, c string, d string")
    dense, sparse = prepare.fit(train, ["n"], ["c", "d"]), prepare.fit_sparse(train, ["n"], ["c", "d"], rows_per_task=2)
    other = train.union(spark.createDataFrame([(5, 9.0, "new", "missing")], train.schema))
    assert [r["name"] for r in sparse.names().orderBy("position").collect()] == dense.feature_names and sparse.width == len(dense.feature_names)
    training.SparseFeatures(sparse).write().save(str(tmp_path / "stage"))
    want = [list(r)[1:] for r in dense.transform(other, ["id"]).orderBy("id").collect()]
    for stage in (training.SparseFeatures(sparse), training.SparseFeatures.load(str(tmp_path / "stage"))):
        got = stage.transform(other).orderBy("id").select(vector_to_array("prepared_vector")).collect()
        assert [list(r[0]) for r in got] == want

    many = spark.range(30_000).select(F.concat(F.lit("w"), "id").alias("c"))
    fitted = prepare.fit_sparse(many, [], ["c"], rows_per_task=1_000)
    assert fitted.width == 29_999
    places = fitted.transform(many.union(many), "v").select(F.udf(lambda v: int(v.indices[0]) if len(v.indices) else -1, "int")("v").alias("i"))
    assert places.distinct().count() == 30_000 and places.agg(F.max("i")).first()[0] == 29_998


def test_prepare_constant_column_and_many_categories(spark):
    assert prepare.fit(spark.createDataFrame([(5.0,), (5.0,)], "n double"), ["n"], []).numbers["n"].scale == 1.0
    fitted = prepare.fit(spark.range(12_000).select(F.col("id").cast("string").alias("c")), [], ["c"])
    assert len(fitted.categories["c"]) == 12_000


# ---- scenarios

def scenario_rows(spark):
    return spark.range(20).select(
        "id", F.lit(10).alias("tenure"), F.lit(100.0).alias("MonthlyCharges"), F.lit(50.0).alias("TotalCharges"),
        F.when(F.col("id") < 10, "One year").otherwise("Two year").alias("Contract"),
    )


def test_levels(spark):
    df = scenario_rows(spark)
    none, odd = (scenarios.apply_level(df, level, ["id"]) for level in ("none", "strange"))
    assert none.exceptAll(df).count() == 0 and odd.exceptAll(df).count() == 0
    mild = scenarios.apply_level(df, "mild", ["id"]).toPandas()
    assert (mild.MonthlyCharges == 150).all() and np.allclose(mild.TotalCharges, 70) and (mild.tenure == 10).all()
    assert 0 < (mild.Contract == "Month-to-month").sum() < 20
    severe = scenarios.apply_level(df, "severe", ["id"]).toPandas()
    assert (severe.MonthlyCharges == 199).all() and (severe.TotalCharges == 150).all()
    assert (severe.Contract == "Two year").all() and (severe.tenure == 1).all()
    again = scenarios.apply_level(df.repartition(7), "mild", ["id"]).toPandas().sort_values("id")
    assert again.Contract.tolist() == mild.sort_values("id").Contract.tolist()
    assert scenarios.apply_level(df.select("id", "tenure"), "mild", ["id"]).columns == ["id", "tenure"]


@pytest.mark.parametrize("rows_per_task", [6, None])
def test_resample(spark, rows_per_task):
    df = scenario_rows(spark)
    out = scenarios.resample(df, ["id"], 100, rows_per_task=rows_per_task).toPandas()
    assert len(out) == 100 and out.draw.nunique() == 100 and out.id.between(0, 19).all() and out.id.duplicated().any()
    again = scenarios.resample(df.repartition(3), ["id"], 100).toPandas()
    assert out.sort_values("draw").id.tolist() == again.sort_values("draw").id.tolist()


# ---- roll-ups

def test_rollups(spark, monkeypatch):
    rows = [(T0 + dt.timedelta(minutes=m), k, v) for m, k, v in [(0, "a", 0.003), (1, "e", 0.2), (12, "a", 0.07), (13, "a", 9.0)]]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, v double")
    counts = {(r["window_start"].minute, r["kind"]): r["n"] for r in rollups.count_per_window(df, "ts", ["kind"]).collect()}
    assert counts == {(0, "a"): 1, (0, "e"): 1, (10, "a"): 2}
    errors = rollups.error_counts(df, "ts", F.col("kind") == "e", {"slow": F.col("v") > 0.1}).orderBy("window_start").collect()
    assert [(r["window_start"].minute, r["errors"], r["slow"]) for r in errors] == [(0, 1, 1), (5, 0, 0), (10, 0, 0)]
    typed = rollups.errors_by_type(df, "ts", "kind", span=(T0, T0 + dt.timedelta(minutes=20))).collect()
    found = {(r["window_start"].minute, r["error_type"]): r["errors"] for r in typed}
    assert len(found) == 10 and {k: v for k, v in found.items() if v} == {(0, "a"): 1, (0, "e"): 1, (10, "a"): 2}
    assert rollups.errors_by_type(df.where("false"), "ts", "kind").count() == 0
    # Thousands of types over more windows than one row makes.
    many = spark.range(3_000).select(
        (F.lit(T0) + F.make_dt_interval(mins=F.col("id") % 2 * 5 * 40)).alias("ts"), F.concat(F.lit("t"), "id").alias("kind")
    )
    monkeypatch.setattr(rollups, "WINDOWS_AT_ONCE", 7)
    found = rollups.errors_by_type(many, "ts", "kind")
    assert found.count() == 3_000 * 41 == found.distinct().count() and found.agg(F.sum("errors")).first()[0] == 3_000
    latency = {r["window_start"].minute: r for r in rollups.latency_per_window(df, "ts", "v").collect()}
    assert latency[10]["p95"] == 2.5 and latency[10]["n"] == 2
    assert latency[0]["p95"] == pytest.approx(0.1 + 0.15 * (1.9 - 1) / 1)
    h = {r["bound"]: r["n"] for r in rollups.score_histogram(df.where("v <= 1"), "v", []).collect()}
    assert h[0.0] == 0 and h[0.1] == 2 and h[1.0] == 3
    exact = rollups.exact_percentiles(df, ["kind"], "v", {"p50": 0.5}).collect()
    assert {r["kind"]: r["p50"] for r in exact} == {"a": 0.07, "e": 0.2}


def test_versions(spark):
    rows = [("v1", T0, 1, 1), ("v1", T0 + dt.timedelta(1), 0, 1), ("v2", T0 + dt.timedelta(2), 1, None)]
    df = spark.createDataFrame(rows, "model_version string, created_at timestamp, prediction int, actual_label int")
    activity = rollups.version_activity(df)
    out = {r["model_version"]: r for r in rollups.version_succession(activity).collect()}
    assert out["v1"]["previous_version"] is None and out["v2"]["previous_version"] == "v1"
    assert (out["v1"]["accuracy"], out["v2"]["accuracy"], out["v1"]["positive_rate"]) == (0.5, None, 0.5)


# ---- cases of round 2

def test_buckets_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(order, "MAX_BUCKETS", 3)
    df = spark.range(900).select((F.col("id") % 2).alias("k"), F.floor(F.sqrt("id")).alias("v"), "id")
    got = order.rank_rows(df, ["k"], ["v", "id"], "rank", rows_per_task=40).toPandas().sort_values(["k", "v", "id"])
    want = got.groupby("k").cumcount() + 1
    assert (got["rank"] == want).all()
    cut = order.cut_rows(df, ["k"], ["v", "id"], lambda n: F.floor(n / 3), rows_per_task=40).collect()
    ordered = {k: g.reset_index() for k, g in got.groupby("k")}
    assert {r["k"]: r["_cut"]["id"] for r in cut} == {k: int(g.id[149]) for k, g in ordered.items()}


def test_aligned_scores_need_the_same_rows_once(spark):
    left = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.1)], "id long, a double")
    right = spark.createDataFrame([(1, None), (2, 0.2), (3, 0.3)], "id long, b double")
    rows = {r["id"]: (r["a"], r["b"]) for r in metrics.align_scores(left, right, "id").collect()}
    assert rows == {1: (0.5, None), 2: (None, 0.2), 3: (0.1, 0.3)}
    for bad in (left.where("id < 3"), left.unionAll(left), left.unionAll(left.where("id = 1"))):
        with pytest.raises(ValueError):
            metrics.align_scores(bad, right, "id")
    with pytest.raises(ValueError):
        metrics.align_scores(left.unionAll(left.where("id = 1")), right.unionAll(right.where("id = 1")), "id")


@pytest.mark.parametrize("rows_per_task", [5, None])
def test_stratified_split_keeps_a_null_class(spark, rows_per_task):
    df = spark.range(103).select("id", F.when(F.col("id") % 10 < 3, F.lit("a")).when(F.col("id") % 10 < 9, F.lit("b")).alias("y"))
    out = split.stratified_split(df, "y", ["id"], 0.2, rows_per_task=rows_per_task).toPandas()
    assert len(out) == 103 and (out.split == "test").sum() == 21
    test = out[out.split == "test"].y.fillna("none").value_counts()
    shares = out.y.fillna("none").value_counts() * 21 / 103
    assert ((test - shares).abs() < 1).all()


def test_spine_of_a_long_time_is_distributed(spark):
    rows = [(dt.datetime(2020, 1, 1), "e"), (dt.datetime(2024, 1, 1), "e")]
    df = spark.createDataFrame(rows, "ts timestamp, kind string")
    out = rollups.error_counts(df, "ts", F.col("kind") == "e", {})
    assert out.count() == 4 * 365 * 288 + 288 + 1 and out.agg(F.sum("errors")).first()[0] == 2
