from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from tidewatch.operators import drift
from tidewatch.operators.drift import DriftConfig


def ks_brute(a, b):
    grid = np.unique(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    return np.abs(fa - fb).max()


def wasserstein_brute(a, b):
    grid = np.unique(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    return float((np.abs(fa - fb)[:-1] * np.diff(grid)).sum()) / max(a.std(), 0.001)


def js_brute(a, b):
    keys = sorted(set(a) | set(b))
    p = np.array([np.mean(a == k) for k in keys])
    q = np.array([np.mean(b == k) for k in keys])
    mid = (p + q) / 2
    kl = lambda x: sum(x[i] * math.log(x[i] / mid[i]) for i in range(len(x)) if x[i] > 0)
    return math.sqrt((kl(p) + kl(q)) / 2)


def chi_brute(a, b):
    keys = sorted(set(a) | set(b))
    r = np.array([np.sum(a == k) for k in keys], float)
    o = np.array([np.sum(b == k) for k in keys], float)
    e = r * len(b) / len(a)
    return ((o - e) ** 2 / e)[e > 0].sum()


def frames(n_ref, n_cur, seed=0):
    rng = np.random.default_rng(seed)
    ref = pd.DataFrame({
        "tenure": rng.integers(1, 72, n_ref),
        "charges": np.round(rng.normal(60, 20, n_ref), 2),
        "contract": rng.choice(["a", "b", "c"], n_ref, p=[0.5, 0.3, 0.2]),
        "paper": rng.choice(["Yes", "No"], n_ref),
        "level": rng.integers(0, 4, n_ref),
    })
    cur = pd.DataFrame({
        "w": rng.integers(0, 5, n_cur),
        "tenure": rng.integers(1, 60, n_cur),
        "charges": np.round(rng.normal(70, 30, n_cur), 2),
        "contract": rng.choice(["a", "b", "c"], n_cur, p=[0.3, 0.3, 0.4]),
        "paper": rng.choice(["Yes", "No"], n_cur, p=[0.3, 0.7]),
        "level": rng.integers(0, 4, n_cur),
    })
    return ref, cur


FEATURES = ["tenure", "charges", "contract", "paper", "level"]


def expected_row(test, a, b):
    return {
        "ks": ks_brute, "wasserstein": wasserstein_brute, "jensen_shannon": js_brute, "chi_square": chi_brute,
    }[test](a, b)


@pytest.mark.parametrize("rows_per_task", [7, None])
@pytest.mark.parametrize("n_ref", [400, 3000])
def test_compare_matches_brute_force(spark, n_ref, rows_per_task):
    ref, cur = frames(n_ref, 900)
    out = drift.compare(
        spark.createDataFrame(ref), spark.createDataFrame(cur), FEATURES, rows_per_task=rows_per_task
    ).toPandas().set_index("feature")
    small = n_ref <= 1000
    assert out.loc["tenure", "test"] == ("ks" if small else "wasserstein")
    assert out.loc["contract", "test"] == ("chi_square" if small else "jensen_shannon")
    assert out.loc["paper", "test"] == ("z_test" if small else "jensen_shannon")
    assert out.loc["level", "test"] == ("chi_square" if small else "jensen_shannon")
    for f in FEATURES:
        if out.loc[f, "test"] != "z_test":
            want = expected_row(out.loc[f, "test"], ref[f].to_numpy(), cur[f].to_numpy())
            assert out.loc[f, "statistic"] == pytest.approx(want, abs=1e-9), f


@pytest.mark.parametrize("rows_per_task", [7, None])
@pytest.mark.parametrize("n_ref", [400, 3000])
def test_windows_match_the_paired_comparison(spark, n_ref, rows_per_task):
    ref, cur = frames(n_ref, 900, seed=3)
    cur.loc[::10, "contract"] = "new"
    cur.loc[(cur["w"] == 2), "charges"] = 60.0
    out = drift.compare_windows(
        spark.createDataFrame(ref), spark.createDataFrame(cur), ["w"], FEATURES, rows_per_task=rows_per_task
    ).toPandas()
    assert len(out) == 25
    for w, part in cur.groupby("w"):
        pair = drift.compare(spark.createDataFrame(ref), spark.createDataFrame(part), FEATURES).toPandas()
        both = pair.merge(out[out["w"] == w], on="feature", suffixes=("", "_w"))
        for r in both.itertuples():
            assert (r.test, r.n_ref, r.n_cur, r.n_values, r.drifted) == (
                r.test_w, r.n_ref_w, r.n_cur_w, r.n_values_w, r.drifted_w), r.feature
            assert abs(r.statistic) == pytest.approx(abs(r.statistic_w), abs=1e-9), r.feature
            if r.p_value == r.p_value:
                assert r.p_value == pytest.approx(r.p_value_w, abs=1e-9)


def test_groups_have_their_own_baseline(spark):
    ref, cur = frames(600, 600, seed=5)
    ref["g"], cur["g"] = np.arange(600) % 2, np.arange(600) % 2
    out = drift.compare(spark.createDataFrame(ref), spark.createDataFrame(cur), FEATURES, by=["g"]).toPandas()
    for g in (0, 1):
        want = ks_brute(ref[ref.g == g].charges.to_numpy(), cur[cur.g == g].charges.to_numpy())
        got = out[(out.g == g) & (out.feature == "charges")].statistic.iloc[0]
        assert got == pytest.approx(want, abs=1e-12)


def test_literals(spark):
    # Disjoint samples give D = 1; equal samples give zero and p = 1.
    a = spark.range(20).selectExpr("cast(id as double) x", "cast(id % 3 as string) c", "cast(id % 2 as string) z")
    b = spark.range(100, 120).selectExpr("cast(id as double) x", "cast(id % 3 as string) c", "cast(id % 2 as string) z")
    far = drift.compare(a, b, ["x"]).first()
    assert (far["test"], far["statistic"], far["drifted"]) == ("ks", 1.0, True)
    same = {r["feature"]: r for r in drift.compare(a, a).collect()}
    assert all(r["statistic"] == 0 and r["p_value"] == 1.0 and not r["drifted"] for r in same.values())
    assert {f: r["test"] for f, r in same.items()} == {"x": "ks", "c": "chi_square", "z": "z_test"}


def test_unexpected_category_and_no_data(spark):
    a = spark.createDataFrame([("a", 1.0)] * 10 + [("b", 2.0)] * 10 + [("c", None)] * 5, "c string, x double")
    b = spark.createDataFrame([("a", None)] * 10 + [("d", float("nan"))] * 10, "c string, x double")
    out = {r["feature"]: r for r in drift.compare(a, b).collect()}
    assert out["c"]["p_value"] == 0.0 and out["c"]["drifted"]
    assert out["x"]["status"] == "no_data" and out["x"]["statistic"] is None and not out["x"]["drifted"]
    summary = drift.summarise(drift.compare(a, b)).first()
    assert (summary["drift_share"], summary["number_of_columns"], summary["dataset_drift"]) == (0.5, 2, True)


def test_common_features_in_baseline_order(spark):
    a = spark.createDataFrame([(1, 2, 3)], "z int, y int, x int")
    b = spark.createDataFrame([(1, 2, 3)], "x int, z int, q int")
    assert drift.common_features(a, b) == ["z", "x"]


def test_explicit_test_and_critical_flag(spark):
    ref, cur = frames(300, 300)
    config = DriftConfig(tests={"charges": "wasserstein"}, critical=("charges",))
    out = drift.compare(spark.createDataFrame(ref), spark.createDataFrame(cur), ["charges", "tenure"], config=config)
    rows = {r["feature"]: r for r in out.collect()}
    assert rows["charges"]["test"] == "wasserstein" and rows["charges"]["critical"]
    assert rows["tenure"]["test"] == "ks" and not rows["tenure"]["critical"]
