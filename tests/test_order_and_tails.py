from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import tails
from tidewatch.operators import order


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "statistic, freedom, expected",
    [
        (3.841458820694124, 1, 0.05),
        (5.991464547107979, 2, 0.05),
        (18.307038053275146, 10, 0.05),
        (124.3421134, 100, 0.05),
        (0.0, 3, 1.0),
        (1e5, 4, 0.0),
        (0.5, 1, math.erfc(math.sqrt(0.25))),
        (40.0, 1, math.erfc(math.sqrt(20.0))),
    ],
)
def test_chi_square_tail(spark, statistic, freedom, expected):
    got = value(spark, tails.chi2_tail(f"{statistic!r}D", str(freedom)))
    assert got == pytest.approx(expected, rel=1e-8, abs=1e-12)


def test_normal_tail(spark):
    assert value(spark, tails.normal_two_sided("1.959963984540054D")) == pytest.approx(0.05, rel=1e-9)
    assert value(spark, tails.normal_two_sided("-3.0D")) == pytest.approx(math.erfc(3 / math.sqrt(2)), rel=1e-9)


def test_ks_tail(spark):
    assert value(spark, tails.ks_tail("0.0D", "10", "10")) == 1.0
    assert value(spark, tails.ks_tail("1.0D", "500", "500")) < 1e-12


@pytest.mark.parametrize("c, n, expected", [(8, 8, 2 * 0.5**8), (4, 8, 1.0), (1, 4, 0.625)])
def test_binomial(spark, c, n, expected):
    assert value(spark, tails.binomial_half_two_sided(str(c), str(n))) == pytest.approx(expected, rel=1e-12)


def keyed(spark, n=5000):
    # A third of the rows belong to key 0, and a third of all rows share one order value.
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"),
        F.when(F.col("id") % 3 == 1, 42).otherwise((F.col("id") * 7919) % 1009).alias("v"),
        F.col("id"),
        (F.col("id") % 5 + 1).alias("c"),
    )


@pytest.mark.parametrize("rows_per_task", [1, 50, 400, 10**6])
def test_running_totals_do_not_depend_on_buckets(spark, rows_per_task):
    df = keyed(spark)
    got = order.running_totals(df, ["k"], ["v", "id"], {"cum": "c"}, previous="prev", rows_per_task=rows_per_task)
    pdf = df.toPandas().sort_values(["k", "v", "id"])
    pdf["cum"] = pdf.groupby("k")["c"].cumsum()
    pdf["prev"] = pdf.groupby("k")["v"].shift()
    out = got.toPandas().sort_values(["k", "v", "id"])
    assert out["cum"].tolist() == pdf["cum"].tolist()
    assert out["prev"].fillna(-1).tolist() == pdf["prev"].fillna(-1).tolist()


@pytest.mark.parametrize("rows_per_task", [60, 10**6])
def test_rank_without_keys(spark, rows_per_task):
    df = keyed(spark)
    out = order.rank_rows(df, [], ["v", "id"], "r", rows_per_task=rows_per_task).toPandas()
    out = out.sort_values(["v", "id"])
    assert out["r"].tolist() == list(range(1, 5001))


@pytest.mark.parametrize("partitions", ["1", "4", "32"])
@pytest.mark.parametrize("rows_per_task", [60, 10**6])
def test_cut_rows(spark, rows_per_task, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = keyed(spark)
        got = order.cut_rows(df, ["k"], ["v", "id"], lambda n: F.floor(n / 2), rows_per_task=rows_per_task)
        rows = {r["k"]: (r["_cut"]["v"], r["_cut"]["id"]) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    pdf = df.toPandas().sort_values(["k", "v", "id"])
    for k, part in pdf.groupby("k"):
        row = part.iloc[len(part) // 2 - 1]
        assert rows[k] == (row["v"], row["id"])


@pytest.mark.parametrize("rows_per_task", [20, 10**6])
def test_quantiles_are_exact(spark, rows_per_task):
    df = keyed(spark)
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    out = order.quantiles(counts, ["k"], "v", "n", {"q50": 0.5, "q95": 0.95}, rows_per_task=rows_per_task).toPandas()
    pdf = df.toPandas()
    for r in out.itertuples():
        part = pdf[pdf["k"] == r.k]["v"]
        assert r.q50 == pytest.approx(part.quantile(0.5))
        assert r.q95 == pytest.approx(part.quantile(0.95))
