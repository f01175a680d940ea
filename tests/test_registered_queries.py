"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("ORACLE_SF_DIR", entry_points.SMOKE_DIR)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return str(pd.Timestamp(v)) if hasattr(v, "year") else repr(float(v)) if isinstance(v, float) else str(v)

    pdf = pdf[sorted(pdf.columns)]
    columns = [pdf[c].astype(object).map(text) for c in pdf.columns]
    return sorted(zip(*columns))


def normalised(rows: list[tuple]) -> list[tuple]:
    """Whole numbers alike, whether a null made pandas turn the column to float or not."""
    def whole(v: str) -> str:
        return v[:-2] if v.endswith(".0") and v[:-2].lstrip("-").isdigit() else v

    return sorted(tuple(whole(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, duck, name):
    out = entry_points.queries()[name](spark, SF_DIR).toPandas()
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert len(out) > 0
        return
    want = duck.execute(sql).df()
    assert sorted(out.columns) == sorted(want.columns)
    assert normalised(canonical(out)) == normalised(canonical(want))


def test_entry(spark):
    row = entry_points.entry(spark).first()
    assert row["dataset_drift"] and row["number_of_columns"] == 6
