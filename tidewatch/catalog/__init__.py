"""Registered queries: each operator applied to whole tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Registry(dict):
    """name -> Query, filled by decorating the Spark side."""

    def add(self, sql: str | None = None, name: str | None = None):
        def wrap(fn):
            self[name or fn.__name__] = Query(fn, sql)
            return fn

        return wrap


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded and instants without zone, the form both engines are compared in."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(column, DIGITS)
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        out.append(column.alias(field.name))
    return df.select(*out)


def r(expression: str, name: str | None = None) -> str:
    """SQL rounding that matches `tidy` (adding zero turns -0.0 into 0.0)."""
    return f"(round({expression}, {DIGITS}) + 0.0) AS {name or expression}"


def all_queries() -> dict[str, Query]:
    from tidewatch.catalog import batch, drift, models, streams

    out: dict[str, Query] = {}
    for registry in (drift.QUERIES, batch.QUERIES, models.QUERIES, streams.QUERIES):
        out.update(registry)
    return out
