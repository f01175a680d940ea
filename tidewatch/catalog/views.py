"""The given tables in the roles of the monitoring loop, as Spark frames and as SQL text.

events     prediction log: probability k/100, class 1 from k = 50 on, version by week of the month
documents  second log, scored by two fixed expressions of the length; `labels` holds late outcomes
customer   third log keyed by customer; events of a user are re-sent labels
lineitem   baseline before a ship date, current data from that date on
orders     raw table with a text target
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import prepare

CUT_DATE = "1998-06-01"
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf: str, name: str, where: str | None = None) -> DataFrame:
    """A given table, with zoneless times read as UTC instants.

    `where` applies to the columns as stored, so that it reaches the Parquet scan.
    """
    df = prepare(spark).read.parquet(f"{sf}/{name}.parquet")
    if where:
        df = df.where(where)
    times = {
        f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)
    }
    return df.withColumns(times) if times else df


def as_log(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    week = F.floor((F.dayofmonth("ts") - 1) / 7) + 1
    return events.select(
        F.col("event_id").alias("id"),
        F.col("event_id").cast("string").alias("request_id"),
        F.col("ts").alias("created_at"),
        "user_id",
        "event_type",
        "value",
        "props",
        k.alias("k"),
        (k / 100.0).alias("probability"),
        (k >= 50).cast("int").alias("prediction"),
        F.concat(F.lit("v"), week.cast("string")).alias("model_version"),
        (F.col("value") / 1000.0).alias("latency"),
    )


def log(spark: SparkSession, sf: str) -> DataFrame:
    return as_log(table(spark, sf, "events"))


def with_error_type(log: DataFrame) -> DataFrame:
    """The log with a type for rows that are errors, made from the data."""
    level = F.concat(F.lit("level-"), F.floor(F.col("k") / 25).cast("string"))
    return log.withColumn("error_type", F.when(F.col("event_type") == "error", level))


LOG_SQL = """log AS (
  SELECT event_id AS id, CAST(event_id AS VARCHAR) AS request_id, ts AS created_at, user_id, event_type, value, props, k,
         k / 1e2 AS probability, CASE WHEN k >= 50 THEN 1 ELSE 0 END AS prediction,
         'v' || CAST(CAST(floor((day(ts) - 1) / 7) AS INTEGER) + 1 AS VARCHAR) AS model_version, value / 1e3 AS latency
  FROM (SELECT *, CAST(CAST(props AS JSON)->>'k' AS INTEGER) AS k FROM events))"""


def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a candidate and a live score."""
    docs = table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("request_id"),
        "lang",
        "source",
        "n_chars",
        (F.pmod(F.col("n_chars") * 37, F.lit(1000)) / 1000.0).alias("candidate_score"),
        (F.pmod(F.col("n_chars") * 91 + F.col("doc_id"), F.lit(1000)) / 1000.0).alias("live_score"),
    )


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = table(spark, sf, "labels").withColumnRenamed("doc_id", "request_id")
    return scored_documents(spark, sf).join(outcomes, "request_id")


DOCS_SQL = """docs AS (
  SELECT doc_id AS request_id, lang, source, n_chars, (n_chars * 37 % 1000) / 1e3 AS candidate_score,
         ((n_chars * 91 + doc_id) % 1000) / 1e3 AS live_score FROM documents),
scored AS (SELECT d.*, l.quality, l.toxic FROM docs d JOIN labels l ON l.doc_id = d.request_id)"""


def customer_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"),
        (F.col("c_acctbal") > 4500).cast("int").alias("prediction"),
        F.col("c_mktsegment").alias("segment"),
    )


def sent_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels sent again and again per request, some for requests nobody logged."""
    return table(spark, sf, "events").select(
        (F.col("user_id") * 11).alias("request_id"),
        (F.col("value") > 20).cast("int").alias("actual_label"),
        F.col("ts").alias("received_at"),
        F.col("event_id").alias("seq"),
    )


CUSTOMER_SQL = """clog AS (
  SELECT c_custkey AS request_id, CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END AS prediction, c_mktsegment AS segment FROM customer),
sent AS (
  SELECT user_id * 11 AS request_id, CASE WHEN value > 20 THEN 1 ELSE 0 END AS actual_label, ts AS received_at, event_id AS seq FROM events)"""


def line_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem", f"l_shipdate < timestamp_ntz'{CUT_DATE}'")


def line_current(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem", f"l_shipdate >= timestamp_ntz'{CUT_DATE}'")


LINE_SQL = f"""ref AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT_DATE}'),
cur AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT_DATE}')"""


def raw_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a raw file would hold them: price as text with blanks, outcome as text."""
    o = table(spark, sf, "orders")
    price = F.when(F.col("o_orderkey") % 17 == 0, F.lit(" ")).otherwise(F.format_string("%.2f", "o_totalprice"))
    outcome = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "No").otherwise("pending")
    return o.select(
        "o_orderkey", price.alias("o_totalprice"), "o_orderpriority", F.col("o_orderdate"), outcome.alias("returned")
    )


RAW_SQL = """raw AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE printf('%.2f', o_totalprice) END AS o_totalprice,
         o_orderpriority, o_orderdate,
         CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' ELSE 'pending' END AS returned FROM orders),
cleaned AS (
  SELECT o_orderkey, try_cast(o_totalprice AS DOUBLE) AS o_totalprice, o_orderpriority, o_orderdate,
         CASE returned WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS returned
  FROM raw WHERE try_cast(o_totalprice AS DOUBLE) IS NOT NULL AND returned IN ('Yes', 'No'))"""
