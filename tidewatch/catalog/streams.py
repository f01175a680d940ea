"""Streams over the event files, run until their input is used up.

In append mode a window is emitted once the watermark has passed its end. The SQL twins state the same
rule: windows that end no later than the newest event minus the allowed delay.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog import Registry, r, tidy, views
from tidewatch.catalog.batch import _LE, in_milliseconds, n, quantile_sql
from tidewatch.catalog.drift import compare_sql
from tidewatch.catalog.views import LOG_SQL
from tidewatch.operators import metrics, rollups, validate
from tidewatch.operators.drift import DriftConfig
from tidewatch.operators.validate import Rule
from tidewatch.operators.prepare import fit_sparse
from tidewatch.plans import drift_pass as passes
from tidewatch.plans import training
from tidewatch.session import prepare, shared_path
from tidewatch.sources import tables
from tidewatch.streaming import outcomes, run, scoring, triggers, windows
from tidewatch.streaming import rollups as stream_rollups

QUERIES = Registry()


def event_stream(spark, sf):
    """The events file as a stream."""
    schema = prepare(spark).read.parquet(f"{sf}/events.parquet").schema
    events = run.read_files(spark, sf, schema, "events.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def log_stream(spark, sf):
    return views.as_log(event_stream(spark, sf))


_WINDOW = "time_bucket(INTERVAL 5 MINUTE, created_at)"
_CLOSED = f"{_WINDOW} + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@QUERIES.add(f"WITH {LOG_SQL} SELECT {_WINDOW} AS window_start, prediction, model_version, {n()} AS n FROM log WHERE {_CLOSED} GROUP BY ALL")
def stream_predictions(spark, sf):
    return tidy(run.drain(stream_rollups.predictions(log_stream(spark, sf)), "stream-predictions"))


@QUERIES.add(
    f"WITH {LOG_SQL} SELECT {_WINDOW} AS window_start, model_version, CAST(b AS DOUBLE) AS bound, {n('probability <= b')} AS n FROM log, (VALUES "
    + ", ".join(f"({b}e0)" for b in rollups.SCORE_BOUNDS)
    + f") t(b) WHERE {_CLOSED} GROUP BY ALL"
)
def stream_score_histogram(spark, sf):
    return tidy(run.drain(stream_rollups.scores(log_stream(spark, sf)), "stream-scores"))


@QUERIES.add(f"""WITH {LOG_SQL} SELECT {_WINDOW} AS window_start, {n("event_type = 'error'")} AS errors, {n()} AS n FROM log WHERE {_CLOSED} GROUP BY 1""")
def stream_errors(spark, sf):
    return tidy(run.drain(stream_rollups.errors(log_stream(spark, sf), F.col("event_type") == "error"), "stream-errors"))


@QUERIES.add(
    f"""WITH {LOG_SQL} SELECT {_WINDOW} AS window_start, 'level-' || CAST(CAST(floor(k / 25e0) AS BIGINT) AS VARCHAR) AS error_type, {n()} AS errors
FROM log WHERE event_type = 'error' AND {_CLOSED} GROUP BY ALL"""
)
def stream_errors_by_type(spark, sf):
    typed = views.with_error_type(log_stream(spark, sf))
    return tidy(run.drain(stream_rollups.errors_by_type(typed, "error_type"), "stream-error-types"))


@QUERIES.add(
    f"""WITH {LOG_SQL}, h AS (SELECT {_WINDOW} AS window_start, {_LE} AS le, {n()} AS n, avg(latency) AS mean FROM log WHERE {_CLOSED} GROUP BY 1)
SELECT window_start, n, {r('mean * 1000', 'mean_ms')}, {r(quantile_sql(rollups.LATENCY_BOUNDS, 0.95), 'p95')} FROM h"""
)
def stream_latency(spark, sf):
    return in_milliseconds(run.drain(stream_rollups.latency(log_stream(spark, sf)), "stream-latency"))


EVENT_RULES = [
    Rule("event_type", allowed=("click", "view", "purchase", "signup")),
    Rule("value", low=0.0, high=50.0),
]


SCORED_NUMBERS, SCORED_TEXTS = ["value", "k"], ["event_type"]


def event_model(spark, sf):
    """A pipeline trained on the log's outcomes and saved; the path."""
    log = views.log(spark, sf).where("event_type <> 'error' and value <= 50")
    right = F.pmod(F.col("id") * 13 + F.col("k"), F.lit(5)) < 3
    rows = log.withColumn("outcome", F.when(right, F.col("prediction")).otherwise(1 - F.col("prediction")))
    rows = training.hold_out(rows, ["id"])
    preparation = fit_sparse(rows.where("not is_validation"), SCORED_NUMBERS, SCORED_TEXTS)
    model = training.train(rows, preparation, "outcome", validation="is_validation")
    path = shared_path(spark, "event-model")
    model.write().save(path)
    return path


def scored_log(scored):
    """What the stream logs of scored records."""
    decided = scored.withColumn("decision", metrics.decide(F.col("probability"), 0.5))
    return tables.pack_features(decided, [*SCORED_NUMBERS, *SCORED_TEXTS]).select("id", "request_id", "features", "decision", "probability")


@QUERIES.add(
    f"""WITH {LOG_SQL} SELECT CASE WHEN event_type = 'error' OR value > 50 THEN 'quarantine' ELSE 'log' END AS sink, {n()} AS n,
 CAST(count(DISTINCT id) AS BIGINT) AS n_ids, CAST(0 AS BIGINT) AS unlike_batch FROM log GROUP BY 1"""
)
def stream_scoring_and_quarantine(spark, sf):
    """A trained pipeline scores valid records into the log; invalid ones are kept apart with their violations.

    `unlike_batch` counts rows that a batch job with the same saved pipeline scores otherwise.
    """
    base, model = shared_path(spark, "stream-scoring"), event_model(spark, sf)
    job = scoring.ScoringJob.with_saved_model(
        spark, model, rules=EVENT_RULES, shape=scored_log, log_path=f"{base}/log", quarantine_path=f"{base}/quarantine"
    )
    records = log_stream(spark, sf).drop("probability")
    job.start(records, f"{base}/checkpoint").awaitTermination()
    logged, kept = job.written(spark, records.schema)
    again = job.sinks(views.log(spark, sf).drop("probability"))[0].select("id", F.struct("features", "decision", "probability").alias("batch"))
    compared = logged.join(again, "id", "full").select(
        F.lit("log").alias("sink"), "id", (~F.struct("features", "decision", "probability").eqNullSafe(F.col("batch"))).cast("long").alias("unlike")
    )
    rows = compared.unionByName(kept.select(F.lit("quarantine").alias("sink"), "id", F.lit(0).cast("long").alias("unlike")))
    return rows.groupBy("sink").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.sum("unlike").alias("unlike_batch"))


def outcome_stream(spark, sf):
    """Purchases are followed by their outcome some hours later (k of them); errors never get one."""
    log = log_stream(spark, sf).where("event_type <> 'error'")
    right = F.pmod(F.col("id") * 13 + F.col("k"), F.lit(5)) < 3
    return log.select(
        "request_id",
        F.when(right, F.col("prediction")).otherwise(1 - F.col("prediction")).alias("actual_label"),
        (F.col("created_at") + F.make_dt_interval(hours=F.col("k"))).alias("received_at"),
    )


_OUTCOME_SQL = f"""{LOG_SQL}, sent AS (SELECT id, CASE WHEN (id * 13 + k) % 5 < 3 THEN prediction ELSE 1 - prediction END AS actual_label,
  created_at + INTERVAL 1 HOUR * k AS received_at FROM log WHERE event_type <> 'error'),
mark AS (SELECT least((SELECT max(created_at) FROM log), (SELECT max(received_at) FROM sent)) - INTERVAL 1 HOUR AS w),
matched AS (SELECT log.*, s.actual_label, s.received_at FROM log LEFT JOIN sent s ON s.id = log.id AND s.received_at <= log.created_at + INTERVAL 48 HOUR)"""


@QUERIES.add(
    f"""WITH {_OUTCOME_SQL}
SELECT id, prediction, actual_label, received_at FROM matched WHERE actual_label IS NOT NULL OR created_at + INTERVAL 48 HOUR < (SELECT w FROM mark)"""
)
def stream_outcome_join(spark, sf):
    """Outcomes up to two days late; later ones count as missing."""
    log = log_stream(spark, sf).select("id", "request_id", "prediction", "model_version", "created_at")
    joined = outcomes.join_outcomes(log, outcome_stream(spark, sf), "48 hours")
    return tidy(run.drain(joined, "stream-outcomes").select("id", "prediction", "actual_label", "received_at"))


@QUERIES.add(
    f"""WITH {_OUTCOME_SQL}, days AS (SELECT date_trunc('day', created_at) AS d, model_version, count(*) FILTER (WHERE prediction = actual_label) AS c,
  count(*) FILTER (WHERE prediction <> actual_label) AS i FROM matched WHERE actual_label IS NOT NULL GROUP BY ALL),
starts AS (SELECT unnest(generate_series((SELECT min(d) FROM days) - INTERVAL 6 DAY, (SELECT max(d) FROM days), INTERVAL 1 DAY)) AS w)
SELECT CAST(w AS TIMESTAMP) AS window_start, CAST(w AS TIMESTAMP) + INTERVAL 7 DAY AS window_end, model_version, CAST(sum(c) AS BIGINT) AS correct, CAST(sum(i) AS BIGINT) AS incorrect,
 {r('sum(c) / (sum(c) + sum(i))', 'accuracy')} FROM starts JOIN days ON d >= w AND d < w + INTERVAL 7 DAY
WHERE w + INTERVAL 7 DAY + INTERVAL 48 HOUR <= (SELECT mark.w FROM mark) GROUP BY ALL"""
)
def stream_live_accuracy(spark, sf):
    """Sliding seven-day accuracy directly behind the outcome join, by daily panes; windows close once no outcome can come."""
    log = log_stream(spark, sf).select("id", "request_id", "prediction", "model_version", "created_at")
    joined = outcomes.join_outcomes(log, outcome_stream(spark, sf), "48 hours")
    return tidy(run.drain(outcomes.live_accuracy(joined), "stream-accuracy"))


@QUERIES.add(
    """SELECT user_id * 11 AS request_id, arg_max(CASE WHEN value > 20 THEN 1 ELSE 0 END, (ts, event_id)) AS actual_label, max(ts) AS received_at, arg_max(event_id, (ts, event_id)) AS seq
FROM events GROUP BY user_id"""
)
def stream_latest_labels(spark, sf):
    """Corrections keyed by request; the newest emitted row per request is the live view."""
    outcomes.use_rocksdb(spark)
    sent = event_stream(spark, sf).select(
        (F.col("user_id") * 11).alias("request_id"), (F.col("value") > 20).cast("int").alias("actual_label"),
        F.col("ts").alias("received_at"), F.col("event_id").alias("seq"),
    )
    emitted = run.drain(outcomes.latest_labels(sent), "stream-labels")
    newest = emitted.groupBy("request_id").agg(F.max_by(F.struct("actual_label", "received_at", "seq"), F.struct("received_at", "seq")).alias("l"))
    return tidy(newest.select("request_id", "l.*"))


@QUERIES.add(
    """WITH RECURSIVE b AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
chain AS (SELECT user_id, event_id, i, ts AS last_fired, true AS fired FROM b WHERE i = 1
  UNION ALL SELECT b.user_id, b.event_id, b.i, CASE WHEN b.ts >= c.last_fired + INTERVAL 43200 SECOND THEN b.ts ELSE c.last_fired END,
    b.ts >= c.last_fired + INTERVAL 43200 SECOND FROM chain c JOIN b ON b.user_id = c.user_id AND b.i = c.i + 1)
SELECT user_id, event_id AS id, fired FROM chain"""
)
def stream_trigger_cooldown(spark, sf):
    outcomes.use_rocksdb(spark)
    breaches = event_stream(spark, sf).where("event_type = 'error'").select("user_id", F.col("event_id").alias("id"), "ts")
    return run.drain(triggers.fire(breaches, "user_id", 43_200), "stream-cooldown").select("user_id", "id", "fired")


_FEATURES = ["value", "k", "event_type"]
_BASE_SQL = f"""WITH {LOG_SQL}, ref AS (SELECT value, k, event_type FROM log WHERE day(created_at) <= 7)"""


@QUERIES.add(
    compare_sql(
        _BASE_SQL
        + """, placed AS (SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY created_at, id) AS rn, count(*) OVER (PARTITION BY model_version) AS n_all FROM log),
cur AS (SELECT model_version, (rn - 1) // 500 AS window_id, value, k, event_type FROM placed WHERE least(500, n_all - (rn - 1) // 500 * 500) >= 100)""",
        _FEATURES, ["event_type"], by=["model_version", "window_id"], replicate=True,
    )
    + f" SELECT model_version, window_id, {r('avg(CASE WHEN drifted THEN 1.0 ELSE 0.0 END)', 'drift_share')} FROM tested GROUP BY ALL"
)
def stream_count_window_drift(spark, sf):
    """Rows wait until a window is large enough; each batch writes results before its ledger."""
    baseline = views.log(spark, sf).where(F.dayofmonth("created_at") <= 7).select(*_FEATURES)
    path = shared_path(spark, "stream-count-windows")
    handler = windows.CountWindowDrift(
        baseline, path, _FEATURES, ("created_at", "id"), ("model_version",), passes.PassConfig(window_size=500, min_samples=100)
    )
    run.to_batches(log_stream(spark, sf), handler, shared_path(spark, "stream-count-windows-checkpoint")).awaitTermination()
    return tidy(handler.read(spark, "windows").select("model_version", "window_id", "drift_share"))


@QUERIES.add(
    compare_sql(
        _BASE_SQL
        + """, cur AS (SELECT date_trunc('day', created_at) AS window_start, value, k, event_type FROM log
 WHERE date_trunc('day', created_at) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)""",
        _FEATURES, ["event_type"], by=["window_start"], replicate=True,
    )
    + " SELECT CAST(window_start AS TIMESTAMP) AS window_start, feature, test, statistic, p_value, drifted FROM tested"
)
def stream_event_time_drift(spark, sf):
    """Daily windows: counts are kept by the stream, the tests run when a day is closed."""
    baseline = views.log(spark, sf).where(F.dayofmonth("created_at") <= 7).select(*_FEATURES)
    text = frozenset(["event_type"])
    counts = stream_rollups.drift_counts(log_stream(spark, sf), _FEATURES, text, "created_at", "1 hour", "1 day")
    handler = windows.EventTimeDrift(baseline, shared_path(spark, "stream-event-time"), _FEATURES, text, DriftConfig())
    run.to_batches(counts, handler, shared_path(spark, "stream-event-time-checkpoint")).awaitTermination()
    return tidy(handler.read(spark).select("window_start", "feature", "test", "statistic", "p_value", "drifted"))
