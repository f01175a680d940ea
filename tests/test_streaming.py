"""Streams: results equal the batch result below the final watermark, in any number of batches."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import labels, rollups
from tidewatch.operators.validate import Rule
from tidewatch.plans.drift_pass import PassConfig
from tidewatch.streaming import outcomes, run, scoring, triggers, windows
from tidewatch.streaming import rollups as stream_rollups

T0 = dt.datetime(2024, 1, 1)


def rows(spark, n=600):
    return spark.range(n).select(
        F.col("id"), F.col("id").cast("string").alias("request_id"), (F.lit(T0) + F.make_dt_interval(mins=F.col("id"))).alias("created_at"),
        (F.col("id") % 2).cast("int").alias("prediction"), F.lit("v1").alias("model_version"), ((F.col("id") * 37) % 100 / 100.0).alias("probability"),
        ((F.col("id") * 13) % 97 / 50.0).alias("latency"), F.col("id").cast("double").alias("value"),
    )


def as_stream(spark, df, path, parts=3, order="created_at"):
    """The frame as files that arrive in time order, one per micro-batch."""
    path = str(path)
    n = df.count()
    ranked = df.orderBy(order).toPandas()
    for i in range(parts):
        piece = ranked.iloc[i * n // parts: (i + 1) * n // parts]
        spark.createDataFrame(piece, df.schema).coalesce(1).write.mode("append").parquet(path)
    return run.read_files(spark, path, df.schema, "*.parquet", per_trigger=1)


def test_rollups_equal_batch(spark, tmp_path):
    df = rows(spark)
    stream = as_stream(spark, df, tmp_path / "in")
    got = run.drain(stream_rollups.predictions(stream), "t").toPandas()
    limit = T0 + dt.timedelta(minutes=599 - 10)
    want = rollups.count_per_window(df, "created_at", ["prediction", "model_version"]).toPandas()
    want = want[want.window_start + dt.timedelta(minutes=5) <= limit]
    assert len(got) == len(want) and got.n.sum() == want.n.sum()
    latency = run.drain(stream_rollups.latency(as_stream(spark, df, tmp_path / "in2")), "t").toPandas()
    batch = rollups.latency_per_window(df, "created_at", "latency").toPandas().set_index("window_start")
    for r in latency.itertuples():
        assert r.p95 == pytest.approx(batch.loc[r.window_start, "p95"])


def test_outcome_join_and_accuracy(spark, tmp_path):
    df = rows(spark, 400)
    # Every second prediction gets an outcome an hour later; a marker row moves the watermark on.
    sent = df.where("id % 2 = 0").select(
        "request_id", F.lit(0).alias("actual_label"), (F.col("created_at") + F.expr("interval 1 hour")).alias("received_at")
    )
    later = T0 + dt.timedelta(days=30)
    marker = rows(spark, 1).withColumns({"request_id": F.lit("m"), "created_at": F.lit(later)})
    marker_label = spark.createDataFrame([("zz", 0, later)], sent.schema)
    left = as_stream(spark, df.unionByName(marker), tmp_path / "log", 2)
    right = as_stream(spark, sent.unionByName(marker_label), tmp_path / "labels", 2, order="received_at")
    joined = outcomes.join_outcomes(left, right, "1 day")
    out = run.drain(joined, "t").toPandas()
    assert len(out) == 400 and out.actual_label.notna().sum() == 200
    again = outcomes.join_outcomes(
        run.read_files(spark, str(tmp_path / "log"), df.schema, "*.parquet", 1), run.read_files(spark, str(tmp_path / "labels"), sent.schema, "*.parquet", 1), "1 day"
    )
    accuracy = run.drain(outcomes.live_accuracy(again), "t").toPandas()
    assert len(accuracy) == 7 and (accuracy.correct == 200).all() and (accuracy.incorrect == 0).all()


def test_sliding_accuracy_by_panes_equals_the_batch_and_keeps_a_row_per_pane(spark, tmp_path):
    step = F.make_dt_interval(hours=F.col("id"))
    df = rows(spark, 600).withColumns({"created_at": F.lit(T0) + step, "model_version": F.concat(F.lit("v"), F.col("id") % 2)})
    sent = df.select("request_id", (F.col("id") % 5 < 3).cast("int").alias("actual_label"), (F.col("created_at") + F.expr("interval 2 hours")).alias("received_at"))
    joined = outcomes.join_outcomes(as_stream(spark, df, tmp_path / "log", 4), as_stream(spark, sent, tmp_path / "labels", 4, "received_at"), "1 day")
    path = str(tmp_path / "out")
    query = run.to_files(outcomes.live_accuracy(joined), path, str(tmp_path / "cp"))
    query.awaitTermination()
    got = {(r["window_start"], r["model_version"]): (r["correct"], r["incorrect"]) for r in spark.read.parquet(path).collect()}
    labelled = df.join(sent, "request_id")
    batch = labels.live_accuracy(labelled, "created_at", "7 days", "1 day", ["model_version"])
    # The last prediction's hour, less the lateness and the longest delay.
    closed = T0 + dt.timedelta(hours=599 - 1 - 24)
    want = {(r["window_start"], r["model_version"]): (r["correct"], r["incorrect"]) for r in batch.collect() if r["window_end"] <= closed}
    assert got == want and len(got) > 30
    kept = [s.numRowsTotal for s in query.lastProgress.stateOperators if "Aggregat" in s.operatorName or s.operatorName == "stateStoreSave"]
    # Two versions: some open days and the windows over them, not 600 predictions.
    assert kept and max(kept) <= 2 * 10


def test_latest_label_and_cooldown_keep_state_between_batches(spark, tmp_path):
    outcomes.use_rocksdb(spark)
    sent = spark.range(9).select(
        F.concat(F.lit("r"), F.col("id") % 3).alias("request_id"), (F.col("id") % 2).cast("int").alias("actual_label"), (F.lit(T0) + F.make_dt_interval(mins=F.col("id"))).alias("received_at"), F.col("id").alias("seq")
    )
    out = run.drain(outcomes.latest_labels(as_stream(spark, sent, tmp_path / "l", 3, "received_at")), "t").toPandas()
    assert len(out) == 9
    newest = out.sort_values("seq").groupby("request_id").tail(1)
    assert dict(zip(newest.request_id, newest.actual_label)) == {"r0": 0, "r1": 1, "r2": 0}

    times = [0, 100, 3599, 3600, 3700, 7199, 7200]
    breaches = spark.createDataFrame([("k", i, T0 + dt.timedelta(seconds=t)) for i, t in enumerate(times)], "k string, id long, ts timestamp")
    out = run.drain(triggers.fire(as_stream(spark, breaches, tmp_path / "b", 3, "ts"), "k", 3600), "t").toPandas()
    assert out.sort_values("id").fired.tolist() == [True, False, False, True, False, False, True]


def saved_model(spark, path):
    from tidewatch.operators import prepare
    from tidewatch.plans import training

    df = rows(spark, 300).withColumns({"y": (F.col("value") % 40 < 15).cast("int"), "kind": F.concat(F.lit("k"), F.col("id") % 3)})
    fitted = prepare.fit_sparse(df, ["value", "latency"], ["kind"])
    training.train(df, fitted, "y", training.BoostingParams(rounds=4, depth=3, rate=0.5)).write().save(path)


def scoring_job(spark, tmp_path):
    return scoring.ScoringJob.with_saved_model(
        spark, str(tmp_path / "model"), rules=[Rule("value", low=0.0, high=79.0)],
        shape=lambda scored: scored.select("request_id", "probability"), log_path=str(tmp_path / "log"), quarantine_path=str(tmp_path / "bad"),
    )


def test_scoring_stream_and_quarantine(spark, tmp_path):
    saved_model(spark, str(tmp_path / "model"))
    job = scoring_job(spark, tmp_path)
    records = rows(spark, 100).withColumn("kind", F.concat(F.lit("k"), F.col("id") % 4)).drop("probability")
    stream = as_stream(spark, records, tmp_path / "in", 2)
    job.start(stream, str(tmp_path / "cp")).awaitTermination()
    log, bad = job.written(spark, records.schema)
    # Row by row what a batch job gives.
    want = {r["request_id"]: r["probability"] for r in job.sinks(records)[0].collect()}
    assert len(want) == 80 and len({round(p, 6) for p in want.values()}) > 3
    assert {r["request_id"]: r["probability"] for r in log.collect()} == want and log.count() == 80
    assert bad.count() == 20 and bad.first()["violations"] == ["value:too_high"]
    # Starting again finds nothing new.
    job.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert job.written(spark, records.schema)[0].count() == 80


def test_a_repeated_scoring_batch_changes_nothing_and_completes_the_other_sink(spark, tmp_path, monkeypatch):
    from tidewatch.sources import tables

    saved_model(spark, str(tmp_path / "model"))
    job = scoring_job(spark, tmp_path)
    records = rows(spark, 100).withColumn("kind", F.lit("k1")).drop("probability")
    append = tables.append_committed

    def stops_before_quarantine(df, path, commit):
        if path.endswith("bad"):
            raise OSError("the driver is gone")
        return append(df, path, commit)

    with monkeypatch.context() as patch:
        patch.setattr(tables, "append_committed", stops_before_quarantine)
        with pytest.raises(OSError):
            job.handle(records, 0)
    counts = lambda: [df.count() for df in job.written(spark, records.schema)]
    assert counts() == [80, 0]
    job.handle(records, 0)
    job.handle(records, 0)
    assert counts() == [80, 20]
    job.handle(records, 1)
    assert counts() == [160, 40]


def test_count_windows_wait_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    baseline = rows(spark, 300).select("value")
    handler = windows.CountWindowDrift(baseline, str(tmp_path / "out"), ["value"], config=PassConfig(window_size=200, min_samples=150))
    df = rows(spark, 400)
    batches = [df.where("id < 100"), df.where("id >= 100 and id < 260"), df.where("id >= 260")]
    handler(batches[0], 0)
    assert not (tmp_path / "out" / "windows").exists()
    handler(batches[1], 1)
    handler(batches[1], 1)
    first = handler.read(spark, "windows")
    assert [(r["batch"], r["analyzed_rows"]) for r in first.collect()] == [(1, 200)]
    handler(batches[2], 2)
    assert handler.read(spark, "ledger").select("id").distinct().count() == 400
    assert handler.read(spark, "windows").agg(F.sum("analyzed_rows")).first()[0] == 400
    assert handler.read(spark, "features").count() == 2


def test_event_time_drift(spark, tmp_path):
    df = rows(spark, 600)
    baseline = df.select("value", "model_version")
    stream = as_stream(spark, df, tmp_path / "in", 2)
    counts = stream_rollups.drift_counts(stream, ["value", "model_version"], {"model_version"}, "created_at", "1 minute", "2 hours")
    handler = windows.EventTimeDrift(baseline, str(tmp_path / "out"), ["value", "model_version"], frozenset({"model_version"}))
    run.to_batches(counts, handler, str(tmp_path / "cp")).awaitTermination()
    out = handler.read(spark).toPandas()
    assert out.window_start.nunique() == 4 and (out.n_cur == 120).all()
    assert out[out.feature == "value"].drifted.all() and not out[out.feature == "model_version"].drifted.any()
