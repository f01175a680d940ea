"""Labels, metrics, comparison, data sets, preparation and roll-ups over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.catalog import Registry, r, tidy, views
from tidewatch.catalog.views import CUSTOMER_SQL, DOCS_SQL, LOG_SQL, RAW_SQL
from tidewatch.operators import clean, labels, metrics, order, prepare, rollups, split, validate
from tidewatch.operators.validate import Rule
from tidewatch.plans import assembly, promotion
from tidewatch.session import shared_path
from tidewatch.sources import schemas, tables

QUERIES = Registry()


def n(condition: str | None = None) -> str:
    return "CAST(count(*) AS BIGINT)" if condition is None else f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)"


# ---- sources

RAW_SCHEMA = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_totalprice", T.StringType()),
        T.StructField("o_orderpriority", T.StringType()),
        T.StructField("returned", T.StringType()),
    ]
)


@QUERIES.add("WITH " + RAW_SQL + " SELECT o_orderkey, o_totalprice, o_orderpriority, returned FROM cleaned")
def raw_csv_clean(spark, sf):
    """Write the raw orders as CSV, read them back by name, and clean them."""
    path = shared_path(spark, "raw-csv")
    views.raw_orders(spark, sf).drop("o_orderdate").write.option("header", True).csv(path)
    raw = tables.read_raw_csv(spark, path, RAW_SCHEMA)
    return tidy(clean.clean(raw, "returned", "o_totalprice", ["absent"]))


@QUERIES.add(
    "WITH "
    + RAW_SQL
    + f""" SELECT {n()} AS rows_read, {n("try_cast(o_totalprice AS DOUBLE) IS NULL")} AS dropped_number,
 {n("try_cast(o_totalprice AS DOUBLE) IS NOT NULL AND returned = 'pending'")} AS dropped_target,
 {n("try_cast(o_totalprice AS DOUBLE) IS NOT NULL AND returned <> 'pending'")} AS rows_kept FROM raw"""
)
def clean_step_counts(spark, sf):
    return clean.clean_counts(views.raw_orders(spark, sf), "returned", "o_totalprice")


@QUERIES.add(f"WITH {LOG_SQL} SELECT id, k FROM log")
def json_features_known_schema(spark, sf):
    log = views.log(spark, sf).select("id", F.col("props").alias("features"))
    return tables.unpack_features(log, T.StructType([T.StructField("k", T.IntegerType())]))


@QUERIES.add(
    f"WITH {LOG_SQL} SELECT id, CAST(k AS DOUBLE) AS k, CAST(NULL AS VARCHAR) AS absent FROM log"
)
def json_features_open_schema(spark, sf):
    log = views.log(spark, sf).select("id", F.col("props").alias("features"))
    return tables.unpack_open_features(log, {"k": "double", "absent": "string"})


@QUERIES.add(
    f"""WITH {LOG_SQL} SELECT id, k AS k_2, CAST(CASE WHEN id % 3 = 0 THEN k ELSE value END AS DOUBLE) AS amount, event_type = 'click' AS clicked,
 CASE id % 3 WHEN 0 THEN event_type WHEN 1 THEN CAST(k AS VARCHAR) ELSE '{{"k":' || CAST(k AS VARCHAR) || '}}' END AS mixed,
 CASE WHEN id % 2 = 0 THEN user_id END AS user_id, CASE WHEN id % 2 = 1 THEN event_type END AS kind, CAST(1 + id % 3 AS BIGINT) AS n_parts FROM log"""
)
def json_features_inferred(spark, sf):
    """Columns and types from the log itself: nested keys, keys of some rows only, numbers of two kinds, clashing types."""
    k, text = F.col("k"), F.col("k").cast("string")
    mixed = F.when(F.col("id") % 3 == 0, F.to_json(F.array("event_type"))).when(F.col("id") % 3 == 1, F.concat(F.lit("["), text, F.lit("]")))
    mixed = mixed.otherwise(F.concat(F.lit('[{"k":'), text, F.lit("}]")))
    nested = F.when(F.col("id") % 2 == 0, F.to_json(F.struct("user_id"))).otherwise(F.to_json(F.struct(F.col("event_type").alias("kind"))))
    amount = F.when(F.col("id") % 3 == 0, text).otherwise(F.col("value").cast("string"))
    cells = {
        "K": text, "amount": amount, "clicked": (F.col("event_type") == "click").cast("string"),
        "mixed": F.expr("substring(_mixed, 2, length(_mixed) - 2)"), "at": F.col("_nested"),
        "parts": F.to_json(F.expr("transform(sequence(0, id % 3), i -> named_struct('i', i))")),
    }
    listed = F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), cell) for name, cell in cells.items()])
    log = views.log(spark, sf).withColumns({"_mixed": mixed, "_nested": nested})
    packed = log.select("id", k, F.concat(F.lit("{"), listed, F.lit("}")).alias("features"))
    found = tables.unpack_all_features(packed)
    return found.select(
        "id", F.col("K_2").alias("k_2"), "amount", "clicked", "mixed", "at.user_id", "at.kind", F.size("parts").cast("long").alias("n_parts")
    )


@QUERIES.add(
    f"SELECT feature, {n()} AS rows FROM (SELECT unnest(json_keys(CAST(props AS JSON))) AS feature FROM events) GROUP BY feature"
)
def json_feature_keys(spark, sf):
    return tables.feature_keys(views.log(spark, sf).withColumnRenamed("props", "features"))


@QUERIES.add(f"WITH {LOG_SQL} SELECT id, CAST(to_json({{'event_type': event_type, 'value': value, 'k': k}}) AS VARCHAR) AS features FROM log")
def features_to_json(spark, sf):
    return tables.pack_features(views.log(spark, sf), ["event_type", "value", "k"]).select("id", "features")


def log_records(spark, sf):
    log = tables.pack_features(views.log(spark, sf), ["event_type", "value", "k"])
    return log.select(
        F.col("id").cast("string").alias("id"), "request_id", "features", "prediction", "probability", "model_version",
        (F.dayofmonth("created_at") <= 10).alias("drift_analyzed"), "created_at",
    )


@QUERIES.add(
    f"""WITH {LOG_SQL} SELECT model_version, day(created_at) <= 10 AS drift_analyzed, {n()} AS rows, CAST(sum(prediction) AS BIGINT) AS positives,
 CAST(0 AS BIGINT) AS labelled FROM log GROUP BY ALL"""
)
def append_prediction_log(spark, sf):
    """Append in two batches to the log table and read it back with its schema."""
    path = shared_path(spark, "prediction-log")
    records = log_records(spark, sf)
    tables.append_predictions(records.where("prediction = 1"), path)
    tables.append_predictions(records.where("prediction = 0"), path)
    return tables.read_predictions(spark, path).groupBy("model_version", "drift_analyzed").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("prediction").alias("positives"), F.count("actual_label").alias("labelled")
    )


@QUERIES.add(f"WITH {LOG_SQL} SELECT id, created_at FROM log WHERE day(created_at) > 10 ORDER BY created_at, id LIMIT 1000")
def oldest_pending_rows(spark, sf):
    """Top-k report: the oldest thousand rows not yet analysed."""
    log = log_records(spark, sf).withColumn("id", F.col("id").cast("long"))
    return tidy(tables.pending_rows(log, 1000).select("id", "created_at"))


@QUERIES.add(
    f"""WITH {LOG_SQL} SELECT request_id[1:8] || '…' AS request_id, prediction, {r('round(probability, 3)', 'probability')}, model_version,
 strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM log ORDER BY log.created_at DESC, id DESC LIMIT 5"""
)
def newest_rows_for_display(spark, sf):
    """Top-k report: the five newest rows, shortened."""
    return tidy(tables.recent_rows(views.log(spark, sf)))


@QUERIES.add("WITH " + DOCS_SQL + " SELECT request_id, quality AS actual_label FROM scored")
def labelled_scan(spark, sf):
    outcomes = views.table(spark, sf, "labels").withColumnRenamed("doc_id", "request_id")
    docs = views.scored_documents(spark, sf).join(outcomes, "request_id", "left")
    return tables.labelled_rows(docs.withColumnRenamed("quality", "actual_label")).select("request_id", "actual_label")


@QUERIES.add(
    f"""WITH {LOG_SQL} SELECT model_version, {n()} AS rows, CAST(0 AS BIGINT) AS labels, CAST(0 AS BIGINT) AS times FROM log GROUP BY 1"""
)
def schema_evolution(spark, sf):
    """A log from before labels existed gains the two nullable columns; a second run adds nothing."""
    legacy = log_records(spark, sf)
    aligned, added = tables.align_to_schema(legacy, schemas.PREDICTION_LOG)
    _, again = tables.align_to_schema(aligned, schemas.PREDICTION_LOG)
    if added != ["actual_label", "label_received_at"] or again:
        raise AssertionError(f"unexpected columns: {added}, {again}")
    return aligned.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("rows"), F.count("actual_label").alias("labels"), F.count("label_received_at").alias("times")
    )


# ---- validation

ORDER_RULES = [
    Rule("o_orderstatus", allowed=("F", "O")),
    Rule("o_orderpriority", allowed=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")),
    Rule("o_totalprice", low=2000.0, high=400_000.0),
]


@QUERIES.add(
    f"""SELECT violations, {n()} AS n FROM (SELECT array_to_string(list_filter([
 CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus:not_allowed' END,
 CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') THEN 'o_orderpriority:not_allowed' END,
 CASE WHEN o_totalprice < 2000 THEN 'o_totalprice:too_low' WHEN o_totalprice > 400000 THEN 'o_totalprice:too_high' END],
 lambda x: x IS NOT NULL), ';') AS violations FROM orders) GROUP BY 1"""
)
def record_validation(spark, sf):
    checked = validate.with_violations(views.table(spark, sf, "orders"), ORDER_RULES)
    return checked.groupBy(F.array_join("violations", ";").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add(
    f"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS request_id, quality + 2 * toxic AS actual_label FROM labels)
SELECT actual_label IN (0, 1) AS valid, {n()} AS n FROM l GROUP BY 1"""
)
def label_validation(spark, sf):
    sent = views.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("request_id"), (F.col("quality") + 2 * F.col("toxic")).alias("actual_label")
    )
    valid, quarantined = validate.split_valid(sent, validate.LABEL_RULES)
    both = valid.select(F.lit(True).alias("valid")).unionByName(quarantined.select(F.lit(False).alias("valid")))
    return both.groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add(
    f"""WITH {LOG_SQL}, p AS (SELECT *, CASE event_type WHEN 'click' THEN 0.3 WHEN 'view' THEN 0.75 ELSE 0.5 END AS threshold FROM log)
SELECT event_type, CAST(threshold AS DOUBLE) AS threshold, CAST(sum(CASE WHEN probability >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM p GROUP BY ALL"""
)
def decision_thresholds(spark, sf):
    """Thresholds from a parameter map; missing or unreadable ones fall back to one half."""
    params = (
        F.when(F.col("event_type") == "click", F.create_map(F.lit("threshold"), F.lit("0.3")))
        .when(F.col("event_type") == "view", F.create_map(F.lit("threshold"), F.lit("0.75")))
        .when(F.col("event_type") == "error", F.create_map(F.lit("threshold"), F.lit("high")))
        .otherwise(F.create_map(F.lit("depth"), F.lit("6")))
    )
    log = views.log(spark, sf).withColumn("threshold", metrics.decision_threshold(params))
    decided = log.withColumn("decision", metrics.decide(F.col("probability"), F.col("threshold")))
    return decided.groupBy("event_type", "threshold").agg(F.sum("decision").alias("positives"))


@QUERIES.add(
    """SELECT c_custkey, c_acctbal, c_mktsegment FROM customer"""
)
def feature_projection(spark, sf):
    """Model features of a table, in the order of the feature list; everything else is dropped."""
    rows = views.table(spark, sf, "customer")
    x, _ = clean.split_features(rows.select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey"), "c_nationkey")
    return x


# ---- labels

@QUERIES.add(
    "WITH "
    + CUSTOMER_SQL
    + """, newest AS (SELECT request_id, arg_max(actual_label, (received_at, seq)) AS actual_label, max(received_at) AS label_received_at FROM sent GROUP BY 1)
SELECT request_id, prediction, segment, actual_label, label_received_at FROM clog LEFT JOIN newest USING (request_id)"""
)
def attach_labels(spark, sf):
    return tidy(labels.attach_labels(views.customer_log(spark, sf), views.sent_labels(spark, sf), ["received_at", "seq"]))


@QUERIES.add(
    "WITH "
    + CUSTOMER_SQL
    + """ SELECT request_id, arg_max(actual_label, (received_at, seq)) AS actual_label, max(received_at) AS label_received_at FROM sent GROUP BY 1"""
)
def latest_label_per_request(spark, sf):
    return tidy(labels.latest_labels(views.sent_labels(spark, sf), ["received_at", "seq"]))


@QUERIES.add(
    "WITH "
    + CUSTOMER_SQL
    + f""", j AS (SELECT s.actual_label, c.prediction FROM sent s LEFT JOIN clog c USING (request_id))
SELECT {n('prediction IS NOT NULL')} AS updated, {n('prediction = actual_label')} AS correct, {n('prediction <> actual_label')} AS incorrect,
 {n('prediction IS NULL')} AS unknown FROM j"""
)
def label_result(spark, sf):
    return labels.label_result(views.customer_log(spark, sf), views.sent_labels(spark, sf))


@QUERIES.add("WITH " + CUSTOMER_SQL + f" SELECT request_id, {n()} AS sent FROM sent WHERE request_id NOT IN (SELECT request_id FROM clog) GROUP BY 1")
def unknown_labels(spark, sf):
    unknown = labels.unknown_labels(views.sent_labels(spark, sf), views.customer_log(spark, sf))
    return unknown.groupBy("request_id").agg(F.count(F.lit(1)).alias("sent"))


@QUERIES.add("WITH " + CUSTOMER_SQL + " SELECT * FROM clog WHERE request_id IN (SELECT request_id FROM sent)")
def rows_named_in_batch(spark, sf):
    return labels.labelled_log(views.customer_log(spark, sf), views.sent_labels(spark, sf))


@QUERIES.add(f"WITH {LOG_SQL} SELECT model_version, {n()} AS waiting FROM log WHERE day(created_at) > 10 GROUP BY 1")
def rows_not_in_ledger(spark, sf):
    log = views.log(spark, sf)
    ledger = log.where(F.dayofmonth("created_at") <= 10).select("id")
    return labels.unanalysed(log, ledger).groupBy("model_version").agg(F.count(F.lit(1)).alias("waiting"))


_OUTCOME = "CASE WHEN (id * 13 + k) % 5 < 3 THEN prediction ELSE 1 - prediction END"


def with_outcomes(log):
    """A fixed stand-in for the outcome: three of five predictions were right, sign-ups have none yet."""
    right = F.pmod(F.col("id") * 13 + F.col("k"), F.lit(5)) < 3
    label = F.when(right, F.col("prediction")).otherwise(1 - F.col("prediction"))
    return log.withColumn("actual_label", F.when(F.col("event_type") != "signup", label))


@QUERIES.add(
    f"""WITH {LOG_SQL}, l AS (SELECT *, CASE WHEN event_type <> 'signup' THEN {_OUTCOME} END AS actual_label FROM log),
days AS (SELECT date_trunc('day', created_at) AS d, model_version, count(*) FILTER (WHERE prediction = actual_label) AS c,
  count(*) FILTER (WHERE prediction <> actual_label) AS i FROM l WHERE actual_label IS NOT NULL GROUP BY ALL),
starts AS (SELECT unnest(generate_series((SELECT min(d) FROM days) - INTERVAL 6 DAY, (SELECT max(d) FROM days), INTERVAL 1 DAY)) AS w)
SELECT CAST(w AS TIMESTAMP) AS window_start, CAST(w AS TIMESTAMP) + INTERVAL 7 DAY AS window_end, model_version, CAST(sum(c) AS BIGINT) AS correct, CAST(sum(i) AS BIGINT) AS incorrect,
 {r('sum(c) / (sum(c) + sum(i))', 'accuracy')} FROM starts JOIN days ON d >= w AND d < w + INTERVAL 7 DAY GROUP BY ALL"""
)
def live_accuracy_7_days(spark, sf):
    return tidy(labels.live_accuracy(with_outcomes(views.log(spark, sf)), "created_at", "7 days", "1 day", ["model_version"]))


# ---- classifier metrics

def metrics_sql(source: str, label: str, score: str, by: str = "", threshold: float = 0.5) -> str:
    """CTE `evaluated`; AUC by rank statistics with averaged ties."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    over = f"GROUP BY {by}" if by else ""
    eps = "2.220446049250313e-16"
    return f"""base AS (SELECT {g}{label} AS y, CAST({score} AS DOUBLE) AS p FROM {source} WHERE {label} IS NOT NULL),
rk AS (SELECT *, rank() OVER ({part}ORDER BY p) + (count(*) OVER ({part.rstrip() + ', p' if by else 'PARTITION BY p'}) - 1) / 2e0 AS avg_rank FROM base),
agg AS (SELECT {g}count(*) FILTER (WHERE y = 0 AND p < {threshold}) AS tn, count(*) FILTER (WHERE y = 0 AND p >= {threshold}) AS fp,
 count(*) FILTER (WHERE y = 1 AND p < {threshold}) AS fn, count(*) FILTER (WHERE y = 1 AND p >= {threshold}) AS tp,
 sum(CASE WHEN y = 1 THEN avg_rank END) AS ranks, count(*) FILTER (WHERE y = 1) AS np, count(*) FILTER (WHERE y = 0) AS nn,
 avg(-(y * ln(least(greatest(p, {eps}), 1 - {eps})) + (1 - y) * ln(1 - least(greatest(p, {eps}), 1 - {eps})))) AS loss FROM rk {over}),
evaluated AS (SELECT {g}CASE WHEN np > 0 AND nn > 0 THEN (ranks - np * (np + 1) / 2e0) / (np * nn) END AS roc_auc,
 CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2e0 * tp / (2 * tp + fp + fn) END AS f1,
 CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS "precision", CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
 loss AS log_loss, CAST({threshold} AS DOUBLE) AS threshold, CAST(tn AS BIGINT) AS true_negatives, CAST(fp AS BIGINT) AS false_positives,
 CAST(fn AS BIGINT) AS false_negatives, CAST(tp AS BIGINT) AS true_positives FROM agg)"""


_METRIC_COLUMNS = (
    ", ".join([r("roc_auc"), r("f1"), r('"precision"', '"precision"'), r("recall"), r("log_loss")])
    + ", threshold, true_negatives, false_positives, false_negatives, true_positives"
)


@QUERIES.add("WITH " + DOCS_SQL + "," + metrics_sql("scored", "quality", "candidate_score", "lang") + f" SELECT lang, {_METRIC_COLUMNS} FROM evaluated")
def classifier_metrics_by_language(spark, sf):
    return tidy(metrics.evaluate(views.labelled_documents(spark, sf), "quality", "candidate_score", by=["lang"]))


@QUERIES.add(
    f"WITH {LOG_SQL}, l AS (SELECT *, {_OUTCOME} AS actual_label FROM log),"
    + metrics_sql("l", "actual_label", "probability", "model_version", 0.3)
    + f" SELECT model_version, {_METRIC_COLUMNS} FROM evaluated"
)
def classifier_metrics_by_version(spark, sf):
    log = with_outcomes(views.log(spark, sf))
    right = F.pmod(F.col("id") * 13 + F.col("k"), F.lit(5)) < 3
    log = log.withColumn("actual_label", F.when(right, F.col("prediction")).otherwise(1 - F.col("prediction")))
    return tidy(metrics.evaluate(log, "actual_label", "probability", 0.3, by=["model_version"]))


_LINE_SCORE = "(l_extendedprice * 7 + l_partkey * 13) % 100003 / 100003e0"


@QUERIES.add(
    "WITH " + metrics_sql(f"(SELECT *, {_LINE_SCORE} AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y0 FROM lineitem)", "y0", "s")
    + f" SELECT {_METRIC_COLUMNS} FROM evaluated"
)
def classifier_metrics_large(spark, sf):
    """One group, nearly as many distinct scores as rows."""
    rows = views.table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        ((F.col("l_extendedprice") * 7 + F.col("l_partkey") * 13) % 100003 / 100003.0).alias("s"),
    )
    return tidy(metrics.evaluate(rows, "y", "s"))


@QUERIES.add(
    "WITH " + DOCS_SQL + "," + metrics_sql("scored", "quality", "candidate_score", "source")
    + f""" SELECT source, name, {r('value')} FROM (
 SELECT source, unnest(['roc_auc', 'f1', 'precision', 'recall', 'log_loss', 'threshold', 'true_negatives', 'false_positives', 'false_negatives', 'true_positives']) AS name,
 unnest([roc_auc, f1, "precision", recall, log_loss, threshold, true_negatives, false_positives, false_negatives, true_positives]) AS value FROM evaluated)"""
)
def metrics_as_map(spark, sf):
    evaluated = metrics.evaluate(views.labelled_documents(spark, sf), "quality", "candidate_score", by=["source"])
    as_map = metrics.metrics_map(evaluated, ["source"])
    return tidy(as_map.select("source", F.explode("metrics").alias("name", "value")))


_FLOORS = {"roc_auc": 0.5, "f1": 0.7, "precision": 0.9, "specificity": 0.5}


@QUERIES.add(
    "WITH " + DOCS_SQL + "," + metrics_sql("scored", "quality", "candidate_score", "lang")
    + """ SELECT lang, array_to_string(list_filter([
 CASE WHEN roc_auc IS NULL THEN 'roc_auc: no value, 0.5 wanted' WHEN roc_auc < 0.5 THEN printf('roc_auc: %.4f, 0.5 wanted', roc_auc) END,
 CASE WHEN f1 < 0.7 THEN printf('f1: %.4f, 0.7 wanted', f1) END,
 CASE WHEN "precision" < 0.9 THEN printf('precision: %.4f, 0.9 wanted', "precision") END,
 'specificity: no value, 0.5 wanted'], lambda x: x IS NOT NULL), '; ') AS violations FROM evaluated"""
)
def metric_floors(spark, sf):
    evaluated = metrics.evaluate(views.labelled_documents(spark, sf), "quality", "candidate_score", by=["lang"])
    found = validate.floor_violations(F.col("metrics"), _FLOORS)
    return metrics.metrics_map(evaluated, ["lang"]).select("lang", F.array_join(found, "; ").alias("violations"))


# ---- candidate against live

_MCNEMAR_COLUMNS = """CASE WHEN b + c = 0 THEN 1.0
  WHEN b + c < 25 THEN least(1.0, 2 * list_sum(list_transform(range(0, CAST(least(b, c) + 1 AS BIGINT)),
    lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) + (b + c) * ln(0.5)))))
  ELSE 1 - list_sum(list_transform(range(0, CAST((abs(b - c) - 1) ** 2 / (b + c) + 20 * sqrt((abs(b - c) - 1) ** 2 / (b + c)) + 150 AS BIGINT)),
    lambda i: exp(-((abs(b - c) - 1) ** 2 / (b + c)) / 2 + (0.5 + i) * ln(greatest((abs(b - c) - 1) ** 2 / (b + c) / 2, 1e-300)) - lgamma(1.5 + i)))) END"""


@QUERIES.add(
    "WITH " + DOCS_SQL + f""", pairs AS (SELECT source,
 count(*) FILTER (WHERE (live_score >= 0.4)::INT = quality AND (candidate_score >= 0.5)::INT <> quality) AS b,
 count(*) FILTER (WHERE (candidate_score >= 0.5)::INT = quality AND (live_score >= 0.4)::INT <> quality) AS c FROM scored GROUP BY source),
p AS (SELECT source, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, {_MCNEMAR_COLUMNS} AS p_value FROM pairs)
SELECT source, b, c, {r('p_value')}, CASE WHEN b + c = 0 THEN 'none' WHEN b + c < 25 THEN 'exact' ELSE 'chi2' END AS method,
 b + c > 0 AND p_value < 0.05 AND c > b AS passed FROM p"""
)
def mcnemar_by_source(spark, sf):
    pairs = views.labelled_documents(spark, sf).groupBy("source").agg(
        *metrics.discordant_counts(
            F.col("quality"), metrics.decide(F.col("candidate_score"), 0.5), metrics.decide(F.col("live_score"), 0.4)
        )
    )
    return tidy(metrics.mcnemar(pairs).drop("reason"))


@QUERIES.add("WITH " + DOCS_SQL + f" SELECT {n()} AS n, {r('sum(candidate_score - live_score)', 'difference')} FROM docs")
def aligned_scores(spark, sf):
    """Two score tables joined by row id after checking that they hold the same rows."""
    docs = views.scored_documents(spark, sf)
    both = metrics.align_scores(
        docs.select("request_id", "candidate_score"), docs.select("request_id", "live_score"), "request_id"
    )
    return tidy(
        both.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("candidate_score") - F.col("live_score")).alias("difference"))
    )


_CANDIDATES = [
    # candidate, weight of the true signal in its score, has a live model, logged metrics
    ("first", 0.2, False, {"roc_auc": 0.9, "f1": 0.9, "precision": 0.9}),
    ("floor", 0.9, True, {"roc_auc": 0.6, "f1": 0.9, "precision": 0.9}),
    ("no_auc", 0.9, True, {"f1": 0.9, "precision": 0.9}),
    ("same", 0.0, True, {"roc_auc": 0.9, "f1": 0.9, "precision": 0.9}),
    ("better", 0.9, True, {"roc_auc": 0.9, "f1": 0.9, "precision": 0.9}),
    ("slightly", 0.02, True, {"roc_auc": 0.9, "f1": 0.9, "precision": 0.9}),
]


def _gate_inputs(spark, sf):
    docs = views.labelled_documents(spark, sf).where("quality is not null")
    weights = F.array(
        *[F.struct(F.lit(name).alias("candidate"), F.lit(w).alias("weight")) for name, w, _, _ in _CANDIDATES]
    )
    scored = docs.select("quality", "live_score", "candidate_score", F.inline(weights)).select(
        "candidate",
        "quality",
        "live_score",
        (F.col("weight") * F.col("quality") + (1 - F.col("weight")) * F.col("live_score")).alias("candidate_score"),
        F.lit(0.5).alias("candidate_threshold"),
        F.lit(0.5).alias("live_threshold"),
    )
    logged = spark.createDataFrame(
        [(name, live, m, {"roc_auc": 0.8}) for name, _, live, m in _CANDIDATES],
        "candidate string, has_live boolean, metrics map<string,double>, live_metrics map<string,double>",
    )
    return scored, logged


_GATE_SQL = (
    "WITH " + DOCS_SQL + ", weights(candidate, weight, has_live, auc, f1, prec) AS (VALUES "
    + ", ".join(
        f"('{name}', {w}e0, {str(live).lower()}, {m.get('roc_auc', 'NULL')}, {m['f1']}, {m['precision']})" for name, w, live, m in _CANDIDATES
    )
    + """), gs AS (SELECT candidate, quality, live_score, weight * quality + (1 - weight) * live_score AS cscore FROM scored, weights),
auc AS (SELECT candidate, (sum(CASE WHEN quality = 1 THEN rc END) - any_value(np) * (any_value(np) + 1) / 2e0) / (any_value(np) * any_value(nn)) AS candidate_auc,
  (sum(CASE WHEN quality = 1 THEN rl END) - any_value(np) * (any_value(np) + 1) / 2e0) / (any_value(np) * any_value(nn)) AS live_auc,
  count(*) AS evaluation_rows,
  count(*) FILTER (WHERE (live_score >= 0.5)::INT = quality AND (cscore >= 0.5)::INT <> quality) AS b,
  count(*) FILTER (WHERE (cscore >= 0.5)::INT = quality AND (live_score >= 0.5)::INT <> quality) AS c
 FROM (SELECT *, rank() OVER (PARTITION BY candidate ORDER BY cscore) + (count(*) OVER (PARTITION BY candidate, cscore) - 1) / 2e0 AS rc,
   rank() OVER (PARTITION BY candidate ORDER BY live_score) + (count(*) OVER (PARTITION BY candidate, live_score) - 1) / 2e0 AS rl,
   count(*) FILTER (WHERE quality = 1) OVER (PARTITION BY candidate) AS np, count(*) FILTER (WHERE quality = 0) OVER (PARTITION BY candidate) AS nn FROM gs)
 GROUP BY candidate),
g AS (SELECT w.*, a.candidate_auc, a.live_auc, a.evaluation_rows, a.b, a.c, """
    + _MCNEMAR_COLUMNS
    + f""" AS p_value FROM weights w JOIN auc a USING (candidate))
SELECT candidate, {r('candidate_auc')}, {r('live_auc')}, CAST(evaluation_rows AS BIGINT) AS evaluation_rows, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c,
 {r('p_value')}, CASE WHEN auc IS NULL THEN 'error_no_auc' WHEN auc < 0.7 OR f1 < 0.55 OR prec < 0.5 THEN 'reject_floor' WHEN NOT has_live THEN 'accept_first'
 WHEN candidate_auc - live_auc < 0.005 THEN 'reject_auc' WHEN NOT (b + c > 0 AND p_value < 0.05 AND c > b) THEN 'reject_significance' ELSE 'accept' END AS decision FROM g"""
)


@QUERIES.add(_GATE_SQL)
def promotion_decisions(spark, sf):
    """Six candidates decided at once on the same labelled rows."""
    scored, logged = _gate_inputs(spark, sf)
    shared = promotion.shared_row_metrics(scored, "quality")
    rows = logged.join(shared, "candidate").withColumn("evaluated_on", F.lit("static_holdout"))
    decided = promotion.decide(rows)
    return tidy(
        decided.select("candidate", "candidate_auc", "live_auc", "evaluation_rows", "b", "c", "p_value", "decision")
    )


@QUERIES.add(
    "WITH " + DOCS_SQL + f""", prod AS (SELECT * FROM scored WHERE toxic = 1)
SELECT CASE WHEN (SELECT count(*) >= 50 AND count(DISTINCT quality) = 2 FROM prod) THEN 'production_holdout' ELSE 'static_holdout' END AS evaluated_on,
 CASE WHEN (SELECT count(*) >= 50 AND count(DISTINCT quality) = 2 FROM prod) THEN (SELECT {n()} FROM prod) ELSE (SELECT {n()} FROM scored) END AS rows"""
)
def evaluation_set_choice(spark, sf):
    static = views.labelled_documents(spark, sf)
    chosen, name = assembly.choose_evaluation(static.where("toxic = 1"), static, "quality")
    return chosen.agg(F.lit(name).alias("evaluated_on"), F.count(F.lit(1)).alias("rows"))


@QUERIES.add("SELECT source, count(DISTINCT quality) = 2 AS both_classes FROM documents d JOIN labels l USING (doc_id) GROUP BY 1")
def both_classes_present(spark, sf):
    docs = views.labelled_documents(spark, sf)
    return docs.groupBy("source").agg((F.min("quality") < F.max("quality")).alias("both_classes"))


# ---- data sets

@QUERIES.add(
    f"""WITH {LOG_SQL}, t AS (SELECT model_version, id, created_at, row_number() OVER (PARTITION BY model_version ORDER BY created_at, id) AS rn,
 count(*) OVER (PARTITION BY model_version) AS n_all FROM log),
s AS (SELECT *, CASE WHEN rn > n_all - greatest(1, CAST(round_even(n_all * 0.3e0, 0) AS BIGINT)) THEN 'evaluation' ELSE 'train' END AS part FROM t WHERE n_all >= 800)
SELECT model_version, part, {n()} AS n, min(created_at) AS first_at, max(created_at) AS last_at FROM s GROUP BY ALL"""
)
def time_split_by_version(spark, sf):
    tagged = split.time_split(
        views.log(spark, sf).select("model_version", "id", "created_at"), ["created_at", "id"], 0.3, 800, ["model_version"]
    )
    return tidy(
        tagged.groupBy("model_version", "part").agg(
            F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")
        )
    )


@QUERIES.add(
    """WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n_all FROM orders)
SELECT o_orderkey, CASE WHEN rn > n_all - greatest(1, CAST(round_even(n_all * 0.3e0, 0) AS BIGINT)) THEN 'evaluation' ELSE 'train' END AS part FROM t"""
)
def time_split_whole_table(spark, sf):
    """Many rows share one day, so the id decides within a day."""
    rows = views.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return split.time_split(rows, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "part")


_MIX = "(o_orderkey * 7919 + 42) % 10007"
_QUOTA_SQL = """sized AS (SELECT returned, count(*) AS c, (SELECT count(*) FROM cleaned) AS n_all FROM cleaned GROUP BY 1),
shares AS (SELECT returned, c, CAST(ceil(n_all * 0.2e0) AS BIGINT) AS total, ceil(n_all * 0.2e0) * c / n_all AS exact FROM sized),
quotas AS (SELECT returned, CAST(floor(exact) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY floor(exact) - exact, returned)
  <= total - sum(CAST(floor(exact) AS BIGINT)) OVER () THEN 1 ELSE 0 END AS take FROM shares)"""
_SPLIT_SQL = f"""{_QUOTA_SQL},
tagged AS (SELECT c.*, CASE WHEN row_number() OVER (PARTITION BY c.returned ORDER BY {_MIX}, o_orderkey) <= take THEN 'test' ELSE 'train' END AS split
  FROM cleaned c JOIN quotas USING (returned))"""


def order_mix():
    return F.pmod(F.col("o_orderkey") * 7919 + 42, F.lit(10007))


@QUERIES.add("WITH " + RAW_SQL + "," + _SPLIT_SQL + " SELECT o_orderkey, returned, split FROM tagged")
def stratified_split(spark, sf):
    cleaned = clean.clean(views.raw_orders(spark, sf), "returned", "o_totalprice")
    tagged = split.stratified_split(cleaned, "returned", ["o_orderkey"], shuffle_key=order_mix())
    return tagged.select("o_orderkey", "returned", "split")


_FEEDBACK_SQL = """fb AS (SELECT o_orderkey, o_totalprice, o_orderpriority, returned, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n_all
  FROM (SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderdate, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS returned FROM orders WHERE o_orderstatus = 'P')),
fbt AS (SELECT * FROM fb WHERE n_all >= 300 AND rn <= n_all - greatest(1, CAST(round_even(n_all * 0.3e0, 0) AS BIGINT))),
allrows AS (SELECT o_totalprice, o_orderpriority, returned, split, false AS from_feedback FROM tagged
  UNION ALL SELECT o_totalprice, o_orderpriority, returned, 'train', true FROM fbt)"""


def _feedback(spark, sf):
    late = views.table(spark, sf, "orders").where("o_orderstatus = 'P'")
    log = late.select(
        "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate",
        (F.col("o_totalprice") > 250000).cast("int").alias("actual_label"),
    )
    return assembly.feedback_rows(log, None, "returned", ["o_orderdate", "o_orderkey"])


@QUERIES.add(
    "WITH " + RAW_SQL + "," + _SPLIT_SQL + "," + _FEEDBACK_SQL
    + f""" SELECT {n("split = 'train'")} AS n_train, {n("split = 'test'")} AS n_test,
 {r("avg(returned) FILTER (WHERE split = 'train')", 'positive_rate_train')}, {r("avg(returned) FILTER (WHERE split = 'test')", 'positive_rate_test')},
 {n('from_feedback')} AS n_feedback_train FROM allrows"""
)
def training_set_assembly(spark, sf):
    """Check, clean, split, add older feedback to the training side, write all three tables."""
    base = shared_path(spark, "assembly")
    built = assembly.assemble(
        views.raw_orders(spark, sf),
        "returned",
        "o_orderkey",
        drop=["o_orderkey", "o_orderdate"],
        number="o_totalprice",
        required=["o_orderkey", "o_totalprice", "returned"],
        shuffle_key=order_mix(),
        feedback=assembly.as_feedback(_feedback(spark, sf)),
        reference_path=f"{base}/reference",
        holdout_path=f"{base}/holdout",
        production_holdout_path=f"{base}/production",
    )
    return tidy(built.summary)


@QUERIES.add(
    "WITH " + RAW_SQL + "," + _SPLIT_SQL + f""" SELECT split, {n()} AS n, {r('avg(returned)', 'positive_rate')} FROM tagged GROUP BY 1"""
)
def class_balance_per_split(spark, sf):
    cleaned = clean.clean(views.raw_orders(spark, sf), "returned", "o_totalprice")
    tagged = split.stratified_split(cleaned, "returned", ["o_orderkey"], shuffle_key=order_mix())
    return tidy(assembly.class_balance(tagged, "returned", ["split"]))


@QUERIES.add(
    "WITH fb AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n_all FROM orders WHERE o_orderstatus = 'P')"
    f""" SELECT CASE WHEN rn > n_all - greatest(1, CAST(round_even(n_all * 0.3e0, 0) AS BIGINT)) THEN 'evaluation' ELSE 'train' END AS part, {n()} AS n,
 min(o_orderdate) AS first_day, max(o_orderdate) AS last_day, {n('o_totalprice > 250000')} AS positives FROM fb GROUP BY 1"""
)
def feedback_parts(spark, sf):
    tagged = _feedback(spark, sf)
    return tidy(
        tagged.groupBy("part").agg(
            F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"),
            F.sum(F.col("returned").cast("long")).alias("positives"),
        )
    )


@QUERIES.add(
    f"""SELECT {n()} AS overlap FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
 AND text IN (SELECT text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""
)
def holdout_overlap(spark, sf):
    """Labelled documents whose whole text also occurs among the unlabelled ones."""
    docs, outcomes = views.table(spark, sf, "documents"), views.table(spark, sf, "labels")
    held, rest = docs.join(outcomes, "doc_id", "left_semi"), docs.join(outcomes, "doc_id", "left_anti")
    return assembly.overlap_count(held, rest.select("text"), "text")


# ---- preparation

_PREP_SQL = """src AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
  CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer),
med AS (SELECT quantile_cont(c_acctbal, 0.5) AS ma, quantile_cont(c_nationkey, 0.5) AS mn FROM src),
par AS (SELECT any_value(ma) AS ma, avg(coalesce(c_acctbal, ma)) AS aa, stddev_pop(coalesce(c_acctbal, ma)) AS sa, any_value(mn) AS mn,
  avg(coalesce(c_nationkey, mn)) AS an, stddev_pop(coalesce(c_nationkey, mn)) AS sn FROM src, med),
cats AS (SELECT list_sort(list(DISTINCT coalesce(c_mktsegment, 'missing'))) AS l FROM src)"""


def prep_source(spark, sf):
    c = views.table(spark, sf, "customer")
    return c.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.col("c_nationkey").cast("double").alias("c_nationkey"),
        F.when(F.col("c_custkey") % 13 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
    )


@QUERIES.add(
    "WITH " + _PREP_SQL + f""" SELECT 'c_acctbal' AS feature, 'num' AS kind, {r('ma', 'median')}, {r('aa', 'mean')}, {r('sa', 'scale')}, CAST(NULL AS VARCHAR) AS categories FROM par
UNION ALL SELECT 'c_nationkey', 'num', {r('mn', 'median')}, {r('an', 'mean')}, {r('sn', 'scale')}, NULL FROM par
UNION ALL SELECT 'c_mktsegment', 'cat', NULL, NULL, NULL, array_to_string(l, '|') FROM cats"""
)
def preparation_parameters(spark, sf):
    source = prep_source(spark, sf)
    params = prepare.fit_table(source, ["c_acctbal", "c_nationkey"], [])
    # The result lists a feature's categories in one cell; only here do they meet.
    listed = prepare.fit_lookup(source, ["c_mktsegment"]).groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("categories"))
    params = params.unionByName(listed.withColumn("kind", F.lit("cat")), allowMissingColumns=True)
    return tidy(params.withColumn("categories", F.array_join("categories", "|")))


@QUERIES.add(
    "WITH " + _PREP_SQL + f""" SELECT c_custkey, {r('(coalesce(c_acctbal, ma) - aa) / sa', 'c_acctbal')}, {r('(c_nationkey - an) / sn', 'c_nationkey')},
 CAST((coalesce(c_mktsegment, 'missing') = l[2]) AS DOUBLE) AS v2, CAST((coalesce(c_mktsegment, 'missing') = l[3]) AS DOUBLE) AS v3 FROM src, par, cats"""
)
def prepared_features(spark, sf):
    source = prep_source(spark, sf)
    fitted = prepare.fit_sparse(source, ["c_acctbal", "c_nationkey"], ["c_mktsegment"])
    found = fitted.indexed(source, "c_mktsegment", "_index")
    shown = [F.coalesce((F.col("_index") == i).cast("double"), F.lit(0.0)).alias(name) for i, name in ((1, "v2"), (2, "v3"))]
    return tidy(found.select("c_custkey", *fitted.prepared_numbers(), *shown))


@QUERIES.add(
    f"""SELECT l_returnflag, {r('quantile_cont(l_extendedprice, 0.5)', 'p50')}, {r('quantile_cont(l_extendedprice, 0.95)', 'p95')} FROM lineitem GROUP BY 1"""
)
def exact_quantiles(spark, sf):
    return tidy(
        rollups.exact_percentiles(
            views.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95}
        )
    )


@QUERIES.add("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders")
def global_rank(spark, sf):
    rows = views.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return order.rank_rows(rows, [], ["o_orderdate", "o_orderkey"], "position").select("o_orderkey", "position")


# ---- roll-ups

_FIVE = "time_bucket(INTERVAL 5 MINUTE, created_at)"


@QUERIES.add(f"WITH {LOG_SQL} SELECT {_FIVE} AS window_start, prediction, model_version, {n()} AS n FROM log GROUP BY ALL")
def predictions_per_5_minutes(spark, sf):
    return tidy(rollups.count_per_window(views.log(spark, sf), "created_at", ["prediction", "model_version"]))


@QUERIES.add(
    f"""WITH {LOG_SQL}, c AS (SELECT {_FIVE} AS window_start, {n("event_type = 'error'")} AS errors, {n("event_type = 'error' AND value > 30")} AS slow,
 {n("event_type = 'error' AND value <= 30")} AS fast FROM log GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series((SELECT min(window_start) FROM c), (SELECT max(window_start) FROM c), INTERVAL 5 MINUTE)) AS TIMESTAMP) AS window_start)
SELECT window_start, coalesce(errors, 0) AS errors, coalesce(slow, 0) AS slow, coalesce(fast, 0) AS fast FROM spine LEFT JOIN c USING (window_start)"""
)
def errors_per_5_minutes(spark, sf):
    log = views.log(spark, sf)
    kinds = {"slow": F.col("value") > 30, "fast": F.col("value") <= 30}
    return tidy(rollups.error_counts(log, "created_at", F.col("event_type") == "error", kinds))


_TYPE = "CASE WHEN event_type = 'error' THEN 'level-' || CAST(CAST(floor(k / 25e0) AS BIGINT) AS VARCHAR) END"


@QUERIES.add(
    f"""WITH {LOG_SQL}, t AS (SELECT {_FIVE} AS window_start, {_TYPE} AS error_type FROM log WHERE event_type = 'error'),
c AS (SELECT window_start, error_type, {n()} AS errors FROM t GROUP BY ALL),
spine AS (SELECT CAST(unnest(generate_series((SELECT min(window_start) FROM c), (SELECT max(window_start) FROM c), INTERVAL 5 MINUTE)) AS TIMESTAMP) AS window_start),
types AS (SELECT DISTINCT error_type FROM c)
SELECT window_start, error_type, coalesce(errors, 0) AS errors FROM spine CROSS JOIN types LEFT JOIN c USING (window_start, error_type)"""
)
def errors_by_type_per_5_minutes(spark, sf):
    return tidy(rollups.errors_by_type(views.with_error_type(views.log(spark, sf)), "created_at", "error_type"))


def in_milliseconds(latency):
    """The mean in milliseconds: averages of five-decimal seconds fall on rounding ties."""
    return tidy(latency.select("window_start", "n", (F.col("mean") * 1000).alias("mean_ms"), "p95"))


def quantile_sql(bounds: list[float], q: float) -> str:
    out = str(bounds[-1])
    for i in range(len(bounds) - 1, -1, -1):
        low, before = (bounds[i - 1], f"le[{i}]") if i else (0.0, "0")
        out = f"CASE WHEN le[{i + 1}] >= n * {q}e0 THEN {low}e0 + ({bounds[i]}e0 - {low}e0) * ((n * {q}e0 - {before}) / (le[{i + 1}] - {before})) ELSE {out} END"
    return out


_LE = "[" + ", ".join(f"count(*) FILTER (WHERE latency <= {b})" for b in rollups.LATENCY_BOUNDS) + "]"


@QUERIES.add(
    f"""WITH {LOG_SQL}, h AS (SELECT {_FIVE} AS window_start, {_LE} AS le, {n()} AS n, avg(latency) AS mean FROM log GROUP BY 1)
SELECT window_start, n, {r('mean * 1000', 'mean_ms')}, {r(quantile_sql(rollups.LATENCY_BOUNDS, 0.95), 'p95')} FROM h"""
)
def latency_per_5_minutes(spark, sf):
    return in_milliseconds(rollups.latency_per_window(views.log(spark, sf), "created_at", "latency"))


@QUERIES.add(
    f"""SELECT event_type, {r('quantile_cont(value, 0.5)', 'p50_ms')}, {r('quantile_cont(value, 0.95)', 'p95_ms')} FROM events GROUP BY 1"""
)
def exact_latency_percentiles(spark, sf):
    """In milliseconds: two decimals, so interpolated values never fall on a rounding tie."""
    events = views.table(spark, sf, "events")
    return tidy(rollups.exact_percentiles(events, ["event_type"], "value", {"p50_ms": 0.5, "p95_ms": 0.95}))


@QUERIES.add(
    f"WITH {LOG_SQL} SELECT event_type, CAST(b AS DOUBLE) AS bound, {n('latency <= b')} AS n FROM log, (VALUES "
    + ", ".join(f"({b})" for b in rollups.LATENCY_BOUNDS)
    + ") t(b) GROUP BY ALL"
)
def latency_histogram(spark, sf):
    h = rollups.histogram(views.log(spark, sf), ["event_type"], "latency", rollups.LATENCY_BOUNDS)
    return rollups.unfold(h, ["event_type"], rollups.LATENCY_BOUNDS)


@QUERIES.add(
    f"WITH {LOG_SQL} SELECT model_version, CAST(b AS DOUBLE) AS bound, {n('probability <= b')} AS n FROM log, (VALUES "
    + ", ".join(f"({b}e0)" for b in rollups.SCORE_BOUNDS)
    + ") t(b) GROUP BY ALL"
)
def score_histogram_by_version(spark, sf):
    return rollups.score_histogram(views.log(spark, sf), "probability", ["model_version"])


@QUERIES.add(
    f"""WITH {LOG_SQL}, l AS (SELECT *, CASE WHEN event_type <> 'signup' THEN {_OUTCOME} END AS actual_label FROM log),
a AS (SELECT model_version, min(created_at) AS first_seen, max(created_at) AS last_seen, {n()} AS n, avg(prediction) AS positive_rate,
 {n('actual_label IS NOT NULL')} AS labelled, avg(CASE WHEN actual_label IS NOT NULL THEN CAST(prediction = actual_label AS INT) END) AS accuracy FROM l GROUP BY 1)
SELECT model_version, first_seen, last_seen, n, {r('positive_rate')}, labelled, {r('accuracy')}, lag(model_version) OVER (ORDER BY first_seen, model_version) AS previous_version FROM a"""
)
def version_history(spark, sf):
    activity = rollups.version_activity(with_outcomes(views.log(spark, sf)))
    return tidy(rollups.version_succession(activity))
