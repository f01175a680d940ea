"""Drift queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from tidewatch.catalog import Registry, r, tidy, views
from tidewatch.operators import cooldown, drift, scenarios, split
from tidewatch.operators.drift import DriftConfig
from tidewatch.plans import drift_pass as passes
from tidewatch.sources import tables

QUERIES = Registry()

# ---- SQL twins of the tests

KS_TAIL = """CASE WHEN {d} * sqrt(n * m / (n + m)) < 0.04 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101),
  lambda k: (CASE WHEN k % 2 = 1 THEN 2e0 ELSE -2e0 END) * exp(-2e0 * k * k * {d} * {d} * (n * m / (n + m))))), 0.0), 1.0) END"""
CHI_TAIL = """CASE WHEN {x} <= 0 THEN 1.0 ELSE least(greatest(1 - list_sum(list_transform(
  range(0, CAST({x} / 2 + 20 * sqrt({x} / 2) + 120 + {k} AS BIGINT)),
  lambda i: exp(-({x}) / 2e0 + ({k} / 2e0 + i) * ln(({x}) / 2e0) - lgamma({k} / 2e0 + i + 1)))), 0.0), 1.0) END"""


def compare_sql(
    ctes: str,
    features: Sequence[str],
    text: Sequence[str],
    by: Sequence[str] = (),
    critical: Sequence[str] = (),
    p_threshold: float = 0.05,
    distance_threshold: float = 0.05,
    tests: dict[str, str] | None = None,
    replicate: bool = False,
) -> str:
    """CTEs ending in `tested`, the per-feature table, from CTEs named `ref` and `cur`.

    With `replicate`, `ref` has no group columns and is compared with every group of `cur`.
    """
    group = "".join(f"{c}, " for c in by)
    keys = ", ".join([*by, "feature"])
    using = f"USING ({keys})"

    def cells(source: str, prefix: str, r_: int, o_: int) -> str:
        parts = []
        for f in features:
            num, txt, flag = ("0e0", f"CAST({f} AS VARCHAR)", "false") if f in text else (f"CAST({f} AS DOUBLE)", "''", "true")
            parts.append(
                f"SELECT {prefix}'{f}' AS feature, {flag} AS is_num, {num} AS num, {txt} AS txt, {r_} AS r, {o_} AS o "
                f"FROM {source} WHERE {f} IS NOT NULL"
            )
        return "\n UNION ALL ".join(parts)

    ref_source = f"(SELECT ref.*, g.* FROM ref, (SELECT DISTINCT {', '.join(by)} FROM cur) g)" if replicate else "ref"
    forced = "".join(f"WHEN feature = '{f}' THEN '{t}' " for f, t in (tests or {}).items())
    listed = ", ".join(f"('{f}', {'false' if f in text else 'true'})" for f in features)
    groups = (
        f"(SELECT DISTINCT {', '.join(by)} FROM cur), (VALUES {listed}) v(feature, is_num)"
        if by
        else f"(VALUES {listed}) v(feature, is_num)"
    )
    critical_list = ", ".join(f"'{c}'" for c in critical) or "''"
    return f"""{ctes},
long AS ({cells(ref_source, group, 1, 0)}
 UNION ALL {cells("cur", group, 0, 1)}),
counts AS (SELECT {keys}, is_num, num, txt, CAST(sum(r) AS DOUBLE) AS r, CAST(sum(o) AS DOUBLE) AS o FROM long GROUP BY ALL),
sizes AS (SELECT {keys}, is_num, sum(r) AS n, sum(o) AS m, count(*) AS nv, sum(r * num) / sum(r) AS mean FROM counts GROUP BY ALL),
profile AS (SELECT *, CASE {forced}WHEN n <= 1000 AND is_num AND nv > 5 THEN 'ks' WHEN n <= 1000 AND nv > 2 THEN 'chi_square'
  WHEN n <= 1000 THEN 'z_test' WHEN is_num AND nv > 5 THEN 'wasserstein' ELSE 'jensen_shannon' END AS test FROM sizes),
joined AS (SELECT c.*, p.n, p.m, p.nv, p.mean, p.test FROM counts c JOIN profile p {using} WHERE p.n > 0 AND p.m > 0),
run AS (SELECT *, sum(r) OVER w AS cr, sum(o) OVER w AS co, lead(num) OVER w - num AS width FROM joined
  WHERE test IN ('ks', 'wasserstein')
  WINDOW w AS (PARTITION BY {keys} ORDER BY num)),
numeric_stats AS (SELECT {keys}, any_value(test) AS test, CASE WHEN any_value(test) = 'ks' THEN max(abs(cr / n - co / m))
  ELSE coalesce(sum(abs(cr / n - co / m) * width), 0) / greatest(sqrt(sum(r * (num - mean) * (num - mean)) / any_value(n)), 0.001) END AS statistic,
  0.0 AS unexpected FROM run GROUP BY {keys}),
cat_sums AS (SELECT {keys}, any_value(test) AS test, any_value(n) AS n, any_value(m) AS m, count(*) AS nv,
  sum(CASE WHEN r > 0 THEN (o - r * m / n) * (o - r * m / n) / (r * m / n) END) AS chi,
  sum(CASE WHEN r = 0 THEN o ELSE 0 END) AS unexpected,
  sum((CASE WHEN r > 0 THEN r / n * ln(2 * (r / n) / (r / n + o / m)) ELSE 0 END
     + CASE WHEN o > 0 THEN o / m * ln(2 * (o / m) / (r / n + o / m)) ELSE 0 END) / 2) AS js,
  first(r ORDER BY num, txt) AS r1, first(o ORDER BY num, txt) AS o1
  FROM joined WHERE test NOT IN ('ks', 'wasserstein') GROUP BY {keys}),
cat_stats AS (SELECT {keys}, test, CASE test WHEN 'chi_square' THEN chi WHEN 'jensen_shannon' THEN sqrt(greatest(js, 0.0))
  ELSE CASE WHEN (r1 + o1) / (n + m) IN (0.0, 1.0) THEN 0.0 ELSE
    abs((r1 / n - o1 / m) / sqrt((r1 + o1) / (n + m) * (1 - (r1 + o1) / (n + m)) * (1 / n + 1 / m))) END END AS statistic,
  unexpected FROM cat_sums),
stats AS (SELECT * FROM numeric_stats UNION ALL SELECT * FROM cat_stats),
wanted AS (SELECT * FROM {groups}),
tails AS (SELECT {group}w.feature, w.is_num, coalesce(n, 0.0) AS n, coalesce(m, 0.0) AS m, coalesce(nv, 0) AS nv, s.test, s.statistic,
  CASE s.test WHEN 'ks' THEN {KS_TAIL.format(d='s.statistic')}
   WHEN 'chi_square' THEN CASE WHEN s.unexpected > 0 THEN 0.0 WHEN nv < 2 THEN 1.0 ELSE {CHI_TAIL.format(x='s.statistic', k='(nv - 1)')} END
   WHEN 'z_test' THEN {CHI_TAIL.format(x='(s.statistic * s.statistic)', k='1')} END AS p_value,
  CASE WHEN coalesce(s.test, CASE WHEN coalesce(n, 0.0) <= 1000 THEN 'ks' ELSE 'wasserstein' END) IN ('wasserstein', 'jensen_shannon')
   THEN {distance_threshold} ELSE {p_threshold} END AS threshold
  FROM wanted w LEFT JOIN (SELECT * EXCLUDE (is_num, test) FROM profile) p {using} LEFT JOIN stats s {using}),
tested AS (SELECT {group}feature, CASE WHEN is_num THEN 'num' ELSE 'cat' END AS kind, CAST(n AS BIGINT) AS n_ref, CAST(m AS BIGINT) AS n_cur,
  CAST(nv AS BIGINT) AS n_values, test, {r('statistic')}, {r('p_value')}, CAST(threshold AS DOUBLE) AS threshold,
  CASE WHEN test IS NULL THEN 'no_data' ELSE 'ok' END AS status, feature IN ({critical_list}) AS critical,
  coalesce(CASE WHEN p_value IS NULL THEN statistic >= threshold ELSE p_value < threshold END, false) AS drifted FROM tails)"""


def summary_sql(by: Sequence[str] = (), share: float = 0.3) -> str:
    group = "".join(f"{c}, " for c in by)
    tail = f" GROUP BY {', '.join(by)}" if by else ""
    return (
        f"SELECT {group}{r('avg(CASE WHEN drifted THEN 1.0 ELSE 0.0 END)', 'drift_share')}, "
        f"CAST(count(*) FILTER (WHERE drifted) AS BIGINT) AS drifted_features, CAST(count(*) AS BIGINT) AS number_of_columns, "
        f"CAST(count(*) FILTER (WHERE drifted AND critical) AS BIGINT) AS critical_drifted, "
        f"CAST(count(*) FILTER (WHERE status = 'no_data') AS BIGINT) AS no_data_columns, "
        f"avg(CASE WHEN drifted THEN 1.0 ELSE 0.0 END) >= {share} AS dataset_drift FROM tested{tail}"
    )


LINE_TEXT = ["l_returnflag", "l_linestatus"]
SHIFT = [
    scenarios.Scale("l_extendedprice", 3.0, cap=199_000.0),
    scenarios.Scale("l_tax", 3.0),
    scenarios.Overwrite("l_returnflag", "R"),
    scenarios.Shrink("l_quantity", 0.1, floor=1),
]
SHIFT_SQL = """, shifted AS (SELECT least(l_extendedprice * 3, 199000) AS l_extendedprice, l_tax * 3 AS l_tax, 'R' AS l_returnflag,
  greatest(1, CAST(trunc(l_quantity * (1 + 1e0 * (0.1 - 1))) AS INTEGER)) AS l_quantity, l_discount, l_linestatus FROM cur)"""
CRITICAL = ("l_extendedprice", "l_quantity")


def line_pair(spark, sf):
    return views.line_baseline(spark, sf), views.line_current(spark, sf)


def shifted_pair(spark, sf):
    ref, cur = line_pair(spark, sf)
    return ref, scenarios.apply_edits(cur.select(*views.LINE_FEATURES), SHIFT, F.lit(0.0))


_SHIFTED_CTES = views.LINE_SQL.replace("cur AS", "unshifted AS") + SHIFT_SQL.replace("FROM cur", "FROM unshifted").replace(
    "shifted AS (SELECT least", "cur AS (SELECT least"
)
SHIFTED_SQL = compare_sql("WITH " + _SHIFTED_CTES, views.LINE_FEATURES, LINE_TEXT, critical=CRITICAL)
UNSHIFTED_SQL = compare_sql("WITH " + views.LINE_SQL, views.LINE_FEATURES, LINE_TEXT, critical=CRITICAL)


@QUERIES.add(SHIFTED_SQL + " SELECT * FROM tested")
def drift_severe_shift(spark, sf):
    ref, cur = shifted_pair(spark, sf)
    return tidy(drift.compare(ref, cur, views.LINE_FEATURES, config=DriftConfig(critical=CRITICAL)))


@QUERIES.add(SHIFTED_SQL + " " + summary_sql())
def drift_severe_summary(spark, sf):
    ref, cur = shifted_pair(spark, sf)
    config = DriftConfig(critical=CRITICAL)
    return tidy(drift.summarise(drift.compare(ref, cur, views.LINE_FEATURES, config=config), config=config))


@QUERIES.add(UNSHIFTED_SQL + " SELECT * FROM tested")
def drift_without_shift(spark, sf):
    ref, cur = line_pair(spark, sf)
    return tidy(drift.compare(ref, cur, views.LINE_FEATURES, config=DriftConfig(critical=CRITICAL)))


P_TESTS = {
    "l_quantity": "ks", "l_extendedprice": "ks", "l_discount": "ks", "l_tax": "chi_square",
    "l_returnflag": "chi_square", "l_linestatus": "z_test",
}


@QUERIES.add(
    compare_sql("WITH " + views.LINE_SQL, views.LINE_FEATURES, LINE_TEXT, tests=P_TESTS) + " SELECT * FROM tested"
)
def drift_p_value_tests(spark, sf):
    """Every p-value test named explicitly, on the large baseline."""
    ref, cur = line_pair(spark, sf)
    return tidy(drift.compare(ref, cur, views.LINE_FEATURES, config=DriftConfig(tests=P_TESTS)))


@QUERIES.add(
    compare_sql(
        "WITH " + views.LINE_SQL, ["l_quantity", "l_discount", "l_tax", "l_returnflag"], ["l_returnflag"], by=["l_linenumber"]
    )
    + " SELECT * FROM tested"
)
def drift_by_segment(spark, sf):
    """Each segment has its own baseline."""
    ref, cur = line_pair(spark, sf)
    features = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
    return tidy(drift.compare(ref, cur, features, by=["l_linenumber"]))


LOG_FEATURES = ["value", "k", "event_type"]
_SMALL = f"""WITH {views.LOG_SQL},
ref AS (SELECT value, k, event_type, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM log WHERE day(created_at) = 1),
cur AS (SELECT model_version, value, k, event_type, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM log WHERE day(created_at) > 1)"""
_SMALL_FEATURES = ["value", "k", "event_type", "parity"]


@QUERIES.add(
    compare_sql(_SMALL, _SMALL_FEATURES, ["event_type", "parity"], by=["model_version"], replicate=True)
    + " SELECT * FROM tested"
)
def drift_versions_first_day(spark, sf):
    """Versions against the first day: KS, chi-square and proportion tests while that day is small."""
    log = views.log(spark, sf).withColumn("parity", F.when(F.col("k") % 2 == 0, "even").otherwise("odd"))
    ref, cur = log.where(F.dayofmonth("created_at") == 1), log.where(F.dayofmonth("created_at") > 1)
    return tidy(
        drift.compare_windows(ref.select(*_SMALL_FEATURES), cur, ["model_version"], _SMALL_FEATURES)
    )


def month_windows(spark, sf):
    ref, cur = line_pair(spark, sf)
    cur = cur.withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    # From mid-2000 on the prices rise, so that later windows drift.
    late = F.col("l_shipdate") >= F.lit("2000-06-15").cast("timestamp")
    return ref, cur.withColumn("l_extendedprice", F.when(late, F.col("l_extendedprice") * 1.5).otherwise(F.col("l_extendedprice")))


MONTH_SQL = f"""WITH ref AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{views.CUT_DATE}'),
cur AS (SELECT * REPLACE (CASE WHEN l_shipdate >= TIMESTAMP '2000-06-15' THEN l_extendedprice * 1.5e0 ELSE l_extendedprice END AS l_extendedprice),
  strftime(l_shipdate, '%Y-%m') AS month FROM lineitem WHERE l_shipdate >= TIMESTAMP '{views.CUT_DATE}')"""
_MONTH_TESTED = compare_sql(MONTH_SQL, views.LINE_FEATURES, LINE_TEXT, by=["month"], replicate=True)


@QUERIES.add(_MONTH_TESTED + " SELECT * FROM tested")
def drift_monthly_windows(spark, sf):
    """Time windows against one large baseline: Wasserstein and Jensen-Shannon distances."""
    ref, cur = month_windows(spark, sf)
    return tidy(drift.compare_windows(ref, cur, ["month"], views.LINE_FEATURES))


@QUERIES.add(_MONTH_TESTED + " " + summary_sql(["month"]))
def drift_monthly_summary(spark, sf):
    ref, cur = month_windows(spark, sf)
    return tidy(drift.summarise(drift.compare_windows(ref, cur, ["month"], views.LINE_FEATURES), ["month"]))


# ---- the drift pass over the log

PASS = passes.PassConfig(window_size=400, min_samples=100, cooldown_seconds=86_400, tests=DriftConfig(distance_threshold=0.1))
PASS_FEATURES = ["value", "k", "event_type"]


def pass_inputs(spark, sf):
    log = views.log(spark, sf)
    late = F.dayofmonth("created_at") >= 17
    log = log.withColumn("value", F.when(late, F.col("value") * 3).otherwise(F.col("value")))
    log = log.withColumn("event_type", F.when(late, F.lit("click")).otherwise(F.col("event_type")))
    baseline = log.where(F.dayofmonth("created_at") <= 7).select(*PASS_FEATURES)
    return baseline, log.where(F.dayofmonth("created_at") > 7)


_PASS_CTES = f"""WITH RECURSIVE {views.LOG_SQL},
moved AS (SELECT * REPLACE (CASE WHEN day(created_at) >= 17 THEN value * 3 ELSE value END AS value,
  CASE WHEN day(created_at) >= 17 THEN 'click' ELSE event_type END AS event_type) FROM log),
ref AS (SELECT value, k, event_type FROM moved WHERE day(created_at) <= 7),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY created_at, id) AS rn,
  count(*) OVER (PARTITION BY model_version) AS n_all FROM moved WHERE day(created_at) > 7),
placed AS (SELECT *, (rn - 1) // 400 AS window_id, least(400, n_all - (rn - 1) // 400 * 400) >= 100 AS complete FROM ranked),
wins AS (SELECT model_version, window_id, complete, count(*) AS analyzed_rows, min(created_at) AS window_start, max(created_at) AS window_end
  FROM placed GROUP BY ALL),
cur AS (SELECT model_version, window_id, value, k, event_type FROM placed WHERE complete)"""
_PASS_TESTED = compare_sql(
    _PASS_CTES, PASS_FEATURES, ["event_type"], by=["model_version", "window_id"], distance_threshold=0.1, replicate=True
)
PASS_SQL = f"""{_PASS_TESTED},
summary AS ({summary_sql(["model_version", "window_id"])}),
decided AS (SELECT w.*, s.drift_share, s.drifted_features, s.number_of_columns, coalesce(s.dataset_drift, false) AS dataset_drift,
  CASE WHEN NOT w.complete THEN 'insufficient_samples' WHEN s.dataset_drift THEN 'drift_detected' ELSE 'no_drift' END AS outcome
  FROM wins w LEFT JOIN summary s USING (model_version, window_id)),
breaches AS (SELECT model_version, window_id, window_end, row_number() OVER (PARTITION BY model_version ORDER BY window_end, window_id) AS i
  FROM decided WHERE dataset_drift),
chain AS (SELECT model_version, window_id, i, window_end AS last_fired, true AS fired FROM breaches WHERE i = 1
  UNION ALL SELECT b.model_version, b.window_id, b.i,
   CASE WHEN b.window_end >= c.last_fired + INTERVAL 86400 SECOND THEN b.window_end ELSE c.last_fired END,
   b.window_end >= c.last_fired + INTERVAL 86400 SECOND
  FROM chain c JOIN breaches b ON b.model_version = c.model_version AND b.i = c.i + 1),
passed AS (SELECT d.model_version, d.window_id, d.window_start, d.window_end, CAST(d.analyzed_rows AS BIGINT) AS analyzed_rows, d.drift_share,
  CAST(0.3 AS DOUBLE) AS drift_share_threshold, d.drifted_features, d.number_of_columns, d.dataset_drift, d.outcome, false AS is_failure,
  coalesce(c.fired, false) AS fired FROM decided d LEFT JOIN chain c USING (model_version, window_id))"""


def run_pass(spark, sf):
    baseline, log = pass_inputs(spark, sf)
    return passes.drift_pass(
        baseline, log, ["created_at", "id"], ["model_version"], features=PASS_FEATURES, config=PASS
    )


@QUERIES.add(PASS_SQL + " SELECT * FROM passed")
def drift_pass_over_log(spark, sf):
    return tidy(run_pass(spark, sf).windows)


@QUERIES.add(
    PASS_SQL + " SELECT count(*) AS windows, arg_max(outcome, (window_end, window_id)) AS outcome FROM passed"
)
def drift_pass_outcome(spark, sf):
    return tidy(passes.pass_outcome(run_pass(spark, sf)))


@QUERIES.add(
    PASS_SQL
    + """ SELECT model_version, arg_max(window_id, window_end) AS window_id, arg_max(drift_share, window_end) AS drift_share,
    arg_max(outcome, window_end) AS outcome FROM passed WHERE drift_share IS NOT NULL GROUP BY model_version"""
)
def latest_drift_metrics(spark, sf):
    """Append the pass to the history as JSON, then read the newest entry per version."""
    from tidewatch.session import shared_path

    path = shared_path(spark, "drift-history")
    windows = run_pass(spark, sf).windows.where("drift_share is not null")
    tables.append_drift_history(windows, path)
    history = spark.read.schema(windows.schema).json(path)
    newest = tables.latest_drift(history, ["model_version"], order="window_end")
    return tidy(newest.select("model_version", "window_id", "drift_share", "outcome"))


@QUERIES.add(
    PASS_SQL.split(",\nsummary AS")[0]
    + """ SELECT * FROM tested"""
)
def drift_pass_features(spark, sf):
    """The per-feature report behind the pass."""
    return tidy(run_pass(spark, sf).features)


@QUERIES.add(
    f"""WITH {views.LOG_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY created_at, id) AS rn,
  count(*) OVER (PARTITION BY model_version) AS n_all FROM log)
SELECT model_version, (rn - 1) // 1000 AS window_id, bool_and(least(1000, n_all - (rn - 1) // 1000 * 1000) >= 100) AS complete,
  CAST(count(*) AS BIGINT) AS n, min(id) AS first_id, max(id) AS last_id FROM n GROUP BY model_version, (rn - 1) // 1000"""
)
def count_based_windows(spark, sf):
    cut = split.count_windows(views.log(spark, sf), ["created_at", "id"], 1000, 100, ["model_version"])
    return tidy(
        cut.groupBy("model_version", "window_id").agg(
            F.bool_and("complete").alias("complete"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
        )
    )


@QUERIES.add(
    """WITH RECURSIVE b AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
chain AS (SELECT user_id, event_id, i, ts AS last_fired, true AS fired FROM b WHERE i = 1
  UNION ALL SELECT b.user_id, b.event_id, b.i, CASE WHEN b.ts >= c.last_fired + INTERVAL 43200 SECOND THEN b.ts ELSE c.last_fired END,
    b.ts >= c.last_fired + INTERVAL 43200 SECOND FROM chain c JOIN b ON b.user_id = c.user_id AND b.i = c.i + 1)
SELECT user_id, event_id, fired FROM chain"""
)
def trigger_cooldown(spark, sf):
    """Breaches per key; each fires only half a day or more after the last fired one."""
    breaches = views.table(spark, sf, "events").where("event_type = 'error'").select("user_id", "event_id", "ts")
    return cooldown.fire(breaches, "ts", "event_id", 43_200, ["user_id"]).select("user_id", "event_id", "fired")


# ---- scenarios

STRENGTHS = [0.0, 0.05, 0.25, 1.0]
_SWEEP_EDITS = [
    scenarios.Scale("l_extendedprice", 1.5),
    scenarios.Scale("l_tax", 1.4),
    scenarios.Overwrite("l_returnflag", "R", 0.3),
]
_LINE_SHARE = "(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31 + 42) % 10007 / 10007e0"


def line_share():
    mixed = F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31 + 42
    return F.pmod(mixed, F.lit(10007)) / 10007.0


_SWEEP_SQL = f"""WITH {views.LINE_SQL.replace('cur AS', 'plain AS')},
cur AS (SELECT strength, l_quantity, l_extendedprice * (1 + strength * (1.5e0 - 1)) AS l_extendedprice, l_discount,
  l_tax * (1 + strength * (1.4e0 - 1)) AS l_tax, CASE WHEN {_LINE_SHARE} < strength * 0.3e0 THEN 'R' ELSE l_returnflag END AS l_returnflag, l_linestatus
  FROM plain, (VALUES {', '.join(f'({s}e0)' for s in STRENGTHS)}) s(strength))"""


@QUERIES.add(
    compare_sql(_SWEEP_SQL, views.LINE_FEATURES, LINE_TEXT, by=["strength"], replicate=True)
    + " SELECT strength, feature, test, statistic, drifted FROM tested"
)
def sensitivity_sweep(spark, sf):
    ref, cur = line_pair(spark, sf)
    out = passes.sensitivity(ref, cur, _SWEEP_EDITS, STRENGTHS, line_share(), views.LINE_FEATURES)
    return tidy(out.select("strength", "feature", "test", "statistic", "drifted"))


@QUERIES.add(
    f"""SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, {r('sum(l_extendedprice * 1.5e0)', 'price')}, {r('sum(l_tax * 1.4e0)', 'tax')}
FROM (SELECT CASE WHEN {_LINE_SHARE} < 0.3e0 THEN 'R' ELSE l_returnflag END AS l_returnflag, l_extendedprice, l_tax FROM lineitem) GROUP BY 1"""
)
def scenario_mild(spark, sf):
    shifted = scenarios.apply_edits(views.table(spark, sf, "lineitem"), _SWEEP_EDITS, line_share())
    return tidy(
        shifted.groupBy("l_returnflag").agg(
            F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("price"), F.sum("l_tax").alias("tax")
        )
    )


@QUERIES.add(
    f"""WITH severe AS (SELECT least(l_extendedprice * 3, 199000) AS l_extendedprice, l_tax * 3 AS l_tax, 'R' AS l_returnflag,
  greatest(1, CAST(trunc(l_quantity * (1 + 1e0 * (0.1e0 - 1))) AS INTEGER)) AS l_quantity FROM lineitem)
SELECT l_returnflag, l_quantity, CAST(count(*) AS BIGINT) AS n, {r('sum(l_extendedprice)', 'price')}, {r('sum(l_tax)', 'tax')} FROM severe GROUP BY ALL"""
)
def scenario_severe(spark, sf):
    shifted = scenarios.apply_edits(views.table(spark, sf, "lineitem"), SHIFT, F.lit(0.0))
    return tidy(
        shifted.groupBy("l_returnflag", "l_quantity").agg(
            F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("price"), F.sum("l_tax").alias("tax")
        )
    )


@QUERIES.add(
    """WITH ranked AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
draws AS (SELECT draw, (draw * 7919 + 42) % (SELECT count(*) FROM orders) AS i FROM range(0, 5000) t(draw))
SELECT draw, o_orderkey, o_orderstatus, o_totalprice FROM draws JOIN ranked USING (i)"""
)
def scenario_resample(spark, sf):
    """Five thousand draws with replacement from the whole table."""
    orders = views.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return scenarios.resample(orders, ["o_orderkey"], 5000, pick=lambda i, n: F.pmod(i * 7919 + 42, F.lit(n)))
