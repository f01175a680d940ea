"""Seconds per headline query: one warm-up, then the median of the timed runs.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4), BENCH_RUNS (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidewatch.catalog import all_queries
from tidewatch.session import local_session

HEADLINE = [
    "drift_severe_shift",
    "drift_p_value_tests",
    "drift_by_segment",
    "drift_monthly_windows",
    "drift_pass_over_log",
    "trigger_cooldown",
    "classifier_metrics_large",
    "promotion_decisions",
    "mcnemar_by_source",
    "attach_labels",
    "label_result",
    "live_accuracy_7_days",
    "time_split_whole_table",
    "stratified_split",
    "training_set_assembly",
    "preparation_parameters",
    "prepared_features",
    "exact_quantiles",
    "global_rank",
    "count_based_windows",
    "predictions_per_5_minutes",
    "errors_per_5_minutes",
    "latency_per_5_minutes",
    "score_histogram_by_version",
    "version_history",
    "stream_predictions",
    "stream_outcome_join",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    known = all_queries()
    seconds = {}
    for name in HEADLINE:
        timed = []
        for i in range(runs + 1):
            started = time.perf_counter()
            known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                timed.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(timed), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
