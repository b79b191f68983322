"""Benchmark of the headline queries: prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from headroom.plans import catalog  # noqa: E402
from headroom.session import local_session  # noqa: E402

HEADLINE = [
    "calendar",
    "season_index",
    "storm_index",
    "event_boost",
    "expected_demand",
    "service_table",
    "cyclic",
    "split",
    "split_nested",
    "scale",
    "sequences",
    "sequences_irregular",
    "sarima_lags",
    "required_pods",
    "evaluate",
    "pod_change",
    "score_card",
    "service_metrics",
    "allocate",
    "allocate_tight",
    "node_pools",
    "rank_models_per_service",
    "best_trial",
    "peak_window",
    "peak_window_irregular",
    "mismatch_spans",
    "daily_overview",
    "adjusted_stack",
    "load_service_traffic",
    "fit_additive",
    "fit_recipe",
    "fit_sarimax",
    "fit_gru",
    "fit_lstm",
    "recursive_forecast",
    "tune_additive",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    registered = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # the session itself is not measured
    seconds = {}
    for name in chosen:
        begin = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
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
    spark.stop()


if __name__ == "__main__":
    main()
