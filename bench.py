"""Headline queries on local cores; prints one JSON line.

Each query writes its full result to the no-op sink, so nothing is pruned. The
best of BENCH_REPEATS runs counts, after one warm-up query for the session.
"""

from __future__ import annotations

import json
import os
import time

from barlytics import catalog
from barlytics.session import local_session

HEADLINE = [
    "r05_ticks_to_bars", "w01_sma", "w11_rolling_24h", "w14_rsi_wilder", "j01_asof_join", "j03_forward_join",
    "c05_feature_core", "c06_directional_features", "a01_market_context", "c08_quality_score", "w21_edge_trigger",
    "l04_stop_grid", "l06_path_label", "l11_gap_aware_exit", "a04_cohort_report", "a08_gate_groups",
    "p14_entry_gate", "q01_audit_bars", "q03_audit_pool", "m04_threshold_metrics", "m06_roc_auc",
    "t01_confirm_and_monitor", "t02_arm_confirm_manage", "t06_cooldown", "t08_online_logistic", "s05_read_events_last",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    catalog.QUERIES["r05_ticks_to_bars"](spark, sf_dir).count()
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(repeats):
            start = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.time() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
