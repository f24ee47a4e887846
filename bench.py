"""Wall time of headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tickloom import catalog  # noqa: E402
from tickloom.session import local_session  # noqa: E402

HEADLINE = [
    "rolling_signed_flow", "asof_backward_strict", "asof_latest_state", "forward_targets", "greedy_sample", "reflected_running_size",
    "running_position", "average_settlement_fair", "price_grid", "contract_fees", "open_loop_quotes", "auc_rank_sum", "ridge_fit",
    "bootstrap_interval", "pnl_rollup", "paired_comparison", "latency_percentiles", "top_n_levels", "queue_fills", "multi_horizon_volatility",
    "book_best_levels", "feature_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus), "tickloom-bench")
    # One untimed pass of a small query starts the JVM's workers and the Python daemons.
    catalog.QUERIES["asof_backward_strict"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
