"""Benchmark the headline queries.

Runs each query of ``HEADLINE`` on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed to completion with the ``noop`` sink (all rows are
produced, nothing is collected to the driver).  The best of ``$BENCH_REPEAT``
runs is reported after one warm-up pass on the smallest data; planning and the
jobs that a query runs while it is built are part of its time.  With
``BENCH_LAND=1`` the derived inputs are first landed as Parquet, and that time
is part of the total (``land_inputs``).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = ["oos_days", "loss_detail", "summary_sku_pivot", "stock_snapshot",
            "window_sales", "qa_summary", "product_ranked_merge", "orders_append_distinct",
            "loss_detail_own_inputs", "overview_trust", "run_record", "calc_example"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    from shelfgap.session import build_session
    spark = build_session(f"local[{cpus}]", app_name="shelfgap-bench",
                          shuffle_partitions=int(cpus),
                          driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    from shelfgap.plans.catalog import QUERIES
    from shelfgap.session import scratch_path
    from shelfgap.sources import adapter as A

    do_land = os.environ.get("BENCH_LAND", "0") == "1"

    def land(sf: str) -> float:
        """Store the derived inputs once, as real inputs would be stored."""
        if not do_land:
            return 0.0
        t0 = time.perf_counter()
        A.land_inputs(A.open_tables(spark, sf), scratch_path(spark, "bench-inputs"))
        return time.perf_counter() - t0

    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        land(warm)
        for name in HEADLINE:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {"land_inputs": round(land(sf_dir), 3)} if do_land else {}
    for name in HEADLINE:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    # a fixed pure-Python loop, so runs on a noisy machine can be compared
    t0 = time.perf_counter()
    acc = 0
    for i in range(2_000_000):
        acc += i
    probe = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "env": {"cores": int(cpus), "cpu_probe_sec": probe},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
