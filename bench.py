"""Benchmark: run the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and print
one JSON line {"metric", "value", "unit", "queries", "sf"}.

Each query is built from the driver tables and executed in full with the no-op sink (every
row computed, nothing gathered on the driver). One warm-up pass runs first so the timed
pass measures a warm JVM; the reported time per query is the median of the timed runs, each
of which builds the model and its category closure anew.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "dynamic_pricing",
    "recent_prices",
    "popularity_rank",
    "inventory_status",
    "high_demand",
    "price_point_lookup",
    "cart_lines",
    "category_totals",
    "cart_drilldown",
    "latency_stats",
    "qps_1s",
    "price_changes",
    "metrics_fields",
    "cart_document",
    "stock_deltas",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from livepricing.session import build_session
    from livepricing.plans.registry import forget_models, load_all

    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    registry = load_all()
    names = [n for n in HEADLINE if n in registry]

    def run(name: str) -> float:
        forget_models()     # every run builds its model and closure anew
        t0 = time.perf_counter()
        registry[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    failed = {}
    for n in names:          # warm-up (JIT, file listing)
        try:
            run(n)
        except Exception as e:  # keep benchmarking the others; report the failure
            failed[n] = f"{type(e).__name__}: {str(e)[:200]}"
    times = {n: statistics.median(run(n) for _ in range(runs)) for n in names if n not in failed}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {n: round(t, 3) for n, t in times.items()},
        "sf": float(m.group(1)) if m else sf_dir,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
