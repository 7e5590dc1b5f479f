"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: data folder, BENCH_CPUS: cores, BENCH_RUNS: timed runs per query,
BENCH_ONLY: comma-separated query names.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from barloom.operators import features, labels
from barloom.plans import QUERIES
from barloom.session import local_session
from barloom.sources import views

HEADLINE = (
    "c1_to_bars", "b10_validate", "b11_health_report", "d_full_feature_set", "e1_align",
    "f1_triple_barrier", "f3_order_outcome", "f5_policy_grid", "c4_max_drawdown", "c10_open_count",
    "g2_permutation_test", "g3_friction_shock", "g4_mc_drawdown", "g4_mc_drawdown_days", "j4_order_states",
    "j5_risk_gate", "j1_bars_stream_closed", "j3_order_fsm",
)


# Jobs whose first run takes so many seconds are timed once.
SLOW = 20.0


def barrier_200(spark, folder):
    atr = F.col("atr")
    bars = views.bars(spark, folder)
    return labels.triple_barrier(bars, 1.5 * atr, atr, 200, [features.atr()])


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session(cpus, "bench")

    jobs = {name: QUERIES[name] for name in HEADLINE}
    jobs["f1_triple_barrier_200"] = barrier_200
    if only:
        jobs = {n: jobs.get(n, QUERIES.get(n)) for n in only}

    # The bar store is built once, as users do; its cost is reported on its own.
    start = time.perf_counter()
    for tf in ("H1", "M5"):
        views.bars(spark, folder, tf)
    seconds = {"build_bar_store": round(time.perf_counter() - start, 3)}

    for name, job in jobs.items():
        taken = []
        while len(taken) < (runs + 1 if not taken or taken[0] < SLOW else 2):  # the first run warms up
            start = time.perf_counter()
            job(spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)

    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
