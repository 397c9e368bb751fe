"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (full execution, no
collect); the per-query time is the median of $BENCH_REPEAT runs after one
warm-up pass of the flagship query.  Prints ONE JSON line on stdout.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kappaflow.plans.queries import FLAGSHIP, QUERIES  # noqa: E402
from kappaflow.session import local_session  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus)
    run(QUERIES[FLAGSHIP](spark, sf_dir))  # warm-up (JIT, Python workers)
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        samples = []
        try:
            for _ in range(repeat):
                t0 = time.perf_counter()
                run(fn(spark, sf_dir))
                samples.append(time.perf_counter() - t0)
        except Exception as e:  # noqa: BLE001
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            continue
        times[name] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "cpus": int(cpus), "repeat": repeat}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
