"""Summarise the final physical plan of every registered query.

    python tools/plan_report.py [sf_dir] > PLANS.md

Runs each query once so the adaptive plan is final, then counts
parquet scans (with the columns they read), shuffle exchanges, reused
exchanges, broadcasts, sort-merge / broadcast-hash joins, window-group
limits and Python-side nodes.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kappaflow.plans.queries import ORACLE, QUERIES  # noqa: E402
from kappaflow.session import local_session  # noqa: E402


def final_plan(df) -> str:
    qe = df._jdf.queryExecution()
    qe.toRdd().count()                      # run on the JVM side; AQE settles the plan
    plan = qe.executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def summarise(plan: str) -> dict:
    reads = sorted(set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)))
    return {
        "scans": len(re.findall(r"FileScan parquet|(?<!File)Scan parquet", plan)),
        "read": "; ".join(reads) if reads else "",
        "shuffles": len(re.findall(r"\bExchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "reused": plan.count("ReusedExchange"),
        "broadcast": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "wgl": plan.count("WindowGroupLimit"),
        "python": len(re.findall(r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas", plan)),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    print(f"# Physical plans at {os.path.basename(sf_dir)}\n")
    print("Counts from the final adaptive plan of each registered query (`tools/plan_report.py`).")
    print("`read` is the parquet ReadSchema: only the columns the query needs.\n")
    print("| query | SQL twin | scans | shuffles | reused | broadcast | SMJ | BHJ | top-k limit | python | read |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in QUERIES.items():
        try:
            s = summarise(final_plan(fn(spark, sf_dir)))
        except Exception as e:  # noqa: BLE001
            print(f"| {name} | error: {type(e).__name__} | | | | | | | | | |")
            continue
        print(f"| {name} | {'yes' if name in ORACLE else 'no'} | {s['scans']} | {s['shuffles']} | {s['reused']} | "
              f"{s['broadcast']} | {s['smj']} | {s['bhj']} | {s['wgl']} | {s['python']} | {s['read'][:120]} |")


if __name__ == "__main__":
    main()
