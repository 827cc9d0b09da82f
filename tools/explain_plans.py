"""Run catalogue queries and summarise their executed (adaptive, final) plans.

Usage: python tools/explain_plans.py [sf_dir] [query ...] [--full]

For each query: shuffles (Exchange), broadcasts, join strategies, aggregate
kinds, windows, Python evaluation nodes, whole-stage-codegen stages and the
columns each Parquet scan reads. ``--full`` also prints the formatted plan.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODES = (
    "Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange RoundRobinPartitioning", "Exchange SinglePartition",
    "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
    "CartesianProduct", "HashAggregate", "SortAggregate", "ObjectHashAggregate", "Window", "Expand",
    "TakeOrderedAndProject", "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "Generate",
)


def summarise(plan: str) -> dict:
    counts = Counter()
    for node in NODES:
        counts[node] = len(re.findall(r"(?m)^[\s:+\-*()0-9]*" + re.escape(node), plan))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?Location: [^\[]*\[([^\]]*)\]", plan)
    codegen = len(re.findall(r"\*\(\d+\)", plan))
    return {"counts": {k: v for k, v in counts.items() if v}, "scans": scans, "codegen_stages": codegen}


def main() -> None:
    args = [a for a in sys.argv[1:] if a != "--full"]
    full = "--full" in sys.argv
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    only = [a for a in args if not a.startswith("/")]
    from gradewell.plans.catalog import QUERIES
    from gradewell.session import build_session

    spark = build_session("local[8]", shuffle_partitions=16, extra={"spark.ui.showConsoleProgress": "false"})
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        executed = df._jdf.queryExecution().executedPlan()
        # the adaptive plan is final once it has run
        plan = executed.toString()
        if "AdaptiveSparkPlan" in plan:
            try:
                plan = executed.finalPhysicalPlan().toString()
            except Exception:  # noqa: BLE001 - older API
                pass
        s = summarise(plan)
        cols = "; ".join(sorted({f"{loc.split('/')[-1]}: {c}" for c, loc in s["scans"]}))
        print(f"{name}: {s['counts']} codegen_stages={s['codegen_stages']}")
        if cols:
            print(f"    reads {cols}")
        if full:
            df.explain("formatted")


if __name__ == "__main__":
    main()
