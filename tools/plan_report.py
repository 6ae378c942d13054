"""Summarise the physical plan of every registered query into PLANS.md.

usage: python tools/plan_report.py [sf_dir]
Counts, per query, the operators that decide cost at scale: shuffles (hash /
range), join strategies, partial top-k limits, windows, and any cartesian or
nested-loop join (there should be none).
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

KINDS = [
    ("hash shuffle", r"Exchange hashpartitioning"),
    ("range shuffle", r"Exchange rangepartitioning"),
    ("broadcast", r"BroadcastExchange"),
    ("broadcast hash join", r"BroadcastHashJoin"),
    ("sort-merge join", r"SortMergeJoin"),
    ("shuffled hash join", r"ShuffledHashJoin"),
    ("cartesian / nested loop", r"CartesianProduct|BroadcastNestedLoopJoin"),
    ("partial top-k", r"WindowGroupLimit .*Partial"),
    ("window", r"^\s*[:+\- ]*Window \["),
    ("python (Arrow)", r"MapInPandas|ArrowEvalPython"),
    ("reused exchange", r"ReusedExchange"),
]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from guestlens.session import build_session
    from guestlens.plans.registry import QUERIES
    spark = build_session()
    lines = ["# Physical plans of the registered queries", "",
             f"Generated by `tools/plan_report.py {sf}` (AQE initial plans, local[8]). "
             "Counts of plan operators per query; written intermediates appear as plain scans.", "",
             "| query | " + " | ".join(k for k, _ in KINDS) + " |",
             "|---|" + "---|" * len(KINDS)]
    for name, fn in sorted(QUERIES.items()):
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        rows = plan.split("\n")
        counts = [sum(1 for r in rows if re.search(p, r)) for _, p in KINDS]
        lines.append(f"| {name} | " + " | ".join(str(c) for c in counts) + " |")
        print(name, counts, flush=True)
    open("PLANS.md", "w").write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main()
