"""Summarise the executed (final adaptive) physical plan of registered queries.

Usage: python tools/plan_summary.py [--sf-dir DIR] [--formatted] [name ...]

For each query: shuffle exchanges, broadcast exchanges, join strategies, windows
with a group limit, scans of checkpointed data. ``--formatted`` prints the full
``explain("formatted")`` instead.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summary(plan: str) -> dict:
    # An executed adaptive plan prints the final plan, then the initial one.
    plan = plan.split("== Initial Plan ==")[0]
    lines = [ln.strip(" :+-*()0123456789") for ln in plan.splitlines()]

    def count(pattern: str) -> int:
        return sum(1 for ln in lines if re.match(pattern, ln))

    joins = sorted({m.group(0) for ln in lines
                    for m in [re.match(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|"
                                       r"BroadcastNestedLoopJoin|CartesianProduct)\S*(\s+\w+)?", ln)] if m})
    return {
        "shuffles": count(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)"),
        "broadcasts": count(r"BroadcastExchange"),
        "joins": ", ".join(j.split()[0] + ("/" + j.split()[1] if len(j.split()) > 1 else "") for j in joins) or "-",
        "group_limits": count(r"WindowGroupLimit"),
        "checkpoint_scans": count(r"Scan ExistingRDD"),
    }


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    ap.add_argument("--formatted", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()

    from tallyframe.plans.registry import load_all
    from tallyframe.session import get_session

    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    reg = load_all()
    print("| query | shuffles | broadcasts | joins | group limits | checkpoint scans |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name in args.names or list(reg):
        df = reg[name].build(spark, args.sf_dir)
        df.collect()                                    # final adaptive plan
        if args.formatted:
            print(f"===== {name}")
            df.explain("formatted")
            continue
        s = summary(df._jdf.queryExecution().executedPlan().toString())
        print(f"| `{name}` | {s['shuffles']} | {s['broadcasts']} | {s['joins']} | {s['group_limits']} | "
              f"{s['checkpoint_scans']} |")
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
