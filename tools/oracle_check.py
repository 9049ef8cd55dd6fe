"""Compare every registered Spark query with its DuckDB oracle.

Usage: python tools/oracle_check.py [--sf-dir DIR] [name ...]

Queries without an oracle get a run-and-count check only.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()

    from tallyframe.plans.compare import compare, duck_connect, type_diffs
    from tallyframe.plans.registry import load_all
    from tallyframe.session import get_session

    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    reg = load_all()
    names = args.names or list(reg)
    con = duck_connect(args.sf_dir)
    bad = 0
    for name in names:
        q = reg[name]
        t0 = time.time()
        try:
            sdf = q.build(spark, args.sf_dir)
            if not q.oracle:
                print(f"ROWS {name}: {sdf.count()} rows, no oracle ({time.time() - t0:.1f}s)")
                continue
            ok, msg, n = compare(sdf, con, q.oracle)
            diffs = type_diffs(sdf, con, q.oracle)
            if ok and diffs:
                ok, msg = False, "types differ: " + "; ".join(diffs)
        except Exception as e:  # report and continue
            print(f"FAIL {name}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        if ok:
            print(f"OK   {name}: {n} rows ({time.time() - t0:.1f}s)")
        else:
            bad += 1
            print(f"FAIL {name}: {msg}")
    print(f"{len(names) - bad}/{len(names)} passed")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
