"""Run registered queries on a cluster and write each result as a Parquet snapshot.

    zip -r tallyframe.zip tallyframe
    spark-submit --py-files tallyframe.zip --conf spark.checkpoint.dir=<shared folder> \\
        tallyframe/run.py --sf-dir <driver tables> --out <output root> [--profile cluster] name ...

Each result goes to ``<out>/<name>`` (a new path; an existing one is an error, so a
rerun never overwrites an earlier snapshot). ``--list`` prints the registered names.
"""

from __future__ import annotations

import argparse
import time


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tallyframe.run")
    ap.add_argument("--sf-dir", required=False)
    ap.add_argument("--out", required=False)
    ap.add_argument("--profile", choices=["cluster"], default=None)
    ap.add_argument("--list", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)

    from tallyframe.plans.registry import load_all
    reg = load_all()
    if args.list:
        for name, q in reg.items():
            print(f"{name:24s} {q.doc.splitlines()[0] if q.doc else ''}")
        return 0
    if not (args.sf_dir and args.out and args.names):
        ap.error("--sf-dir, --out and at least one query name are required")

    from tallyframe.session import checkpoint_root, get_session
    from tallyframe.sources.tables import write_snapshot

    spark = get_session(app="tallyframe-run", profile=args.profile)
    checkpoint_root(spark)      # fails early on a cluster without a shared folder
    for name in args.names:
        t0 = time.time()
        path = write_snapshot(reg[name].build(spark, args.sf_dir), args.out, name)
        print(f"{name}: wrote {path} in {time.time() - t0:.1f}s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
