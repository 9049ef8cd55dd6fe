"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` (default 8): one warm-up, then ``$BENCH_REPS`` (default 3)
timed executions, reporting the median. Every execution runs the whole plan through
the ``noop`` sink (no collect to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "portfolio_kpis", "portfolio_bars", "gateway_volume_bars", "tx_statement", "tx_search",
    "recent_tx", "tx_page", "tx_text_search", "alloc_run", "alloc_rejects", "alloc_preview",
    "rule_offsets", "price_feed", "chain_balance",
    "wallet_valuation", "swap_pairs", "transfer_pairs", "check_violations", "unique_violations",
    "bank_upsert", "apply_updates", "cascade_delete", "insert_absent", "audit_details",
    "webhook_ingest", "webhook_dedup", "quota_breaches",
    "audit_append", "user_create", "last_run_breakdown", "orphan_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = sys.argv[1:] or HEADLINE

    from tallyframe.plans.registry import load_all
    from tallyframe.session import get_session

    spark = get_session(f"local[{cpus}]", app="tallyframe-bench", shuffle_partitions=cpus,
                        extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    reg = load_all()

    def run(name: str) -> float:
        t0 = time.perf_counter()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    results, errors = {}, {}
    for name in names:
        try:
            run(name)                                # warm-up (JIT, file listing, caches)
            results[name] = round(statistics.median(run(name) for _ in range(reps)), 3)
        except Exception as e:                       # keep measuring the others
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {
        "metric": "sum_of_median_query_seconds", "value": round(sum(results.values()), 3), "unit": "sec",
        "queries": results, "sf": sf, "spark": spark.version, "master": f"local[{cpus}]",
        "shuffle_partitions": cpus, "reps": reps,
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
