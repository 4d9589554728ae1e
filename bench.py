"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

NAMES = [
    "scan_project", "filter_expr", "filter_range_date", "agg_by_key", "agg_multi_key", "two_phase_agg", "having_scalar_subquery", "exists",
    "join_inner", "join_salted", "join_multiway", "join_reordered", "self_join_count", "join_agg_sort", "sort_full", "top_k", "top_k_per_group", "manifest_pruned",
    "page_pruned", "hive_pruned", "join_broadcast", "join_shuffle", "join_merge", "join_bloom", "run_compiled", "run_interpreted", "merged_runs",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from quern.plans.catalog import QUERIES
    from quern.session import build

    spark = build(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in NAMES:
        runs = []
        for _ in range(3):  # the first compiles
            t = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "sum of query seconds, median of warm runs", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    sys.exit(main())
