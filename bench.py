"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default
8), BENCH_QUERIES (comma list of names, default the headline list), BENCH_RUNS
(default 2; the best run counts).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stagelens.catalog import all_queries  # noqa: E402
from stagelens.session import get_session  # noqa: E402
from stagelens.sources.tables import materialize  # noqa: E402

HEADLINE = [
    "work_baseline_scan",
    "work_skewed_aggregation",
    "work_sort_merge_join",
    "work_broadcast_hash_join",
    "work_python_function",
    "work_cached_slices",
    "work_global_sort",
    "work_cross_join",
    "work_explode_rows",
    "work_running_total",
    "work_random_sort",
    "work_skewed_self_join",
    "work_high_cardinality",
    "work_cartesian_size",
    "work_python_two_columns",
    "join_skew_salted",
    "running_sum_by",
    "median_by_hot_key",
    "tele_stage_totals",
    "tele_task_quantiles",
    "tele_clean_plan",
    "tele_resample_1s",
    "tele_metric_peaks",
    "tele_stage_metrics",
    "landed_fact_stages",
    "eventlog_fact_stages",
    "diag_data_skew",
    "diag_bottleneck_metrics",
    "diag_report",
    "stream_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES")
    spark = get_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    times = {}
    for name in names.split(",") if names else HEADLINE:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            materialize(registered[name].run(spark, sf_dir))
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    sf = Path(sf_dir).name.removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": sf}
        )
    )


if __name__ == "__main__":
    main()
