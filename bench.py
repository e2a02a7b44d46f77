"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from panelstats.session import build_session  # noqa: E402
from panelstats.workload import all_queries  # noqa: E402

HEADLINE = [
    "spells", "spells_chunked", "spell_summary", "threshold_sensitivity", "date_coverage", "missingness",
    "duplicate_rows", "reproduction_error", "qa_summary", "diagnostics", "balanced_panel", "annual_table",
    "full_vs_balanced", "distribution_profile", "sensor_summary", "platform_daily", "common_window_summary",
    "event_structure", "group_consistency", "monthly_resample", "nested_rollup", "window_contrast", "period_pair",
    "trend_table", "lag1_dw", "block_bootstrap", "corr_lagged", "corr_matrix", "corr_long_series", "directional_counts",
    "claim_matrix", "manifest_integrity", "positional_pivot", "header_discovery", "eav_json", "stream_daily",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = build_session(cores, "panelstats-bench", **{"spark.checkpoint.dir": shared})
    queries = all_queries()
    # start the JVM's compilers and the Python workers before the clock runs
    for warm in ("spells", "trend_table", "distribution_profile"):
        queries[warm].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(repeats):
            start = time.perf_counter()
            queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cores,
    }))


if __name__ == "__main__":
    main()
