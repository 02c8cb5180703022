"""Time the headline queries and print one line of JSON.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. All queries are run once
to warm up; the value is the best of the timed runs, written to a sink that
takes every row and keeps none.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ringlog.plans.queries import QUERIES  # noqa: E402
from ringlog.session import local_session  # noqa: E402

HEADLINE = [
    "period_week",
    "period_month",
    "period_year",
    "period_day",
    "weekly_series",
    "origin_pivot",
    "state_map_callers",
    "mobile_landline_totals",
    "first_call",
    "clean_calls",
    "area_prefix_join",
    "area_contains_join",
    "heat_fail_share",
    "weekday_fail_share",
    "attempts_per_day",
    "attempt_hist",
    "attempt_quantiles",
    "dup_multiplicity",
    "dedup_calls",
    "daily_box_stats",
    "chunk_plan",
    "refresh_replace_day",
    "annual_roundtrip",
    "synth_calls",
]


def seconds(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    shared = tempfile.mkdtemp(prefix="ringlog-bench-")
    parts = int(cores) if cores.isdigit() else 8
    spark = local_session(cores, parts, **{"spark.checkpoint.dir": shared})
    for name in names:
        seconds(spark, name, sf_dir)
    times = {
        name: round(min(seconds(spark, name, sf_dir) for _ in range(runs)), 3) for name in names
    }
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
