"""Headline queries, timed: prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the number of local cores. Every query runs
once to warm up and then ``BENCH_RUNS`` times (1 by default); its best time counts. Results
go to a sink that reads every row and stores none.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from changefeed.session import local_session  # noqa: E402
from queries import QUERIES  # noqa: E402

HEADLINE = [
    "a2_scan_after_checkpoints",
    "a14_split_routes",
    "b4_envelope_round_trip",
    "b16_apply_templates",
    "b20_row_multiplier",
    "c1_schedule_view",
    "c2_health_view",
    "d4_activity_rollup",
    "d9_unique_collisions",
    "d11_bottleneck",
    "d12_latency_percentiles",
    "e2_latest_per_key_native",
    "e3_offset_gaps",
    "h1_apply_changes_hard",
    "h2_apply_changes_soft",
    "h10_feed_status",
    "h16_apply_changes_guarded",
    "h19_slo_alerts",
    "j3_schema_diff",
    "j4_destructive_changes",
    "k1_build_routes",
    "native_pull_and_merge",
    "i3_stream_apply",
]
# Queries that apply a batch of changes: rows of the batch per second are reported too.
BATCHES = {"h1_apply_changes_hard": "lineitem", "h2_apply_changes_soft": "events", "h16_apply_changes_guarded": "lineitem"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(
        "bench",
        cpus,
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
    rates = {
        name: round(spark.read.parquet(f"{sf_dir}/{table}.parquet").count() / seconds[name])
        for name, table in BATCHES.items()
    }
    line = {
        "metric": "headline queries, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "merged_rows_per_second": rates,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
