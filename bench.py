"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and run to the end twice, into a sink that keeps nothing;
the faster run counts, so that a fresh JVM's compile time weighs less. Nothing is
cached between runs. A first count starts the JVM and is not reported.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pixelhour.session import local_session  # noqa: E402
from verification import registry  # noqa: E402

HEADLINE = [
    "explode_readings", "hourly_bins", "daily_rollup", "series_24h", "series_30d",
    "map_24h", "map_24h_devtest", "map_daily", "merge_hourly", "snap_r26",
    "device_stats", "device_stats_report", "merge_device_stats",
    "intake_accept", "payload_unpivot", "doc_enrich", "doc_typed_projection", "device_details",
    "csv_dump", "stream_hourly_state",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    registry.events(spark, folder).selectExpr("count(*)").collect()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(min(runs), 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(found.group(1)) if found else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
