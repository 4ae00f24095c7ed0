"""Time the headline queries and print one JSON line.

Each query is timed to its full result (written to Spark's noop sink) after one untimed run, and
the median of ``BENCH_RUNS`` runs is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickledger.plans import registry  # noqa: E402
from tickledger.session import local_session  # noqa: E402

HEADLINE = [
    "live_creates",
    "timers_projection",
    "restore_state",
    "next_fire",
    "fire_calendar",
    "planned_vs_actual",
    "executions_append",
    "running_progress",
    "ring_lookup",
    "shard_load",
    "classify_records",
    "attribute_requests",
    "stream_timers",
    "stream_fires",
]


def measure(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    df = query(spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session("bench", cpus, **{"spark.sql.shuffle.partitions": cpus})
    available = registry.queries()
    seconds = {}
    for name in HEADLINE:
        times = [measure(spark, available[name], sf_dir) for _ in range(runs + 1)]
        seconds[name] = round(statistics.median(times[1:]), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
