"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.plans.catalog import QUERIES
from tidemark.session import local_session

HEADLINE = [
    "pit_user_activity",
    "pit_orders_ties",
    "pit_inclusive",
    "pit_hot_entities",
    "pit_monthly_marks",
    "latest_per_entity",
    "latest_with_ties",
    "materialize_as_of",
    "field_merge_arrival",
    "online_lookup",
    "missing_entities",
    "wide_pivot",
    "view_stats",
    "validate_updates",
    "update_messages",
    "compat_audit",
    "register_schemas",
    "active_views_with_spec",
    "materialize_job",
    "stream_current_values",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, **{"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "12g"})
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times = {}
    for name in names:
        best = float("inf")
        # The first run also pays for code generation and file listings.
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds, best run of each query",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
