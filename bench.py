"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs 5 times into the ``noop`` sink (the whole plan executes, no
rows travel to the driver); the median is reported.  Building the two-tier
lake from the tables and registering its catalog tables is one-time setup,
reported separately.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "lake_requests_per_day",
    "lake_requests_per_path",
    "lake_pypi_per_day",
    "lake_pypi_package_ranking",
    "combined_view_by_tier",
    "http_class_per_minute",
    "alarm_transitions_breaching",
    "alarm_transitions_ignore",
    "traffic_by_cache_class",
    "traffic_by_mirror",
    "traffic_by_rule_table",
    "notifications",
    "stitched_log_records",
    "compact_hour",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from edgelog.session import get_session
    # local mode: the driver heap is the executor memory; take 60% of RAM, 2..16 GB
    ram_gb = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30
    heap_gb = int(min(16, max(2, ram_gb * 0.6)))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(2, cpus),
                        extra={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": f"{heap_gb}g"})
    from edgelog.plans.lake import lake_for
    from edgelog.plans.registry import queries
    qs = queries()

    t0 = time.perf_counter()
    lake_for(spark, sf_dir).tables(spark)
    qs["stitched_log_records"](spark, sf_dir)  # writes its text logs once
    setup = time.perf_counter() - t0

    times = {}
    for key in HEADLINE:
        runs = []
        for _ in range(5):
            t = time.perf_counter()
            qs[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[key] = round(statistics.median(runs), 3)
    sf_text = sf_dir.rsplit("sf", 1)[-1]
    try:
        sf = float(sf_text)
    except ValueError:
        sf = sf_text
    print(json.dumps({"metric": "headline_queries_total_median", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus,
                      "setup_lake_build_sec": round(setup, 3)}))


if __name__ == "__main__":
    main()
