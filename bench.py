"""Benchmark: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1)
with local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion through the ``noop`` sink (full execution, no
collection to the driver), twice: ``queries`` has the first run (with planning
and code generation), ``warm`` the second. The test tables are one file each,
so the session asks for one task per core (``spark.scanforge.minPartitions``).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "scan",              # flagship: SAST + secrets + dependencies over corpus and manifests
    "sast_scan",
    "leak_scan",
    "history_scan",
    "finding_stats",
    "sast_scan_pages",
    "match_advisories",
    "deps_requirements",
    "gitignore_match",
    "redact_corpus",
    "sca_scan",
    "incremental_scan",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("scanforge-bench")
             .config("spark.sql.shuffle.partitions", str(int(cpus) * 2))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.scanforge.minPartitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from scanforge.plans.queries import QUERIES
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up
    cold, warm = {}, {}
    for name in HEADLINE:
        for times in (cold, warm):
            t = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(cold.values()), 3), "unit": "sec",
                      "queries": cold, "warm": warm, "warm_total": round(sum(warm.values()), 3),
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir}))


if __name__ == "__main__":
    main()
