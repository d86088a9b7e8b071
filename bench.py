"""Benchmark the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is built and fully executed (``noop`` sink: every row is computed,
nothing is collected to the driver); the time includes any eager lineage cut
the query performs. The metric is the sum over queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from innsight import registry  # noqa: E402
from innsight.plans.lineage import job_cuts  # noqa: E402
from innsight.session import local_session  # noqa: E402

HEADLINE = [
    "rate_frequency",
    "rate_summary",
    "property_metrics",
    "geo_clean",
    "scaled_features",
    "knn_exact",
    "compset_metrics",
    "compset_output",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    n_cpus = (os.cpu_count() or 8) if cpus == "*" else int(cpus)
    names = sys.argv[1:] or HEADLINE
    spark = local_session(
        cores=cpus,
        shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", max(8, 2 * n_cpus))),
        app_name="innsight-bench",
    )
    queries = registry.queries()
    # warm-up: JVM, Parquet footers, codegen caches
    queries["scan_rate_lookup"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        with job_cuts():
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
