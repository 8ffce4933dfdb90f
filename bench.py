"""Benchmark the headline studies.

Runs each headline query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is fully executed (results collected; they are small tables) after one
untimed warm-up query so JVM start-up is not counted.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from studyframe.plans import catalog  # noqa: E402
from studyframe.session import get_session  # noqa: E402

HEADLINE = (
    "agreement_by_ship_day",
    "party_union",
    "events_typed",
    "document_dup_masks",
    "document_cohort",
    "lineitem_numeric_profile",
    "orders_categorical_profile",
    "lineitem_binary_profile",
    "document_associations",
    "document_decisions",
    "events_mann_whitney",
    "planted_fdr",
    "document_model_frame",
    "scored_roc_points",
    "scored_threshold_scan",
    "document_inferential_screen",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [a for a in sys.argv[1:]] or list(HEADLINE)
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["calendar_parts"](spark, sf_dir).collect()  # warm-up, untimed
    times = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).collect()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
