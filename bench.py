"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and is then timed as the median of $BENCH_RUNS runs into the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from siftmill.session import get_session

HEADLINE = [
    "sec003", "jsec001", "jsec002", "jscs007", "jscs008", "sql003", "sec001", "sec002", "cs003", "cs005", "maint004", "taint001",
    "m_loc_js", "m_cc_js", "m_mi", "u_halstead", "m_dup", "j_unused", "u_deps", "a_summary", "a_dash", "q_page", "t_files", "k_issues", "st_scan",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = get_session("siftmill-bench", cpus, shuffle_partitions=int(cpus))
    from siftmill.fixtures.registry import QUERIES

    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
