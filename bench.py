"""Time the headline queries and print one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from notewright.plans.registry import load  # noqa: E402
from notewright.session import local_session  # noqa: E402

HEADLINE = ["A36", "C04", "E14", "D12", "V02", "V04", "M07", "P07", "W10", "R05", "B10", "C09", "W06", "J10", "G07"]
# A query that took less than this many seconds is run twice more; its time is the median.
REPEATED_BELOW = 6


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    # One untimed query starts the JVM's and Python's workers; the timed queries follow.
    queries["C05"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        taken = []
        while len(taken) < 3 and (not taken or taken[0] < REPEATED_BELOW):
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken), 3)
    spark.stop()
    print(
        json.dumps(
            {"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name}
        )
    )


main()
