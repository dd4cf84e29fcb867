"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import statistics
import time

from sparkloom.plans import library
from sparkloom.session import build_session

RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    every = library.queries()
    headline = [k for k in every if k.startswith("tpch_")] + ["sort_q100_two_keys", "scan_q101_lineitem", "join_mark", "sub_lateral"]
    times = {}
    for name in headline:
        took = []
        for _ in range(RUNS + 1):  # the first run warms up
            t = time.perf_counter()
            every[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t)
        times[name] = round(statistics.median(took[1:]), 4)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
