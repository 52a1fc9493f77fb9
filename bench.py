"""Time the headline queries and print one JSON line.

Each query writes its full result to the no-op sink: once over ``BENCH_WARM_DIR``
(the sf0.01 tables beside the timed ones, if there are any) to warm up, and then
``BENCH_RUNS`` times; the best run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from checks.catalogue import CHECKS
from checks.inputs import Inputs


def session(cpus: int) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("draftweave-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    beside = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.01")
    warm = os.environ.get("BENCH_WARM_DIR", beside if os.path.isdir(beside) else folder)
    only = os.environ.get("BENCH_ONLY", "").split()
    spark = session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name, c in CHECKS.items():
        if not c.bench or (only and name not in only):
            continue
        best = None
        for i in range(runs + 1):
            start = time.perf_counter()
            c.run(Inputs(spark, folder if i else warm)).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if i > 0:
                best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of headline queries, best run after warm-up",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
