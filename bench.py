"""Time the registered queries: one JSON line with the warm seconds of each and their sum.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_QUERIES (comma-separated) the queries; by default all of the
library's own.  Each is run REPEATS times to a sink that reads every row; the best counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

from fiberloom.plans import registry  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 2


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, failed = {}, {}
    for name in os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else registry.QUERIES:
        try:
            best = None
            for _ in range(REPEATS):
                began = time.perf_counter()
                registry.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
                best = min(best or 1e9, time.perf_counter() - began)
            seconds[name] = round(best, 3)
        except Exception as e:  # noqa: BLE001  one query that fails is told beside the others' figures
            failed[name] = str(e)[:200]
    out = {"metric": "total_warm_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")), "cpus": int(CPUS)}
    print(json.dumps(out | ({"failed": failed} if failed else {})))
    spark.stop()


if __name__ == "__main__":
    main()
