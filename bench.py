"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import contextlib
import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent), os.environ.get("PYTHONPATH", "")])

HEADLINE = ["instructions", "stage_spans", "perf_report", "state_at_entities", "state_at_buffer", "occupancy_series", "counter_samples", "counter_value_at_many", "counter_downsample", "mipmap_levels", "density_levels", "row_to_cycle", "latency_histogram"]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    from pyspark.sql import SparkSession

    from chronoslot.plans.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    with contextlib.redirect_stdout(sys.stderr):
        spark = (
            SparkSession.builder.master(f"local[{cpus}]")
            .config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", cpus)
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "4g")
            .getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        times = {}
        for name in HEADLINE:
            each = []
            for _ in range(RUNS + 1):  # the first is a warm-up
                began = time.time()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                each.append(time.time() - began)
            times[name] = round(statistics.median(each[1:] or each), 3)
        spark.stop()
    print(json.dumps({"metric": "total_median_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
