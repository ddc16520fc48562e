"""Times the headline queries: python bench.py prints one JSON line.

BENCH_SF_DIR (/root/testdata/sf0.1) holds the tables, BENCH_CPUS (8) the threads. Each query is warmed up once and
then run BENCH_RUNS (3) times; the median counts. The result of each run is computed whole and counted in Spark.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from weftgraph.queries import QUERIES

HEADLINE = [
    "lsqb_q1_like", "lsqb_q2_like", "lsqb_q3_like", "lsqb_q4_like", "lsqb_q5_like", "lsqb_q6_like", "lsqb_q7_like", "lsqb_q8_like", "lsqb_q9_like",
    "flagship_region_orders", "group_multi_key", "topk", "optional_where_corr", "exists_correlated", "square", "path_walk_1_3", "path_shortest_len", "ic3_like", "ic10_like", "refers_nearest", "refers_triangles",
]


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        seconds = []
        for _ in range(1 + runs):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        took[name] = round(statistics.median(seconds[1:]), 3)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
