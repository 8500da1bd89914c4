"""Times the headline queries; prints one JSON line. BENCH_SF_DIR: tables, BENCH_CPUS: threads."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from plumbline.plans import catalog


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in catalog.HEADLINE:
        runs = []
        for _ in range(3):  # the first run compiles; the median counts
            began = time.time()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(sorted(runs)[1], 3)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder)}))
    spark.stop()


if __name__ == "__main__":
    main()
