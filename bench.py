"""Time the headline queries: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from wellspring.session import SETTINGS  # noqa: E402
from wellspring.standin.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "1"))
HEADLINE = (
    "io_coefs_tech",
    "io_coefs_sector",
    "upstream_absorbed",
    "upstream_co2",
    "primary_energy",
    "upstream_nonco2",
    "tailpipe_nonco2",
    "fuel_prices",
    "luc_intensity",
    "lca_ghg",
    "depth_sensitivity",
)


def seconds(spark: SparkSession, name: str) -> float:
    """Build the query and read every row and column of its result."""
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
    settings = SETTINGS | {
        "spark.sql.shuffle.partitions": CPUS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wellspring-bench-"))

    seconds(spark, "upstream_co2")  # JVM start and first compilation are not the queries'
    taken = {
        name: round(sorted(seconds(spark, name) for _ in range(REPEATS))[REPEATS // 2], 3)
        for name in HEADLINE
    }
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(taken.values()), 3),
                "unit": "sec",
                "queries": taken,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
