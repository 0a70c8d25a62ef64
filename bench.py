"""Time the headline queries: one JSON line on standard output.

`queries` holds the better of two runs after a first one, whose times (with class loading and
code generation) are in `first_run`. Every run reads the tables and builds the plan anew.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from checks.queries import QUERIES

# Summaries and lists over the two large tables, the widest rows, and one query per join shape.
HEADLINE = (
    "recon_summary",
    "aligned_status",
    "verdicts",
    "field_variances",
    "discrepancy_report",
    "composite_key_summary",
    "composite_key_tally",
    "enriched_left",
    "order_vs_lineitem_total",
    "null_key_status",
    "document_verdicts",
    "key_audit",
    "record_hash",
)


REPEATS = 2


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    """Seconds to build and run a query; the noop sink takes every row and column and keeps none."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    wanted = sys.argv[1:] or HEADLINE
    first = {name: run(spark, name, sf_dir) for name in wanted}
    seconds = {name: min(run(spark, name, sf_dir) for _ in range(REPEATS)) for name in wanted}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": first,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
