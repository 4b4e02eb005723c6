"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Seconds are those of a second run of each query, results written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsward.operators import buddy, consistency, isolation
from obsward.plans import stations


def square(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    df = stations.stations(spark, sf_dir).where(F.col("station_id") <= n)
    return df.select("station_id", ((F.col("lat") - 55) / 5).alias("lat"), ((F.col("lon") - 5) / 5).alias("lon"), F.lit(0.0).alias("elev"), (F.abs(F.hash("station_id")) % 3000 / 1000).alias("value"))


def buddy_10k(spark: SparkSession, d: str) -> DataFrame:
    return buddy.buddy_check(square(spark, d, 10_000), 10_000.0, 10, 0.3, 100, 0, 1, 1)


def buddy_event_10k(spark: SparkSession, d: str) -> DataFrame:
    return buddy.buddy_event_check(square(spark, d, 10_000), 10_000.0, 10, 0.2, 0.1, 100, 0, 1)


def isolation_10k(spark: SparkSession, d: str) -> DataFrame:
    return isolation.isolation_check(square(spark, d, 10_000), 15, 3_000.0)


def sct_1k(spark: SparkSession, d: str) -> DataFrame:
    return consistency.sct(square(spark, d, 1_000), 10, 50, 5_000, 50_000, 1, 50, 100, 10_000, 200, 4, 4, 0.5)


HEADLINE: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "buddy_10k": buddy_10k, "buddy_event_10k": buddy_event_10k, "isolation_10k": isolation_10k, "sct_1k": sct_1k,
} | {k: stations.QUERIES[k] for k in ("range_check", "metadata_check", "range_check_climatology", "isolation_check", "duplicate_check", "buddy_check", "radius_neighbours", "closest_neighbours", "lag_reduction_filter", "check_pipeline")}


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, query in HEADLINE.items():
        for _ in range(2):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
            spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
