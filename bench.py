"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "risk_index_molar", "latest_per_key", "nearest_station", "latest_at_nearest", "outlier_flags", "upsert_features",
    "rolling_means", "tolerance_join", "adi_labels", "daily_median_composite", "idw_grid", "channel_cube", "classify_pack",
    "risk_sequence", "eval_auc", "alpha_sweep", "chunk_documents", "cosine_topk", "policy_filter",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from tidewater.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidewater-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's query engine and a Python worker before the first measurement
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.range(8).mapInPandas(lambda it: it, "id BIGINT").collect()
    times = {}
    for key in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        print(key, times[key], file=sys.stderr)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
             "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
