"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import re
import time

from pyspark.sql import SparkSession

from tickforge.catalog import QUERIES

HEADLINE = [
    "tick_bars", "time_bars", "volume_bars", "dollar_bars", "ema_dollar_imbalance_bars", "ema_dollar_run_bars", "cusum_filter", "z_score_filter",
    "triple_barrier", "barrier_bins", "trend_scanning", "range_volatility", "bar_lambdas", "frac_diff_ffd", "concurrency", "average_uniqueness",
    "correlation_distances", "information", "average_active_signals", "covariance", "hierarchical_weights", "return_ratios",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["tick_bars"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts workers and compiles
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()
