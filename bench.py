"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. ``--one-key`` adds one key that holds every row."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "device_health", "f01_mean", "f02_median", "f05_iir", "f11_kalman", "f17_lms", "f27_bandpass_sections", "f36_multichannel",
    "e01_trailing_power", "e05_resetting_window", "g01_burst_features", "g01_burst_features_series", "g21_history_analysis",
    "g26_overall_score", "a14_fragment_series", "c05_match_rules", "c08_overlap_count", "c13_vector_topk", "d06_percentile_95",
    "d16_daily_facts", "d21_product_daily", "d30_rank_receivable_price", "d42_stock_ledger", "l08_apportion", "j16_split_text",
]
COPIES = 2


def long_key(spark, sf):
    """Operators along one key that holds the order lines ``COPIES`` times, as functions without argument."""
    from pyspark.sql import functions as F

    from sigspark.operators import filters, windows
    from sigspark.plans.windowing import DAY, ONE_ORDER, one_key

    order = [*ONE_ORDER, "copy"]
    series = one_key(spark, sf).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    return series.count(), {
        "mean": lambda: filters.apply_filter(series, "MEAN", ["dev"], order),
        "kalman": lambda: filters.apply_filter(series, "KALMAN", ["dev"], order),
        "trailing_power": lambda: windows.trailing_power(series.withColumn("filtered", F.lit(0.0)), ["dev"], "us", 30 * DAY),
    }


def main() -> None:
    from sigspark.plans import catalog
    from sigspark.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "sigspark-bench")

    def timed(make) -> float:
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run = lambda name: timed(lambda: catalog.QUERIES[name](spark, sf))
    spark.read.parquet(f"{sf}/events.parquet").count()
    run("f11_kalman")                                     # starts the Python workers
    names = [a for a in sys.argv[1:] if a != "--one-key"]
    times = {name: run(name) for name in names or HEADLINE}
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    rates = {n: round(events / times[n]) for n in ("device_health", "f11_kalman", "f17_lms") if n in times}
    out = {
        "metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""), "samples_per_second": rates,
    }
    if "--one-key" in sys.argv:
        spark.conf.set("sigspark.sliceBytes", str(1 << 20))    # one key over all cores
        rows, makes = long_key(spark, sf)
        took = {n: timed(make) for n, make in makes.items()}
        out["one_key"] = {"rows": rows, "seconds": took, "samples_per_second": {n: round(rows / t) for n, t in took.items()}}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
