"""Generic grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.operators.series import null_safe_join, positions

_NAMED = {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg, "length": lambda c: F.sum(F.length(c))}


def named(df: DataFrame, keys: Sequence[str], **aggs: tuple[str, str]) -> DataFrame:
    """Aggregates by name: ``total=("sum", "price")``."""
    return df.groupBy(*keys).agg(*[_NAMED[f](F.col(c)).alias(a) for a, (f, c) in aggs.items()])


def distinct_count(df: DataFrame, keys: Sequence[str], **cols: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.countDistinct(c).alias(a) for a, c in cols.items()])


def count_where(df: DataFrame, keys: Sequence[str], **tests: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count(F.when(t, 1)).alias(a) for a, t in tests.items()])


def having_sum(df: DataFrame, keys: Sequence[str], value: str, least: float) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("total")).filter(F.col("total") >= least)


def population_stats(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    c = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance"), F.stddev_pop(c).alias("std"),
        F.min(c).alias("low"), F.max(c).alias("high"), F.sqrt(F.avg(c * c)).alias("rms"),
    )


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, percent: float, tie: Sequence[str] = ()) -> DataFrame:
    """Percentile at position ``p (n + 1) / 100`` with linear interpolation; exact at any size."""
    placed = positions(df.select(*dict.fromkeys([*keys, value, *tie])), keys, [value, *tie], "__p")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    at = F.lit(percent) * (F.col("__n") + 1) / 100.0
    low = F.greatest(F.lit(1), F.least(F.floor(at), F.col("__n")))
    high = F.when((at < 1) | (at >= F.col("__n")), low).otherwise(low + 1)
    sizes = sizes.select(*keys, low.alias("__lo"), high.alias("__hi"), (at - F.floor(at)).alias("__f"))
    near = null_safe_join(placed, sizes, keys, "inner").filter((F.col("__p") + 1 == F.col("__lo")) | (F.col("__p") + 1 == F.col("__hi")))
    lower = F.max(F.when(F.col("__p") + 1 == F.col("__lo"), F.col(value)))
    upper = F.max(F.when(F.col("__p") + 1 == F.col("__hi"), F.col(value)))
    return near.groupBy(*keys).agg((lower + F.max("__f") * (upper - lower)).alias("percentile"))


def multi_map(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], page: int) -> DataFrame:
    """Values per key as ordered lists of ``page`` items, one row per page; all values are kept."""
    placed = positions(df, keys, order, "__p").withColumn("page", F.floor(F.col("__p") / page))
    packed = placed.groupBy(*keys, "page").agg(F.array_sort(F.collect_list(F.struct("__p", F.col(value).alias("v")))).alias("__l"))
    return packed.select(*keys, "page", F.transform("__l", lambda x: x["v"]).alias("values"))


def merge_map(df: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per key, the newest by ``keep`` winning a conflict."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*keep)).alias("__r"))
    return top.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def window_totals(df: DataFrame, time: str, span: str, kind: str, is_anomaly: Column) -> DataFrame:
    """Rows, anomalies and anomaly rate per type and time window."""
    return df.groupBy(F.window(time, span).alias("__w"), kind).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(is_anomaly, 1)).alias("anomalies"),
        (F.count(F.when(is_anomaly, 1)) * 100.0 / F.count(F.lit(1))).alias("rate"),
    ).select(F.col("__w.start").alias("window_start"), kind, "n", "anomalies", "rate")
