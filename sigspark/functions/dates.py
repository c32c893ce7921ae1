"""Calendar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = ("hour", "day", "week", "month", "quarter", "year")
_STEP = {
    "hour": "interval 1 hour", "day": "interval 1 day", "week": "interval 7 days",
    "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year",
}


def begin_of(unit: str, c: Column) -> Column:
    return F.date_trunc(unit, c)


def end_of(unit: str, c: Column) -> Column:
    """Last microsecond of the unit."""
    return F.date_trunc(unit, c) + F.expr(_STEP[unit]) - F.expr("interval 1 microsecond")


def between(c: Column, start: Column, end: Column) -> Column:
    return (c >= start) & (c <= end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def date_ranges(df: DataFrame, start: str, end: str, unit: str) -> DataFrame:
    """One row per calendar range from the day of ``start`` to the end of the day of ``end``.

    The first range begins on the start day, later ones on unit boundaries; the last is clamped.
    """
    first = F.date_trunc("day", F.col(start))
    last = end_of("day", F.col(end))
    steps = F.sequence(F.date_trunc(unit, first), last, F.expr(_STEP[unit]))
    out = df.withColumn("__b", F.explode(steps))
    finish = F.least(F.col("__b") + F.expr(_STEP[unit]) - F.expr("interval 1 microsecond"), last)
    return out.withColumn("range_start", F.greatest(F.col("__b"), first)).withColumn("range_end", finish).drop("__b")


def range_key(c: Column, start: Column, unit: str) -> Column:
    """Start of the range (see ``date_ranges``) that holds a moment: the join key of the range."""
    return F.greatest(F.date_trunc(unit, c), F.date_trunc("day", start))


def spine(spark: SparkSession, start: str, end: str, unit: str) -> DataFrame:
    """Ranges between two literal days (size set by the calendar, not by data)."""
    one = spark.range(1).select(F.lit(start).cast("timestamp_ntz").alias("__s"), F.lit(end).cast("timestamp_ntz").alias("__e"))
    return date_ranges(one, "__s", "__e", unit).select("range_start", "range_end")


def format_range(c: Column, unit: str) -> Column:
    if unit == "hour":
        return F.date_format(c, "yyyy-MM-dd HH:mm")
    if unit == "day":
        return F.date_format(c, "yyyy-MM-dd")
    if unit == "week":
        return F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit(" (week "), F.weekofyear(c), F.lit(")"))
    if unit == "month":
        return F.date_format(c, "yyyy-MM")
    if unit == "quarter":
        return F.concat(F.year(c), F.lit("-Q"), F.quarter(c))
    return F.date_format(c, "yyyy")
