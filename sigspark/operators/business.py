"""Operational statistics: totals, trends, comparisons, rankings, funnels, cycles.

All are one aggregation per fact table. Daily or owner-level results are joined afterwards, so
facts are never joined to each other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.dates import spine
from sigspark.operators.joins import ancestor_of_type, bucket_join, enrich
from sigspark.operators.series import running


def in_period(df: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """Rows with ``start <= time < end``: half open, so neighbouring periods never share a row."""
    return df.filter((F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz")))


def period_totals(df: DataFrame, time: str, start: str, end: str, **aggs: Column) -> DataFrame:
    return in_period(df, time, start, end).agg(*[c.alias(a) for a, c in aggs.items()])


def two_periods(
    df: DataFrame, time: str, current: tuple[str, str], reference: tuple[str, str], measures: Mapping[str, Column],
    condition: Column | None = None,
) -> DataFrame:
    """Measures of two periods in one scan: ``x`` and ``reference_x`` (conditional aggregates)."""
    t = F.col(time)
    span = lambda p: (t >= F.lit(p[0]).cast("timestamp_ntz")) & (t < F.lit(p[1]).cast("timestamp_ntz"))
    both = df.filter(span(current) | span(reference))
    if condition is not None:
        both = both.filter(condition)
    cols = []
    for a, c in measures.items():
        cols.append(F.coalesce(F.sum(F.when(span(current), c)), F.lit(0)).alias(a))
        cols.append(F.coalesce(F.sum(F.when(span(reference), c)), F.lit(0)).alias(f"reference_{a}"))
    return both.agg(*cols)


def trend(df: DataFrame, time: str, first_day: str, last_day: str, unit: str, **aggs: Column) -> DataFrame:
    """Aggregates per calendar unit, zero for empty units."""
    end = F.lit(last_day).cast("timestamp_ntz") + F.expr("interval 1 day")
    facts = df.filter((F.col(time) >= F.lit(first_day).cast("timestamp_ntz")) & (F.col(time) < end))
    return bucket_join(facts, spine(df.sparkSession, first_day, last_day, unit), time, unit, first_day, **aggs)


def counts_by(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[c.alias(a) for a, c in aggs.items()])


def by_area(df: DataFrame, area: str, tree: DataFrame, kind: str, **aggs: Column) -> DataFrame:
    """Totals per area first, then rolled up to the ancestor of a type; rows without one are ``unknown``.

    Aggregates must be sums or counts, so that partial totals add up.
    """
    partial = df.groupBy(area).agg(*[c.alias(a) for a, c in aggs.items()])
    placed = ancestor_of_type(partial, area, tree, kind)
    return placed.groupBy(F.coalesce("ancestor_id", F.lit("unknown")).alias("area")).agg(*[F.sum(a).alias(a) for a in aggs])


def daily_facts(parts: Mapping[str, tuple[DataFrame, str, Mapping[str, Column]]], done: DataFrame | None = None) -> DataFrame:
    """One row per day from several fact tables ``name: (table, time column, measures)``.

    Each table is aggregated by day, then tagged rows are united and summed (no fact joins). Days
    in ``done`` are skipped, so a rerun adds nothing.
    """
    names = [m for _, _, measures in parts.values() for m in measures]
    daily = None
    for facts, time, measures in parts.values():
        if done is not None:
            facts = facts.join(done.select(F.col("day").alias("__d")), F.date_trunc("day", time) == F.col("__d"), "left_anti")
        one = facts.groupBy(F.date_trunc("day", time).alias("day")).agg(*[c.alias(m) for m, c in measures.items()])
        daily = one if daily is None else daily.unionByName(one, allowMissingColumns=True)
    return daily.groupBy("day").agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in names])


def product_daily(visits: DataFrame, sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Product facts with the whole-number conversion percentage of buyers per visitor.

    ``visits``: keys, user_id; ``sales``: keys, user_id, paid, price. Both are aggregated to keys first.
    """
    seen = visits.groupBy(*keys).agg(F.count(F.lit(1)).alias("browse_count"), F.countDistinct("user_id").alias("visitors"))
    sold = sales.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("order_count"), F.count(F.when(F.col("paid"), 1)).alias("paid_count"),
        F.countDistinct(F.when(F.col("paid"), F.col("user_id"))).alias("buyers"), F.sum(F.when(F.col("paid"), F.col("price"))).alias("paid_price"))
    both = seen.join(sold, list(keys), "full_outer").fillna(0)
    percent = F.when(F.col("visitors") == 0, 0).otherwise(F.floor(F.col("buyers") * 100 / F.col("visitors"))).cast("int")
    return both.withColumn("convert_percent", percent)


def ranking(df: DataFrame, key: str, n: int, sort: str, sums: Sequence[str], average: Sequence[str] = ()) -> DataFrame:
    """Top n keys by a summed measure (take-ordered: no full sort)."""
    out = df.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in average])
    return out.orderBy(F.col(sort).desc(), key).limit(n)


def owner_rank(df: DataFrame, owner: str, measure: Column, users: DataFrame, user_key: str, depts: DataFrame, dept_key: str) -> DataFrame:
    """A measure per owner, highest first, with the owner's name and department."""
    out = df.groupBy(owner).agg(measure.alias("measure"))
    out = enrich(out, owner, users, user_key, nickname="name", __dept="dept_id")
    return enrich(out, "__dept", depts, dept_key, dept_name="name").drop("__dept").orderBy(F.col("measure").desc(), owner)


def performance(df: DataFrame, time: str, measure: Column, year: int) -> DataFrame:
    """Twelve months, each with the month before and the same month last year."""
    first, last = f"{year - 1}-01-01", f"{year}-12-31"
    monthly = trend(df, time, first, last, "month", v=measure).select("range_start", "v")
    shifted = lambda name, months: monthly.select(
        (F.col("range_start") + F.make_ym_interval(F.lit(0), F.lit(months))).alias("range_start"), F.col("v").alias(name))
    out = monthly.filter(F.year("range_start") == year).withColumnRenamed("v", "this_month")
    out = out.join(F.broadcast(shifted("last_month", 1)), "range_start", "left")          # 24 rows
    return out.join(F.broadcast(shifted("last_year", 12)), "range_start", "left")


def funnel(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per stage, in order."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        one = df.agg(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def merge_owners(owner: str, parts: Sequence[DataFrame]) -> DataFrame:
    """Owner-level tables side by side, zero where an owner is absent."""
    names = [c for p in parts for c in p.columns if c != owner]
    whole = None
    for p in parts:
        whole = p if whole is None else whole.unionByName(p, allowMissingColumns=True)
    return whole.groupBy(owner).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def cycle_days(df: DataFrame, start: str, end: str, keys: Sequence[str], daily_mean_sum: bool = False) -> DataFrame:
    """Average days from start to end per group.

    ``daily_mean_sum`` instead adds up the daily averages of a group (an alternative definition).
    """
    days = F.datediff(end, start)
    if not daily_mean_sum:
        return df.groupBy(*keys).agg(F.avg(days).alias("cycle_days"), F.count(F.lit(1)).alias("n"))
    daily = df.groupBy(*keys, F.to_date(end).alias("__d")).agg(F.avg(days).alias("__m"), F.count(F.lit(1)).alias("__n"))
    return daily.groupBy(*keys).agg(F.sum("__m").alias("cycle_days"), F.sum("__n").alias("n"))


def stock_ledger(moves: DataFrame, keys: Sequence[str], order: Sequence[str], change: str) -> DataFrame:
    """Balance after every movement and whether it fell below zero."""
    out = running(moves, keys, order, balance=("sum", change))
    return out.withColumn("negative", F.col("balance") < 0)


def stock_on_hand(moves: DataFrame, keys: Sequence[str], change: str) -> DataFrame:
    return moves.groupBy(*keys).agg(F.sum(change).alias("on_hand"))


def embedded_share(df: DataFrame, keys: Sequence[str], embedded: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(embedded, 1)).alias("embedded"),
                                 (F.count(F.when(embedded, 1)) / F.count(F.lit(1))).alias("share"))
