"""Retention, expiry and price policies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.money import rate_price_floor
from sigspark.operators.series import null_safe_join


def retain(df: DataFrame, time: str, now: Column, days: int = 14) -> DataFrame:
    """Rows young enough to keep; on a table partitioned by day this prunes whole partitions."""
    return df.filter(F.col(time) >= now - F.make_dt_interval(F.lit(days)))


def expire_rows(
    df: DataFrame, status: str, when: Any, time: str, now: Column, ttl: Column, new_status: Any, guard: Column | None = None,
) -> DataFrame:
    """Move rows in state ``when`` older than ``ttl`` to ``new_status``; all other rows pass unchanged."""
    due = (F.col(status) == when) & (F.col(time) < now - ttl)
    if guard is not None:
        due = due & guard
    return df.withColumn(status, F.when(due, new_status).otherwise(F.col(status)))


def _days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def release_customers(df: DataFrame, now: Column, deal_days: int, contact_days: int) -> DataFrame:
    """Owned, unlocked, undealt customers whose deal or contact deadline has passed."""
    owner, last = F.col("owner_time"), F.col("contact_last_time")
    stale = (owner < now - _days(contact_days)) & ((last < now - _days(contact_days)) | last.isNull())
    return df.filter((F.col("owner") > 0) & ~F.col("locked") & ~F.col("dealt") & ((owner < now - _days(deal_days)) | stale))


def release_reminders(df: DataFrame, now: Column, deal_days: int, contact_days: int, notify_days: int) -> DataFrame:
    """Customers whose release is at most ``notify_days`` away."""
    def near(c: Column, days: int) -> Column:
        return (c >= now - _days(days)) & (c <= now - _days(max(days - notify_days, 0)))

    owner, last = F.col("owner_time"), F.col("contact_last_time")
    contact = near(owner, contact_days) & (near(last, contact_days) | last.isNull())
    return df.filter(~F.col("locked") & ~F.col("dealt") & (near(owner, deal_days) | contact))


def apportion(
    lines: DataFrame, key: str, order: Sequence[str], weight: str, amounts: DataFrame, amount: str, name: str, selected: str | None = None,
) -> DataFrame:
    """Split an amount per order over its (selected) lines by weight, rounding down; the last selected
    line takes the rest, other lines get 0.

    Sums per order come from two map-side-combined aggregations, so the lines of an order of any length stay spread over tasks.
    """
    on = F.col(selected) if selected else F.lit(True)
    tagged = lines.withColumn("__on", on).withColumn("__o", F.struct(*order))
    sums = tagged.filter("__on").groupBy(key).agg(F.sum(weight).alias("__total"), F.max("__o").alias("__last"))
    told = amounts.select(key, F.col(amount).alias("__amount")).join(sums, key)
    wide = tagged.join(told, key, "left")
    is_last = F.col("__on") & (F.col("__o") == F.col("__last"))
    part = F.floor(F.col("__amount") * (F.col(weight).cast("double") / F.col("__total"))).cast("long")
    wide = wide.withColumn("__part", F.when(F.col("__on") & ~is_last, part).otherwise(0))
    given = wide.groupBy(key).agg(F.sum("__part").alias("__given"))
    value = F.when(is_last, F.col("__amount") - F.col("__given")).otherwise(F.col("__part"))
    return wide.join(given, key, "left").select(*lines.columns, F.coalesce(value, F.lit(0)).cast("long").alias(name))


def freight(lines: DataFrame, key: str, order: Sequence[str], charge: str, templates: DataFrame, zone: str) -> DataFrame:
    """Freight per order (first block plus started extra blocks), split over the lines by charge value.

    ``templates``: zone, start_count, start_price, extra_count, extra_price.
    """
    first = F.min_by(zone, F.struct(*order))                       # the zone of the first line
    totals = lines.groupBy(key).agg(F.sum(charge).alias("__v"), first.alias(zone)).join(templates, zone)
    extra = F.ceil((F.col("__v") - F.col("start_count")) / F.col("extra_count")) * F.col("extra_price")
    price = F.col("start_price") + F.when(F.col("__v") <= F.col("start_count"), 0).otherwise(extra)
    return apportion(lines, key, order, charge, totals.select(key, price.cast("long").alias("__f")), "__f", "freight")


def tiered_reward(lines: DataFrame, key: str, order: Sequence[str], price: str, count: str, tiers: Sequence[Mapping[str, int]], on: str = "price") -> DataFrame:
    """The highest tier reached by an order's price or count: its discount and points, split over the lines."""
    sums = lines.groupBy(key).agg(F.sum(price if on == "price" else count).alias("__v"))
    ranked = sorted(tiers, key=lambda t: -t["limit"])
    pick = lambda field: F.coalesce(*[F.when(F.col("__v") >= t["limit"], F.lit(t.get(field, 0))) for t in ranked], F.lit(0))
    won = sums.select(key, pick("discount").alias("__d"), pick("points").alias("__p"))
    out = apportion(lines, key, order, price, won, "__d", "reward_discount")
    return apportion(out, key, order, price, won, "__p", "reward_points")


def line_brokerage(base: Column, percent: Column, fixed: Column) -> Column:
    """A positive fixed amount, else the floored percentage of a positive base, else 0."""
    share = F.when((base > 0) & (percent > 0), rate_price_floor(base, percent)).otherwise(0)
    return F.when(fixed > 0, fixed.cast("long")).otherwise(share)


def move_balance(accounts: DataFrame, moves: DataFrame, key: str, source: str, target: str, amount: str) -> DataFrame:
    """Move the summed amount per account from one balance to another when the source covers it."""
    sums = moves.groupBy(key).agg(F.sum(amount).alias("__m"))
    wide = null_safe_join(accounts, sums, [key], "left").withColumn("__m", F.coalesce("__m", F.lit(0)))
    ok = F.col(source) >= F.col("__m")
    return (
        wide.withColumn("accepted", ok)
        .withColumn(target, F.col(target) + F.when(ok, F.col("__m")).otherwise(0))
        .withColumn(source, F.col(source) - F.when(ok, F.col("__m")).otherwise(0)).drop("__m")
    )
