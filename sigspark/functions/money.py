"""Integer-cent and decimal money arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dec(c: Column, scale: int = 4) -> Column:
    return c.cast(f"decimal(20,{scale})")


def rate_price(cents: Column, rate: Column) -> Column:
    """cents x rate / 100, half up."""
    return F.round(_dec(cents, 0) * _dec(rate) / 100, 0).cast("long")


def rate_price_floor(cents: Column, rate: Column) -> Column:
    return F.floor(_dec(cents, 0) * _dec(rate) / 100).cast("long")


def total(price: Column, count: Column, percent: Column | None = None) -> Column:
    """price x count, scaled by a percentage when one is given (decimal, not integer, division)."""
    plain = price.cast("long") * count.cast("long")
    if percent is None:
        return plain
    return F.when(percent.isNull(), plain).otherwise(rate_price_floor(plain, percent))


def multiply(price: Column, count: Column) -> Column:
    return F.round(_dec(price, 2) * _dec(count, 4), 2).cast("decimal(24,2)")


def multiply_percent(price: Column, percent: Column) -> Column:
    return F.round(_dec(price, 2) * _dec(percent) / 100, 2).cast("decimal(24,2)")


def to_yuan(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") / 100).cast("decimal(22,2)")


def to_yuan_text(cents: Column) -> Column:
    return to_yuan(cents).cast("string")


def to_cents(amount: Column) -> Column:
    """A two-decimal amount held as double, as integer cents."""
    return F.round(amount * 100).cast("long")
