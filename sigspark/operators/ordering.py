"""Sorting, paging and first rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.operators.series import null_safe_join


def order_by(df: DataFrame, fields: Sequence[tuple[str, str]], default: tuple[str, str] | None = None) -> DataFrame:
    """Order by (field, asc | desc) pairs, or by the default when none are given."""
    chosen = list(fields) or ([default] if default else [])
    return df.orderBy(*[F.col(f).asc() if d == "asc" else F.col(f).desc() for f, d in chosen])


def page(df: DataFrame, number: int, size: int, fields: Sequence[tuple[str, str]]) -> tuple[DataFrame, int]:
    """One page and the total row count; size -1 returns everything."""
    ordered = order_by(df, fields)
    rows = ordered if size == -1 else ordered.offset((number - 1) * size).limit(size)
    return rows, df.count()


def first_rows(df: DataFrame, n: int, fields: Sequence[tuple[str, str]]) -> DataFrame:
    return order_by(df, fields).limit(n)


def first_per_key(df: DataFrame, keys: Sequence[str], n: int, fields: Sequence[tuple[str, str]]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(f).asc() if d == "asc" else F.col(f).desc() for f, d in fields])
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


def merge_series(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str], meta: Sequence[str]) -> DataFrame:
    """Many inputs as one series sorted by time, with the metadata of the earliest input."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    info = whole.groupBy(*keys).agg(F.min_by(F.struct(*meta), F.struct(*order)).alias("__m"))
    joined = null_safe_join(whole.drop(*meta), info, keys, "left")
    out = joined.select("*", *[F.col(f"__m.{c}").alias(c) for c in meta]).drop("__m")
    return out.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
