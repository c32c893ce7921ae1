"""Set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.operators.aggregates import merge_map


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def distinct_by(df: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``keep`` columns."""
    return merge_map(df, keys, keep)


def contains_any(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` not in ``b``, duplicates kept."""
    return a.exceptAll(b)
