"""SQL-callable functions and the plug-in points."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.functions import burst
from sigspark.operators.filters import REGISTRY
from sigspark.operators.scan import Scan, run_block
from sigspark.operators.predicates import not_deleted

BURST = "amplitude double, energy double, area double, counts int"
PERMISSIONS: dict[str, Callable[[], Column]] = {}


def burst_summary(rate: float = 2e6, ratio: float = 0.25):
    """Arrow function from a fragment array to its main burst features."""
    @F.pandas_udf(BURST)
    def summary(col: pd.Series) -> pd.DataFrame:
        rows = []
        for a in col:
            v = np.abs(np.asarray(a, dtype=float)) if a is not None and len(a) else np.zeros(1)
            above = v >= v.max() * ratio
            rows.append((v.max(), float((v * v).sum()), float(v.sum()) / rate, int(above[0]) + int((above[1:] & ~above[:-1]).sum())))
        return pd.DataFrame(rows, columns=["amplitude", "energy", "area", "counts"])

    return summary


def fragment_filter(name: str, **params):
    """Arrow function that filters a fragment array with a registered filter."""
    chosen = REGISTRY[name.upper()](**params)
    if not isinstance(chosen, Scan):
        raise ValueError(f"{name} has no fragment form")

    @F.pandas_udf("array<double>")
    def smooth(col: pd.Series) -> pd.Series:
        arrays = [np.asarray(a, dtype=float) for a in col]
        sizes = [len(a) for a in arrays]
        if not sum(sizes):
            return pd.Series([[] for _ in arrays], dtype=object)
        pos = np.concatenate([np.arange(n) for n in sizes])
        cols = {"value": np.concatenate(arrays), "pos": pos}
        prev, cur, _ = run_block(chosen, cols, pos == 0, np.zeros(chosen.maps.dim))
        flat = chosen.emit(prev, cur, cols)["filtered"]
        return pd.Series([a.tolist() for a in np.split(flat, np.cumsum(sizes)[:-1])], dtype=object)

    return smooth


def register_all(spark: SparkSession, rate: float = 2e6) -> None:
    """Make the functions callable from SQL."""
    spark.udf.register("burst_summary", burst_summary(rate))
    spark.udf.register("kalman_fragment", fragment_filter("KALMAN_LEVEL"))
    burst.register(spark)
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION explode_samples(base BIGINT, rate DOUBLE, samples ARRAY<DOUBLE>)
        RETURNS TABLE (sample_index INT, ts_ns BIGINT, voltage DOUBLE)
        RETURN SELECT s.pos, base + s.pos * CAST(1e9D / rate AS BIGINT), s.col FROM posexplode(samples) AS s(pos, col)""")


def register_permission(table: str, rule: Callable[[], Column]) -> None:
    """Attach a row rule to a table name; ``read_table`` applies it."""
    PERMISSIONS[table] = rule


def read_table(spark: SparkSession, path: str, name: str, tenant=None) -> DataFrame:
    """A table with its logical deletes, tenant and row permission applied; all reach the scan."""
    df = spark.read.parquet(f"{path}/{name}.parquet")
    if "deleted" in df.columns:
        df = not_deleted(df)
    if tenant is not None and "tenant_id" in df.columns:
        df = df.filter(F.col("tenant_id") == tenant)
    return df.filter(PERMISSIONS[name]()) if name in PERMISSIONS else df
