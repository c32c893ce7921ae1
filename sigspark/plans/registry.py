"""Named queries over the driver tables, each with the SQL that states its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its meaning in DuckDB SQL."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a sample series: device, channel, time in microseconds, tie-break id, sample."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("dev"), F.col("event_type").alias("ch"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("id"), "value",
    )


SIGNAL = "s AS (SELECT user_id AS dev, event_type AS ch, epoch_us(ts) AS us, event_id AS id, value FROM events)"
NUMBERED = (
    SIGNAL + ", n AS (SELECT *, row_number() OVER (PARTITION BY dev ORDER BY us, id) - 1 AS i FROM s)"
)


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as ready-made sample fragments."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("frag"), F.col("label"), F.col("embedding").cast("array<double>").alias("samples")
    )


FRAGMENTS = (
    "e AS (SELECT vec_id AS frag, label, embedding::DOUBLE[] AS samples FROM embeddings), "
    "x AS (SELECT frag, unnest(samples) AS v, unnest(range(len(samples))) AS i FROM e)"
)


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded value without a negative zero, for comparison across engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)
