"""Stream endpoints: message topics, or files behind the same calls."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter


def read_fragments_stream(
    spark: SparkSession, source: str, where: str, schema: T.StructType | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """``kafka`` topics as ``key`` and ``value`` strings from the latest offsets, or files of any format.

    For ``kafka``, ``where`` is the topic list and the options must name the servers; use
    ``maxOffsetsPerTrigger`` to bound a batch.
    """
    reader = spark.readStream.format(source)
    if source == "kafka":
        reader = reader.option("subscribe", where).option("startingOffsets", "latest")
    elif schema is not None:
        reader = reader.schema(schema)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    if source == "kafka":
        return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")
    return reader.load(where)


def as_messages(df: DataFrame, key: str) -> DataFrame:
    """``key`` and JSON ``value`` columns; a missing key becomes ``unknown``."""
    return df.select(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_fragments_stream(
    df: DataFrame, key: str, sink: str, where: str, checkpoint: str, options: Mapping[str, str] | None = None,
    interval: str | None = "500 milliseconds",
) -> DataStreamWriter:
    """Keyed message sink; ``interval`` None drains what is there and stops."""
    writer = as_messages(df, key).writeStream.format(sink).option("checkpointLocation", checkpoint)
    writer = writer.option("topic", where) if sink == "kafka" else writer.option("path", where)
    for k, v in (options or {}).items():
        writer = writer.option(k, v)
    return writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
