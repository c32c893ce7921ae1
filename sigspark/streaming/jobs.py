"""Stream jobs: windowed statistics, side outputs, live parameters, and the fragment job."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sigspark.operators import features as fx
from sigspark.operators import filters
from sigspark.session import exists
from sigspark.sources import fragments as fr
from sigspark.sources import sinks

Writer = Callable[[DataFrame, int], None]


def window_stats(df: DataFrame, time: str, span: str, slide: str | None = None, keys=(), **aggs: Column) -> DataFrame:
    """Counts and aggregates per tumbling or sliding window; late rows beyond the watermark are left out."""
    win = F.window(time, span, slide) if slide else F.window(time, span)
    out = df.groupBy(win.alias("__w"), *keys).agg(F.count(F.lit(1)).alias("n"), *[c.alias(a) for a, c in aggs.items()])
    return out.select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *keys, "n", *aggs)


def start(
    df: DataFrame, checkpoint: str, each: Writer, interval: str | None = "500 milliseconds", mode: str = "append",
) -> StreamingQuery:
    """Run ``each(batch, batch_id)`` per micro-batch; ``interval`` None drains what is there and stops."""
    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()


def side_outputs(routes: Mapping[str, tuple[Column, Writer]]) -> Writer:
    """One pass over a micro-batch, several filtered sinks."""
    def each(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for test, write in routes.values():
                write(held.filter(test), batch_id)
        finally:
            held.unpersist()

    return each


def to_parquet(path: str) -> Writer:
    """Idempotent sink: a replayed batch overwrites its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def with_parameters(config_path: str, key: str, each: Callable[[DataFrame, int], None]) -> Writer:
    """Join every micro-batch with the parameter table as it is at that moment."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = sinks.versions(spark, config_path)[-1]
        params = spark.read.parquet(f"{config_path}/version={newest}")
        each(batch.join(params, key, "left"), batch_id)

    return run


def fragment_job(
    text: str, out: str, rate: float = 2e6, filter_name: str = "KALMAN_LEVEL", thresholds: Mapping[str, float] | None = None,
) -> Writer:
    """Parse, filter, describe and judge fragments; raw, filtered, feature, anomaly and error tables under ``out``.

    Returns the batch function; the shape is the same for a batch table and a stream.
    """
    limits = dict(thresholds or {})

    def each(batch: DataFrame, batch_id: int) -> None:
        parsed = fr.parse_fragment_csv(batch, text).persist()
        try:
            good = parsed.filter("is_valid").select("device_id", "channel_id", "seq", "ts_ns", "samples")
            sampling = F.lit(int(rate)).alias("sampling")
            sinks.write_raw(fr.explode_samples(good, rate).select("*", sampling), f"{out}/raw_data", batch_id)
            smooth = filters.filter_fragments(good, filter_name)
            sinks.write_filtered(
                fr.explode_samples(smooth.filter("status = 'ok'").select("device_id", "channel_id", "seq", "ts_ns", "filtered"), rate, "filtered"),
                f"{out}/filtered_data", batch_id)
            feats = fx.burst_alarm(fx.burst_features_array(smooth, "filtered", rate), **limits)
            sinks.write_features(feats, f"{out}/feature_data", batch_id)
            found = feats.filter("is_error = 1").select("device_id", "channel_id", "seq", "ts_ns", "error_type", "alert_level")
            to_parquet(f"{out}/anomalies")(found, batch_id)
            bad = fr.to_dead_letter(parsed.filter("NOT is_valid"), text, "fragment_job", F.col("error"), F.col("error"))
            to_parquet(f"{out}/errors")(bad, batch_id)
        finally:
            parsed.unpersist()

    return each


def drain(spark: SparkSession, df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available input into Parquet under ``folder`` and read the result.

    In complete mode every batch holds the whole result, so only the newest one is read.
    """
    path = f"{folder}/out"
    start(df, f"{folder}/checkpoint", to_parquet(path), None, mode).awaitTermination()
    if not exists(spark, path):                             # no batch had rows
        return spark.createDataFrame([], df.schema)
    out = spark.read.parquet(path)
    if mode == "complete":
        out = out.filter(F.col("batch_id") == F.lit(out.agg(F.max("batch_id")).first()[0]))
    return out.drop("batch_id")
