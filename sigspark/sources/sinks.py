"""Result tables: sample and feature stores, device status, filter and anomaly records, routing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.operators.features import array_mean, minus, rms

TAGS = ("device_id", "channel_id")


def append_partitioned(df: DataFrame, path: str, keys: Sequence[str] = TAGS, time: str = "ts_ns", batch_id: int | None = None) -> None:
    """Append rows to a Parquet table partitioned by its tags.

    Rows are range-partitioned by tags *and* time, so a busy device is written by as many tasks as
    its share of the rows, in time-sorted files. With ``batch_id`` (streams) a replayed batch
    overwrites its own folder.
    """
    spread = df.repartitionByRange(*keys, time).sortWithinPartitions(*keys, time)
    writer = spread.write.partitionBy(*keys)
    if batch_id is None:
        writer.mode("append").parquet(path)
    else:
        writer.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_raw(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    append_partitioned(df.select("device_id", "channel_id", "ts_ns", F.col("voltage").cast("float"), "sampling", "seq"), path, batch_id=batch_id)


def write_filtered(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    append_partitioned(df.select("device_id", "channel_id", "ts_ns", F.col("voltage").cast("float"), "seq"), path, batch_id=batch_id)


def feature_rows(df: DataFrame) -> DataFrame:
    """Feature table layout; the two location columns are reserved and zero."""
    floats = ["amplitude", "energy", "area", "skewness", "rise_time", "hit_duration"]
    return df.select(
        *TAGS, "ts_ns", *[F.col(c).cast("float") for c in floats], F.col("counts").cast("int").alias("counts"), F.col("ra").cast("float"), F.col("af").cast("float"),
        "is_error", "error_type", "alert_level", F.lit(0.0).cast("float").alias("loc_x"), F.lit(0.0).cast("float").alias("loc_y"), "seq")


def write_features(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    append_partitioned(feature_rows(df), path, batch_id=batch_id)


def device_status(df: DataFrame, key: str = "device_id", time: str = "ts", snr: str = "snr") -> DataFrame:
    """Per device: first and last heartbeat, packet total, rate and the newest SNR."""
    out = df.groupBy(key).agg(
        F.max(time).alias("last_heartbeat"), F.min(time).alias("session_start_time"),
        F.count(F.lit(1)).alias("total_packets"), F.max_by(snr, time).alias("current_snr"))
    return with_rate(out)


def with_rate(df: DataFrame) -> DataFrame:
    seconds = F.unix_seconds(F.col("last_heartbeat").cast("timestamp")) - F.unix_seconds(F.col("session_start_time").cast("timestamp"))
    return df.withColumn("packets_per_second", F.col("total_packets") / F.greatest(seconds, F.lit(1)))


def merge_status(old: DataFrame, new: DataFrame, key: str = "device_id") -> DataFrame:
    """Status after a batch: newest values win, totals add up."""
    cols = [key, "last_heartbeat", "session_start_time", "total_packets", "current_snr"]
    both = old.select(*cols).unionByName(new.select(*cols))
    return with_rate(both.groupBy(key).agg(
        F.max("last_heartbeat").alias("last_heartbeat"), F.min("session_start_time").alias("session_start_time"),
        F.sum("total_packets").alias("total_packets"), F.max_by("current_snr", "last_heartbeat").alias("current_snr")))


def upsert_device_status(spark: SparkSession, path: str, batch: DataFrame, batch_id: int, key: str = "device_id") -> None:
    """Merge a micro-batch into the status table.

    Every batch writes a new version folder from the last lower one, so a replay gives the same result.
    """
    new = device_status(batch, key)
    older = [v for v in versions(spark, path) if v < batch_id]
    merged = merge_status(spark.read.parquet(f"{path}/version={older[-1]}"), new, key) if older else new
    merged.write.mode("overwrite").parquet(f"{path}/version={batch_id}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of a versioned table, oldest first."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    names = [s.getPath() for s in fs.listStatus(root)]
    done = [p for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def build_filter_result(df: DataFrame, samples: str = "samples", filtered: str = "filtered") -> DataFrame:
    """Filter result records: SNR gain, error and RMS before and after, in the table's decimals."""
    o, f = F.col(samples), F.col(filtered)
    err = array_mean(minus(o, f), lambda x: x * x)
    gain = F.when(rms(f) > 0, 20 * F.log10(rms(o) / rms(f))).otherwise(0.0)
    return df.select(
        *[c for c in df.columns if c not in (samples, filtered)], o.alias("original_samples"), f.alias("filtered_samples"), F.size(o).alias("sample_count"),
        gain.cast("decimal(10,4)").alias("snr_improvement"), err.cast("decimal(15,8)").alias("mse_error"),
        rms(o).cast("decimal(15,8)").alias("original_rms"), rms(f).cast("decimal(15,8)").alias("filtered_rms"))


def build_anomaly_record(df: DataFrame, findings: str = "findings", algorithm: str = "FRAGMENT") -> DataFrame:
    """One record per finding with its context as JSON."""
    rest = [c for c in df.columns if c != findings]
    rows = df.select(*rest, F.explode(findings).alias("f"))
    return rows.select(
        *rest, F.col("f.type").alias("anomaly_type"), F.col("f.score").cast("decimal(10,6)").alias("anomaly_score"), F.col("f.level").alias("alert_level"),
        F.lit(algorithm).alias("detection_algorithm"), F.to_json(F.struct(F.col("f.points").alias("points"), F.col("f.level").alias("level"))).alias("context_data"))


def route_to_sinks(msgs: DataFrame, rules: DataFrame, sinks: DataFrame) -> DataFrame:
    """(message, sink) pairs for every rule whose method, device (null = all) and identifier (empty = any) fit, once per message row.

    ``rules``: method, device_id, identifier, sink_ids; ``sinks``: sink_id, kind, enabled. The live sinks of all rules of the same
    method, device and identifier are one row, so a message meets at most four of them by equality.
    """
    live = F.struct(F.col("sink_id").alias("sink_id"), F.col("kind").alias("kind"))
    flat = rules.select("method", "device_id", F.coalesce("identifier", F.lit("")).alias("identifier"), F.explode("sink_ids").alias("sink_id"))
    open_ = flat.join(sinks.filter("enabled").select("sink_id", "kind"), "sink_id")
    out, found = msgs, []
    for device in (True, False):
        for named in (True, False):
            own = open_.filter((F.col("device_id").isNotNull() if device else F.col("device_id").isNull()) & ((F.col("identifier") != "") if named else (F.col("identifier") == "")))
            keys = ["method", *(["device_id"] if device else []), *(["identifier"] if named else [])]
            found.append(f"__sinks{len(found)}")
            out = out.join(own.groupBy(*keys).agg(F.collect_set(live).alias(found[-1])), keys, "left")
    every = F.flatten(F.array_compact(F.array(*found)))
    return out.withColumn("__s", F.explode(F.array_distinct(every))).select(*msgs.columns, "__s.sink_id", "__s.kind")


def write_routed(df: DataFrame, writers: dict[str, Callable[[DataFrame], None]]) -> None:
    """Hand each sink kind its own rows; the routed table is computed once."""
    held = df.persist()
    try:
        for kind, write in writers.items():
            write(held.filter(F.col("kind") == kind))
    finally:
        held.unpersist()
