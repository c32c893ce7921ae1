"""Sample fragments in text form, and the way between fragments and sample rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.operators.series import positions

SENSOR_JSON = T.StructType([
    T.StructField("timestamp", T.LongType()), T.StructField("sensorId", T.IntegerType()),
    T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("sampleRate", T.IntegerType()),
    T.StructField("location", T.StringType()),
])
SERVICE_JSON = T.StructType([
    T.StructField("deviceId", T.StringType()), T.StructField("samples", T.ArrayType(T.DoubleType())),
    T.StructField("sampleRate", T.IntegerType()), T.StructField("timestamp", T.LongType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
MESSAGE_LIMIT = 2000


def parse_fragment_csv(df: DataFrame, text: str, exact: bool = False) -> DataFrame:
    """``device:channel:seq:tsNs,v1,v2,...`` to typed columns plus ``is_valid`` and ``error``.

    ``exact`` wants exactly four header parts, otherwise at least four.
    """
    raw = F.col(text)
    comma = F.instr(raw, ",")
    head = F.split(F.substring_index(raw, ",", 1), ":")
    values = F.split(F.substr(raw, comma + 1), ",")
    out = df.withColumn("__h", head).withColumn("__v", F.transform(values, lambda x: F.trim(x).try_cast("double")))
    parts = F.size("__h")
    error = (
        F.when(raw.isNull() | (comma <= 1), "no_separator")
        .when(parts != 4 if exact else parts < 4, "bad_header")
        .when(F.get("__h", F.lit(1)).try_cast("int").isNull() | F.get("__h", F.lit(2)).try_cast("int").isNull()
              | F.get("__h", F.lit(3)).try_cast("long").isNull(), "bad_header")
        .when(F.exists("__v", lambda x: x.isNull()), "bad_value")
    )
    out = out.withColumn("error", error)
    ok = F.col("error").isNull()
    field = lambda i, kind: F.when(ok, F.get("__h", F.lit(i)).try_cast(kind))
    return (
        out.withColumn("device_id", field(0, "string")).withColumn("channel_id", field(1, "int"))
        .withColumn("seq", field(2, "int")).withColumn("ts_ns", field(3, "long"))
        .withColumn("samples", F.when(ok, F.col("__v"))).withColumn("is_valid", ok).drop("__h", "__v")
    )


def parse_signal_json(df: DataFrame, text: str, schema: T.StructType = SERVICE_JSON) -> DataFrame:
    """JSON fragments; rows without a body or without samples are dropped."""
    parsed = df.select(*[c for c in df.columns if c != text], F.from_json(text, schema).alias("__m"))
    rows = parsed.filter(F.col("__m").isNotNull() & (F.size("__m.samples") > 0))
    out = rows.select("*", "__m.*").drop("__m")
    return out.fillna({"sampleRate": 50000}) if "deviceId" in schema.names else out


def explode_samples(df: DataFrame, rate: Column | float, samples: str = "samples", base: str = "ts_ns") -> DataFrame:
    """Fragment rows to sample rows; sample i is at ``base + i * (1e9 / rate)`` nanoseconds."""
    step = F.floor(F.lit(1e9) / (rate if isinstance(rate, Column) else F.lit(float(rate)))).cast("long")
    rest = [c for c in df.columns if c not in (samples, base)]
    return df.select(*rest, base, step.alias("__step"), F.posexplode(samples).alias("sample_index", "voltage")).select(
        *rest, (F.col(base) + F.col("sample_index") * F.col("__step")).alias(base), "sample_index", "voltage")


def sanitize_table_key(device: Column, channel: Column) -> Column:
    return F.concat_ws("_", F.regexp_replace(F.lower(device), "[^a-z0-9]", "_"), channel.cast("string"))


def device_channel_from_path(path: Column) -> tuple[Column, Column]:
    """Upper-case device and channel from ``<device>-<n>.tdms``; other names are channel 1."""
    name = F.element_at(F.split(path, "/"), -1)
    numbered = F.regexp_extract(name, r"^(.+?)-(\d+)\.tdms$", 1)
    plain = F.regexp_replace(name, r"\.tdms$", "")
    hit = numbered != ""
    return F.upper(F.when(hit, numbered).otherwise(plain)), F.when(hit, F.regexp_extract(name, r"^(.+?)-(\d+)\.tdms$", 2).cast("int")).otherwise(1)


def fragment_series(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, value: str = "value", keep_tail: bool = True,
) -> DataFrame:
    """Sample rows to fragments of ``size`` samples: seq, base time, ordered samples."""
    placed = positions(df, keys, order, "__p").withColumn("seq", F.floor(F.col("__p") / size))
    packed = placed.groupBy(*keys, "seq").agg(
        F.min(order[0]).alias("base"), F.array_sort(F.collect_list(F.struct("__p", F.col(value).alias("v")))).alias("__l"))
    out = packed.select(*keys, "seq", "base", F.transform("__l", lambda x: x["v"]).alias("samples"))
    return out if keep_tail else out.filter(F.size("samples") == size)


def to_dead_letter(df: DataFrame, text: str, job: str, kind: Column, message: Column, limit: int | None = None) -> DataFrame:
    """Error rows with whatever the bad text still says about its origin; with ``limit`` long text is cut with a mark.

    A cut message cannot be replayed, so the whole text is kept by default.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    head = F.split(F.when(F.instr(raw, ",") > 1, F.substring_index(raw, ",", 1)).otherwise(raw), ":")
    part = lambda i: F.coalesce(F.get(head, F.lit(i)), F.lit(""))
    cut = raw if limit is None else F.when(F.length(raw) <= limit, raw).otherwise(F.concat(F.left(raw, F.lit(limit)), F.lit("...[truncated]")))
    return df.select(
        F.lit(job).alias("job"), kind.alias("error_type"), message.alias("error_msg"), cut.alias("original_msg"),
        part(0).alias("device_id"), part(1).try_cast("int").alias("channel_id"), part(2).try_cast("int").alias("seq"))
