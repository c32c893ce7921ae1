"""Stream operators run over the events file to its end; results equal their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sigspark.operators import features as fx
from sigspark.plans.registry import FRAGMENTS, NUMBERED, SIGNAL, fragments, query, rnd, signal, table
from sigspark.plans.windowing import DAY
from sigspark.session import shared_dir
from sigspark.sources import fragments as fr
from sigspark.sources import sinks
from sigspark.sources.streams import read_fragments_stream, write_fragments_stream
from sigspark.streaming import jobs, stateful


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return read_fragments_stream(spark, "parquet", f"{sf}/events.parquet*", schema)


def signal_stream(spark, sf):
    e = event_stream(spark, sf)
    return e.select(F.col("user_id").alias("dev"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("id"), F.col("event_type").alias("ch"), "value")


def folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def fed(spark, df, part, n, job):
    """What a stream job gives when the rows of part 0, 1, ... ``n`` - 1 (null: 0) arrive one after another.

    Each part is written with its own partitions; the job runs to the end of what is there and goes on from its checkpoint."""
    base = folder(spark)
    number = F.coalesce(part, F.lit(0))
    for i in range(n):
        df.filter(number == i).write.mode("append").parquet(f"{base}/in")
        out = jobs.drain(spark, job(read_fragments_stream(spark, "parquet", f"{base}/in", df.schema)), base)
    return out


def thirds(df, time):
    """Number of the third of the table's time span that a row lies in; rows without a time are in the first."""
    low, high = df.agg(F.min(time), F.max(time)).first()
    span = max(1, -(-(high - low + 1) // 3)) if low is not None else 1
    return F.least(F.floor((F.col(time) - F.lit(low or 0)) / span), F.lit(2))


@query("k02_keyed_filter", f"""WITH RECURSIVE {NUMBERED}, f AS (SELECT dev, i, id, value, value AS y, 1.0::DOUBLE AS p FROM n WHERE i = 0
 UNION ALL SELECT n.dev, n.i, n.id, n.value, f.y + (f.p + 1e-5) / (f.p + 1e-5 + 0.1) * (n.value - f.y), (1 - (f.p + 1e-5) / (f.p + 1e-5 + 0.1)) * (f.p + 1e-5) FROM f JOIN n ON n.dev = f.dev AND n.i = f.i + 1)
SELECT id, round(y, 6) + 0.0 AS filtered FROM f""")
def k02(spark, sf):
    s = signal(spark, sf)
    done = fed(spark, s, thirds(s, "us"), 3, lambda df: stateful.filter_stream(df, "KALMAN", ["dev"], ["us", "id"], span=DAY))
    return done.select("id", rnd("filtered").alias("filtered"))


@query("k03_sliding_window", """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 2 HOUR, ts), time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR]) AS s FROM events) GROUP BY 1, 2""")
def k03(spark, sf):
    out = jobs.window_stats(event_stream(spark, sf), "ts", "4 hours", "2 hours", ["event_type"])
    done = jobs.drain(spark, out, folder(spark), "complete")
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


@query("k04_tumbling_window", "SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, count(*) FILTER (WHERE value > 100) AS anomalies, max(value) AS top FROM events GROUP BY 1")
def k04(spark, sf):
    out = jobs.window_stats(event_stream(spark, sf), "ts", "10 minutes", None, (), anomalies=F.count(F.when(F.col("value") > 100, 1)), top=F.max("value"))
    done = jobs.drain(spark, out, folder(spark), "complete")
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", "anomalies", "top")


@query("k05_trailing_window", f"""WITH {SIGNAL} SELECT id, round(avg(value * value) OVER w + 1.3e-6, 4) AS raw_power, count(*) OVER w AS n, row_number() OVER (PARTITION BY dev ORDER BY us) AS processed FROM s WINDOW w AS (PARTITION BY dev ORDER BY us RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW)""")
def k05(spark, sf):
    s = signal(spark, sf).withColumn("filtered", F.col("value"))
    done = fed(spark, s, thirds(s, "us"), 3, lambda df: stateful.trailing_stream(df, ["dev"], "us", 3 * DAY))
    return done.select("id", rnd(F.col("raw_power") + 1.3e-6, 4).alias("raw_power"), "n", "processed")


@query("k06_reorder", "SELECT conv_id, turn AS seq, md5(text) AS digest, 0::BIGINT AS skipped FROM conversations")
def k06(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("seq"), F.col("text").alias("body"))
    part = F.when(F.col("seq") % 2 == 1, 0).when(F.col("seq") % 4 == 2, 1).otherwise(2)
    done = fed(spark, c, part, 3, lambda df: stateful.reorder_stream(df, ["conv_id"], "seq", "body", wait_ms=3_600_000, timer=False))
    return done.select("conv_id", "seq", F.md5("body").alias("digest"), "skipped")


@query("k07_late_rows", f"WITH {SIGNAL}, t AS (SELECT dev, max((us, id)) AS newest FROM s WHERE id % 10 <> 0 GROUP BY dev) SELECT id FROM s LEFT JOIN t USING (dev) WHERE id % 10 <> 0 OR newest IS NULL OR (us, id) > newest")
def k07(spark, sf):
    part = (F.col("id") % 10 == 0).cast("int")
    return fed(spark, signal(spark, sf), part, 2, lambda df: stateful.filter_stream(df, "IIR", ["dev"], ["us", "id"], span=DAY)).select("id")


@query("k08_side_outputs", "SELECT event_id, 'main' AS sink FROM events UNION ALL SELECT event_id, 'anomaly' FROM events WHERE value > 150 UNION ALL SELECT event_id, 'error' FROM events WHERE event_type = 'error'")
def k08(spark, sf):
    base = folder(spark)
    names = {"main": F.lit(True), "anomaly": F.col("value") > 150, "error": F.col("event_type") == "error"}
    routes = {n: (test, jobs.to_parquet(f"{base}/{n}")) for n, test in names.items()}
    jobs.start(event_stream(spark, sf).select("event_id", "value", "event_type"), f"{base}/checkpoint", jobs.side_outputs(routes), None).awaitTermination()
    parts = [spark.read.parquet(f"{base}/{n}").select("event_id", F.lit(n).alias("sink")) for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("k11_stream_throttle", f"""WITH RECURSIVE {SIGNAL}, n AS (SELECT *, row_number() OVER (PARTITION BY dev, ch ORDER BY us, id) - 1 AS i FROM s),
f AS (SELECT dev, ch, i, id, us, us AS st FROM n WHERE i = 0
  UNION ALL SELECT n.dev, n.ch, n.i, n.id, n.us, CASE WHEN n.us - f.st >= {3 * DAY} THEN n.us ELSE f.st END FROM f JOIN n ON n.dev = f.dev AND n.ch = f.ch AND n.i = f.i + 1)
SELECT id, dev, ch FROM f WHERE st = us""")
def k11(spark, sf):
    s = signal(spark, sf)
    done = fed(spark, s, thirds(s, "us"), 3, lambda df: stateful.throttle_stream(df, ["dev", "ch"], "us", 3 * DAY))
    return done.select("id", "dev", "ch")


@query("k13_offline_stream", """WITH e AS (SELECT DISTINCT user_id AS device_id, ts FROM events), g AS (SELECT *, lead(ts) OVER (PARTITION BY device_id ORDER BY ts) AS later FROM e)
SELECT device_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_report FROM g WHERE coalesce(later, (SELECT max(ts) FROM events)) > ts + INTERVAL 900 MINUTE""")
def k13_stream(spark, sf):
    """Silences that a later report ended and those that the last watermark has found."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("device_id"), F.col("ts").cast("timestamp").alias("report_time"))
    us = e.withColumn("us", F.unix_micros("report_time"))
    done = fed(spark, us, thirds(us, "us"), 3, lambda df: stateful.offline_stream(df, ["device_id"], "report_time", 36_000, 1.5))
    return done.select("device_id", F.date_format("last_report", "yyyy-MM-dd HH:mm:ss").alias("last_report")).distinct()


@query("k12_live_parameters", "SELECT event_id, value > CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 50 ELSE 20 END WHEN 'click' THEN 100 END AS anomaly FROM events")
def k12(spark, sf):
    base = folder(spark)
    e = table(spark, sf, "events")
    write = jobs.to_parquet(f"{base}/out")
    each = jobs.with_parameters(f"{base}/config", "event_type", lambda b, i: write(b.select("event_id", (F.col("value") > F.col("threshold")).alias("anomaly")), i))
    for version, (limit, part) in enumerate([(50.0, "event_id % 2 = 0"), (20.0, "event_id % 2 = 1")], 1):      # the limit changes between the runs
        spark.createDataFrame([("error", limit), ("click", 100.0)], "event_type string, threshold double").write.parquet(f"{base}/config/version={version}")
        e.filter(part).write.mode("append").parquet(f"{base}/in")
        jobs.start(read_fragments_stream(spark, "parquet", f"{base}/in", e.schema), f"{base}/checkpoint", each, None).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "anomaly")


@query("a03_read_stream", "SELECT event_id, user_id, value FROM events")
def a03(spark, sf):
    return jobs.drain(spark, event_stream(spark, sf).select("event_id", "user_id", "value"), folder(spark))


@query("a04_keyed_messages", "SELECT CASE WHEN user_id % 10 = 0 THEN 'unknown' ELSE user_id::VARCHAR END AS key, event_id, value FROM events")
def a04(spark, sf):
    base = folder(spark)
    e = event_stream(spark, sf).select(F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("device"), "event_id", "value")
    write_fragments_stream(e, "device", "json", f"{base}/out", f"{base}/checkpoint", interval=None).start().awaitTermination()
    back = spark.read.schema("key string, value string").json(f"{base}/out")
    return back.select("key", F.from_json("value", "event_id long, value double").alias("m")).select("key", "m.*")


def _stored(spark, sf):
    """Fragments with the tags of the sample tables."""
    f = fragments(spark, sf)
    return f.select(F.concat(F.lit("dev-"), "label").alias("device_id"), (F.col("frag") % 2 + 1).cast("int").alias("channel_id"), F.col("frag").cast("int").alias("seq"),
                    (F.lit(1681105991850321920) + F.col("frag") * 1000000).alias("ts_ns"), "samples")


@query("a06_sample_tables", f"""WITH {FRAGMENTS} SELECT 'raw' AS kind, 'dev-' || label AS device_id, x.frag % 2 + 1 AS channel_id, count(*) AS n, min(1681105991850321920 + x.frag * 1000000 + i * 500) AS first_ns, round(sum(v), 5) + 0.0 AS total FROM x JOIN e ON e.frag = x.frag GROUP BY 2, 3
UNION ALL SELECT 'filtered', 'dev-' || label, x.frag % 2 + 1, count(*), min(1681105991850321920 + x.frag * 1000000 + i * 500), round(sum(v), 5) + 0.0 FROM x JOIN e ON e.frag = x.frag GROUP BY 2, 3""")
def a06(spark, sf):
    base = folder(spark)
    rows = fr.explode_samples(_stored(spark, sf), 2e6)
    sinks.write_raw(rows.withColumn("sampling", F.lit(2000000)), f"{base}/raw")
    sinks.write_filtered(rows, f"{base}/filtered", batch_id=0)
    sinks.write_filtered(rows, f"{base}/filtered", batch_id=0)
    total = lambda k: spark.read.parquet(f"{base}/{k}").groupBy(F.lit(k).alias("kind"), "device_id", "channel_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ns"), rnd(F.sum(F.col("voltage").cast("double")), 5).alias("total"))
    return total("raw").unionByName(total("filtered"))


@query("a07_feature_table", f"""WITH {FRAGMENTS} SELECT 'dev-' || e.label AS device_id, x.frag % 2 + 1 AS channel_id, x.frag AS seq, round(max(abs(v)), 6) AS amplitude, 0.0::DOUBLE AS loc_x, CASE WHEN max(abs(v)) >= 0.3 THEN 1 ELSE 0 END AS is_error FROM x JOIN e ON e.frag = x.frag GROUP BY 1, 2, 3""")
def a07(spark, sf):
    base = folder(spark)
    feats = fx.burst_alarm(fx.burst_features_array(_stored(spark, sf)), amplitude=0.3, energy=1e9, counts=1e9)
    sinks.write_features(feats, f"{base}/features")
    back = spark.read.parquet(f"{base}/features")
    return back.select("device_id", "channel_id", "seq", rnd(F.col("amplitude").cast("double")).alias("amplitude"), F.col("loc_x").cast("double").alias("loc_x"), "is_error")


@query("k01_watermark", """SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM events GROUP BY 1
HAVING min(time_bucket(INTERVAL 6 HOUR, ts)) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def k01(spark, sf):
    marked = stateful.with_event_time(event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour")
    done = jobs.drain(spark, jobs.window_stats(marked, "ts", "6 hours"), folder(spark))
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@query("k09_micro_batches", "SELECT event_id, value FROM events")
def k09(spark, sf):
    base = folder(spark)
    q = jobs.start(event_stream(spark, sf).select("event_id", "value"), f"{base}/checkpoint", jobs.to_parquet(f"{base}/out"), "500 milliseconds")
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(f"{base}/out").select("event_id", "value")


@query("k10_checkpoint_restart", "SELECT event_id, value FROM events")
def k10(spark, sf):
    base = folder(spark)
    e = table(spark, sf, "events").select("event_id", "value")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):      # the second run must take the new files only
        e.filter(part).write.mode("append").parquet(f"{base}/in")
        df = read_fragments_stream(spark, "parquet", f"{base}/in", e.schema)
        jobs.start(df, f"{base}/checkpoint", jobs.to_parquet(f"{base}/out"), None).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "value")
