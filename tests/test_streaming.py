"""Streams in several micro-batches equal one batch; restarts, late rows, side outputs, sinks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigspark.operators import filters, windows
from sigspark.operators.restart import restart_windows
from sigspark.sources import fragments as fr
from sigspark.sources import sinks
from sigspark.sources.streams import read_fragments_stream, write_fragments_stream
from sigspark.streaming import jobs, stateful

KEYS, ORDER = ["dev"], ["us"]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Three files of 20 rows per device, in time order."""
    path = str(tmp_path_factory.mktemp("parts"))
    rng = np.random.default_rng(1)
    rows = [(d, i * 100, float(rng.normal()), i * 100) for d in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "dev int, us long, value double, ts_ms long")
    for p in range(3):
        df.filter((F.col("us") >= p * 2000) & (F.col("us") < (p + 1) * 2000)).coalesce(1).write.mode("append").parquet(path)
    return path, df


def stream(spark, parts):
    return read_fragments_stream(spark, "parquet", parts[0], parts[1].schema, {"maxFilesPerTrigger": "1"})


def same(a, b, by, cols):
    x = a.select(*by, *cols).toPandas().sort_values(by).reset_index(drop=True)
    y = b.select(*by, *cols).toPandas().sort_values(by).reset_index(drop=True)
    pd.testing.assert_frame_equal(x, y, check_exact=False, rtol=1e-9, check_dtype=False)


@pytest.mark.parametrize("name", ["KALMAN", "LMS", "ADAPTIVE_NOTCH", "PARTICLE", "BUTTERWORTH"])
def test_filter_state_survives_batches(spark, parts, tmp_path, name):
    done = jobs.drain(spark, stateful.filter_stream(stream(spark, parts), name, KEYS, "us"), str(tmp_path))
    same(done, filters.apply_filter(parts[1], name, KEYS, ORDER), ["dev", "us"], ["filtered"])


def test_trailing_and_throttle(spark, parts, tmp_path):
    ready = lambda d: d.withColumn("filtered", F.col("value") * 0.5)
    done = jobs.drain(spark, stateful.trailing_stream(ready(stream(spark, parts)), KEYS, "us", 700), str(tmp_path / "a"))
    same(done, windows.trailing_power(ready(parts[1]), KEYS, "us", 700), ["dev", "us"], ["raw_power", "residual_power", "n"])
    sent = jobs.drain(spark, stateful.throttle_stream(stream(spark, parts), KEYS, "us", 350), str(tmp_path / "b"))
    batch = restart_windows(parts[1], KEYS, ORDER, 350, closed=True).filter("window_start = us")
    same(sent, batch, ["dev", "us"], ["value"])


def test_restart_continues_from_checkpoint(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "dev int, us long, value double"
    rows = [(1, i, float(i % 7)) for i in range(30)]

    def run():
        df = stateful.filter_stream(spark.readStream.schema(schema).parquet(src), "IIR", KEYS, "us")
        jobs.start(df, ck, jobs.to_parquet(out), None).awaitTermination()

    spark.createDataFrame(rows[:10], schema).coalesce(1).write.parquet(src)
    run()
    late = [(1, 4, 99.0)]
    spark.createDataFrame(rows[10:] + late, schema).coalesce(1).write.mode("append").parquet(src)
    run()
    got = spark.read.parquet(out)
    assert got.count() == 30 and got.agg(F.max("dropped")).first()[0] == 1
    same(got, filters.apply_filter(spark.createDataFrame(rows, schema), "IIR", KEYS, ORDER), ["dev", "us"], ["filtered"])


def test_reorder_holds_gaps_and_counts_late(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "dev int, seq long, body string"

    def run(rows, **params):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        df = stateful.reorder_stream(spark.readStream.schema(schema).parquet(src), KEYS, "seq", "body", timer=False, **params)
        return jobs.drain(spark, df, str(tmp_path))

    wait = {"wait_ms": 3_600_000}
    assert sorted(r.seq for r in run([(1, s, "x") for s in (5, 2, 0, 1)], **wait).collect()) == [0, 1, 2]
    assert sorted(r.seq for r in run([(1, 1, "late"), (1, 4, "y"), (1, None, "?")], **wait).collect()) == [0, 1, 2]
    done = run([(1, 3, "z")], **wait)
    assert sorted(r.seq for r in done.collect()) == [0, 1, 2, 3, 4, 5] and done.agg(F.max("skipped")).first()[0] == 2
    done = run([(1, s, "w") for s in (7, 9, 11, 13, 15)], most=4, **wait)
    assert sorted(r.seq for r in done.collect())[6:] == [7, 9, 11] and done.agg(F.max("skipped")).first()[0] == 5


def test_rows_of_many_frames_and_spans(spark, parts, tmp_path):
    """Frames of seven rows in any order, spans of a few rows, several pages a span: the same result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        src = str(tmp_path / "src")
        parts[1].orderBy(F.rand(3)).withColumn("filtered", F.col("value") * 0.5).coalesce(2).write.parquet(src)
        read = lambda: spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
        smooth = jobs.drain(spark, stateful.filter_stream(read().drop("filtered"), "LMS", KEYS, "us", span=900), str(tmp_path / "a"))
        power = jobs.drain(spark, stateful.trailing_stream(read(), KEYS, "us", 700), str(tmp_path / "b"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    same(smooth, filters.apply_filter(parts[1], "LMS", KEYS, ORDER), ["dev", "us"], ["filtered"])
    whole = windows.trailing_power(parts[1].withColumn("filtered", F.col("value") * 0.5), KEYS, "us", 700)
    same(power, whole, ["dev", "us"], ["raw_power", "residual_power", "n"])


def test_small_powers_after_a_large_sample(spark, tmp_path):
    """Nothing is subtracted, so small powers keep their digits and none is negative."""
    src = str(tmp_path / "src")
    rows = [(1, i * 10, 1e9 if i == 5 else 1e-4, 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "dev int, us long, value double, filtered double")
    df.coalesce(1).write.parquet(src)
    got = jobs.drain(spark, stateful.trailing_stream(spark.readStream.schema(df.schema).parquet(src), KEYS, "us", 100), str(tmp_path / "a"))
    late = got.filter("us > 200").agg(F.min("raw_power"), F.max("raw_power")).first()
    assert abs(late[0] - 1e-8) < 1e-20 and abs(late[1] - 1e-8) < 1e-20


def test_silent_devices(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "dev int, at timestamp"

    def run(rows):
        spark.createDataFrame([(d, (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)).to_pydatetime() if m is not None else None) for d, m in rows], schema).write.mode("append").parquet(src)
        return jobs.drain(spark, stateful.offline_stream(spark.readStream.schema(schema).parquet(src), KEYS, "at", 600, 1.0), str(tmp_path))

    run([(1, 0), (2, 0), (1, 5), (3, None)])
    told = run([(1, 8), (1, 30), (2, 12)]).collect()
    minute = lambda t: None if t is None else (t.hour * 60 + t.minute)
    assert {(r.dev, minute(r.last_report), minute(r.back_at)) for r in told} >= {(1, 8, 30), (2, 0, 12), (2, 12, None)}
    told = run([(4, 45), (2, 35)]).collect()
    assert (2, 12, 35) in {(r.dev, minute(r.last_report), minute(r.back_at)) for r in told}
    assert (1, 30, None) in {(r.dev, minute(r.last_report), minute(r.back_at)) for r in told}


def test_fragment_job_and_messages(spark, tmp_path):
    src, out = str(tmp_path / "lines"), str(tmp_path / "tables")
    good = [f"DATA-10-LEFT:{c}:{s}:{1681105991850321920 + s * 2000000}," + ",".join(str(np.sin(i / 5) * 0.02) for i in range(40)) for c in (1, 2) for s in range(3)]
    bad = ["no separator", "DEV:1:2,0.5", "DEV:1:2:3,0.5,x"]
    spark.createDataFrame([(x,) for x in good + bad], "value string").coalesce(1).write.text(src)
    each = jobs.fragment_job("value", out, thresholds={"amplitude": 0.009})
    jobs.start(spark.readStream.format("text").load(src), str(tmp_path / "ck"), each, None).awaitTermination()
    read = lambda t: spark.read.parquet(f"{out}/{t}")
    assert read("raw_data").count() == 240 and read("filtered_data").count() == 240
    assert read("raw_data").filter("channel_id = 2 AND seq = 1").agg(F.min("ts_ns")).first()[0] == 1681105991852321920
    feats = read("feature_data")
    assert feats.count() == 6 and feats.filter("loc_x = 0 AND is_error = 1").count() == 6
    assert read("anomalies").count() == 6
    assert sorted(r.error_type for r in read("errors").collect()) == ["bad_header", "bad_value", "no_separator"]
    for line in good[:1]:
        assert fr.parse_fragment_csv(spark.createDataFrame([(line,)], "v string"), "v", exact=True).first().is_valid
    sent = write_fragments_stream(
        spark.readStream.schema(feats.drop("batch_id").schema).parquet(f"{out}/feature_data/batch_id=0"), "device_id", "json", str(tmp_path / "msg"), str(tmp_path / "ck2"), interval=None).start()
    sent.awaitTermination()
    assert spark.read.json(str(tmp_path / "msg")).select("key").distinct().count() == 1


def test_status_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "status")
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:00:10", 2.0), ("b", "2024-01-01 00:00:05", 3.0)], "device_id string, ts string, snr double")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    sinks.upsert_device_status(spark, path, df, 0)
    later = df.filter("device_id = 'a'").withColumn("ts", F.col("ts") + F.expr("interval 1 minute")).withColumn("snr", F.col("snr") + 5)
    for _ in range(2):
        sinks.upsert_device_status(spark, path, later, 1)
    got = {r.device_id: r for r in spark.read.parquet(f"{path}/version={sinks.versions(spark, path)[-1]}").collect()}
    assert got["a"].total_packets == 4 and got["a"].current_snr == 7.0 and got["b"].total_packets == 1


def test_sheet_files_and_routing(spark, tmp_path):
    from sigspark.sources import sheets

    df = spark.createDataFrame([(1, "A", 12345), (2, "B", 5)], "id int, code string, cents long")
    labels = {"code": {"A": "alpha", "B": "beta"}}
    sheets.export_table(df, str(tmp_path / "sheet"), labels, ["cents"])
    back = sheets.import_table(spark, str(tmp_path / "sheet"), "id int, code string, cents string", labels, ["cents"])
    assert sorted(map(tuple, back.collect())) == [(1, "A", 12345), (2, "B", 5)]
    routed = spark.createDataFrame([(1, "http"), (2, "db"), (3, "db")], "id int, kind string")
    seen = {}
    sinks.write_routed(routed, {"db": lambda d: seen.update(db=d.count()), "http": lambda d: seen.update(http=d.count())})
    assert seen == {"db": 2, "http": 1}


def test_reorder_timer_skips_an_open_gap(spark, tmp_path):
    import time

    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [(1, 2, "c"), (1, 0, "a"), (2, 0, "x"), (2, 1, "y")]
    spark.createDataFrame(rows, "dev int, seq long, body string").coalesce(1).write.parquet(src)
    df = stateful.reorder_stream(spark.readStream.schema("dev int, seq long, body string").parquet(src), KEYS, "seq", "body", wait_ms=200)
    q = jobs.start(df, str(tmp_path / "ck"), jobs.to_parquet(out), "200 milliseconds")
    try:
        got, until = [], time.time() + 40
        while len(got) < 4 and time.time() < until:
            time.sleep(1)
            got = spark.read.parquet(out).collect() if q.lastProgress else []
    finally:
        q.stop()
    assert sorted((r.dev, r.seq, r.body) for r in got) == [(1, 0, "a"), (1, 2, "c"), (2, 0, "x"), (2, 1, "y")]
    assert max(r.skipped for r in got if r.dev == 1) == 1
