"""Sources and result tables: fragments built from embeddings and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.operators import detect, filters
from sigspark.operators import features as fx
from sigspark.session import fresh_dir
from sigspark.plans.registry import FRAGMENTS, SIGNAL, fragments, query, rnd, signal, table
from sigspark.sources import fragments as fr
from sigspark.sources import sheets, sinks

_BAD = "CASE WHEN frag % 17 = 1 THEN 'header' WHEN frag % 17 = 2 THEN 'value' WHEN frag % 17 = 3 THEN 'comma' ELSE 'ok' END"


def texts(spark, sf):
    """Fragments as text lines, some of them malformed."""
    f = fragments(spark, sf)
    head = F.concat_ws(":", F.concat(F.lit("DEV-"), "label"), F.col("label").cast("string"), F.col("frag").cast("string"), (F.lit(1681105991850321920) + F.col("frag") * 1000000).cast("string"))
    body = F.array_join(F.transform("samples", lambda x: x.cast("string")), ",")
    k = F.col("frag") % 17
    line = (
        F.when(k == 1, F.concat(F.concat_ws(":", F.concat(F.lit("DEV-"), "label"), F.col("label").cast("string")), F.lit(","), body))
        .when(k == 2, F.concat(head, F.lit(","), body, F.lit(",oops"))).when(k == 3, head).otherwise(F.concat(head, F.lit(","), body))
    )
    return f.select("frag", line.alias("line"))


@query("a01_parse_csv", f"""WITH {FRAGMENTS}, b AS (SELECT *, {_BAD} AS bad FROM e)
SELECT frag, CASE bad WHEN 'header' THEN 'bad_header' WHEN 'value' THEN 'bad_value' WHEN 'comma' THEN 'no_separator' END AS error, CASE WHEN bad = 'ok' THEN 'DEV-' || label END AS device_id,
 CASE WHEN bad = 'ok' THEN label END AS channel_id, CASE WHEN bad = 'ok' THEN 1681105991850321920 + frag * 1000000 END AS ts_ns, CASE WHEN bad = 'ok' THEN round(list_sum(samples), 6) + 0.0 END AS total FROM b""")
def a01(spark, sf):
    out = fr.parse_fragment_csv(texts(spark, sf), "line")
    return out.select("frag", "error", "device_id", "channel_id", "ts_ns", rnd(fx.total(F.col("samples"))).alias("total"))


@query("a02_parse_json", f"WITH {FRAGMENTS} SELECT frag, 'dev' || label AS device, 64 AS n, CASE WHEN frag % 3 = 0 THEN 1000 ELSE 50000 END AS rate, round(list_sum(samples), 6) + 0.0 AS total FROM e WHERE frag % 5 <> 0 AND frag % 7 <> 0")
def a02(spark, sf):
    f = fragments(spark, sf)
    samples = F.when(F.col("frag") % 5 == 0, F.array().cast("array<double>")).otherwise(F.col("samples"))
    body = F.to_json(F.struct(F.concat(F.lit("dev"), "label").alias("deviceId"), samples.alias("samples"), F.when(F.col("frag") % 3 == 0, 1000).alias("sampleRate"), F.col("frag").alias("timestamp")))
    line = f.select("frag", F.when(F.col("frag") % 7 == 0, "not json").otherwise(body).alias("line"))
    out = fr.parse_signal_json(line, "line")
    return out.select("frag", F.col("deviceId").alias("device"), F.size("samples").alias("n"), F.col("sampleRate").alias("rate"), rnd(fx.total(F.col("samples"))).alias("total"))


@query("a05_explode_samples", f"WITH {FRAGMENTS} SELECT frag, i AS sample_index, 1681105991850321920 + frag * 1000000 + i * 500 AS ts_ns, round(v, 9) + 0.0 AS voltage FROM x")
def a05(spark, sf):
    f = fragments(spark, sf).select("frag", (F.lit(1681105991850321920) + F.col("frag") * 1000000).alias("ts_ns"), "samples")
    return fr.explode_samples(f, 2e6).select("frag", "sample_index", "ts_ns", rnd("voltage", 9).alias("voltage"))


@query("a08_table_key", "SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]', '_', 'g') || '_' || s_nationkey AS key FROM supplier")
def a08(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", fr.sanitize_table_key(F.col("s_name"), F.col("s_nationkey")).alias("key"))


@query("a09_device_status", """SELECT user_id AS device_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_heartbeat, count(*) AS total_packets, arg_max(value, ts) AS current_snr,
 round(count(*) / greatest(floor(epoch(max(ts))) - floor(epoch(min(ts))), 1), 9) AS packets_per_second FROM events GROUP BY 1""")
def a09(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("device_id"), "ts", F.col("value").alias("snr"), "event_id")
    halves = [sinks.device_status(e.filter(F.col("event_id") % 2 == t)) for t in (0, 1)]
    out = sinks.merge_status(halves[0], halves[1])
    return out.select("device_id", F.date_format("last_heartbeat", "yyyy-MM-dd HH:mm:ss").alias("last_heartbeat"), "total_packets", "current_snr", rnd("packets_per_second", 9).alias("packets_per_second"))


_IIR = "f AS (SELECT frag, i, v, v AS y FROM x WHERE i = 0 UNION ALL SELECT x.frag, x.i, x.v, 0.1 * x.v + 0.9 * f.y FROM f JOIN x ON x.frag = f.frag AND x.i = f.i + 1)"


@query("a10_filter_result", f"""WITH RECURSIVE {FRAGMENTS}, {_IIR} SELECT frag, count(*) AS sample_count, round(20 * log10(sqrt(avg(v * v)) / sqrt(avg(y * y))), 4) + 0.0 AS snr_improvement, round(avg((v - y) * (v - y)), 8) AS mse_error,
 round(sqrt(avg(v * v)), 8) AS original_rms, round(sqrt(avg(y * y)), 8) AS filtered_rms FROM f GROUP BY frag""")
def a10(spark, sf):
    out = sinks.build_filter_result(filters.filter_fragments(fragments(spark, sf), "IIR"))
    return out.select("frag", "sample_count", *[F.col(c).cast("double").alias(c) for c in ("snr_improvement", "mse_error", "original_rms", "filtered_rms")])


@query("a11_anomaly_record", f"""WITH RECURSIVE {FRAGMENTS}, {_IIR}, b AS (SELECT frag, avg(v - y) AS mu, stddev_pop(v - y) AS sd, count(*) AS n FROM f GROUP BY frag),
r AS (SELECT f.frag, count(*) FILTER (WHERE abs(v - y - mu) > 2 * sd) AS k, max(n) AS n FROM f JOIN b USING (frag) WHERE sd >= 1e-10 GROUP BY f.frag),
j AS (SELECT frag, v - lag(v) OVER (PARTITION BY frag ORDER BY i) AS d FROM x),
s AS (SELECT frag, avg(d) AS mu, stddev_pop(d) AS sd, count(d) AS n FROM j GROUP BY frag),
c AS (SELECT j.frag, count(*) AS k, max(abs(d)) AS top, max(sd) AS sd FROM j JOIN s USING (frag) WHERE abs(d - mu) > 3.5 * sd AND sd >= 1e-10 AND n >= 9 GROUP BY j.frag),
m AS (SELECT frag, avg(v) AS mu, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi, count(*) AS n FROM x GROUP BY frag),
z AS (SELECT frag, greatest((hi - mu) / sd, (mu - lo) / sd) AS z FROM m WHERE n >= 10 AND sd > 1e-10),
found AS (
 SELECT frag, 'RESIDUAL_ANOMALY' AS anomaly_type, least(1.0, k / n * 50) AS score, CASE WHEN k / n < 0.01 THEN 'WARN' ELSE 'ERROR' END AS alert_level, k FROM r WHERE k / n > 0.002
 UNION ALL SELECT frag, 'SUDDEN_CHANGE', least(1.0, top / (3.5 * sd * 2)), CASE WHEN k < 3 THEN 'WARN' ELSE 'ERROR' END, k FROM c
 UNION ALL SELECT frag, 'EXTREME_VALUE', least(1.0, z / 9), 'WARN', 1 FROM z WHERE z > 4.5)
SELECT frag, anomaly_type, round(score, 6) AS anomaly_score, alert_level, '{{"points":' || k || ',"level":"' || alert_level || '"}}' AS context_data FROM found""")
def a11(spark, sf):
    found = detect.fragment_findings(filters.filter_fragments(fragments(spark, sf), "IIR")).select("frag", "findings")
    out = sinks.build_anomaly_record(found)
    return out.select("frag", "anomaly_type", F.col("anomaly_score").cast("double").alias("anomaly_score"), "alert_level", "context_data")


@query("a12_dead_letter", """SELECT doc_id, 'parse' AS job, 'bad' AS error_type, CASE WHEN length(text) <= 2000 THEN length(text) ELSE 2000 + length('...[truncated]') END AS kept, md5(CASE WHEN length(text) <= 2000 THEN text ELSE left(text, 2000) || '...[truncated]' END) AS digest,
 md5(string_split(CASE WHEN instr(text, ',') > 1 THEN split_part(text, ',', 1) ELSE text END, ':')[1]) AS device FROM documents""")
def a12(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    out = fr.to_dead_letter(d, "text", "parse", F.lit("bad"), F.col("doc_id").cast("string"), limit=fr.MESSAGE_LIMIT)
    return out.select(F.col("error_msg").cast("long").alias("doc_id"), "job", "error_type", F.length("original_msg").alias("kept"), F.md5("original_msg").alias("digest"), F.md5("device_id").alias("device"))


@query("a13_device_from_path", """SELECT p_partkey, upper(CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '-') ELSE replace(p_name, ' ', '-') END) AS device, CASE WHEN p_size % 3 = 0 THEN 1 ELSE p_size END AS channel FROM part""")
def a13(spark, sf):
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    path = F.concat(F.lit("/data/run/"), name, F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("-"), "p_size")), F.lit(".tdms"))
    device, channel = fr.device_channel_from_path(path)
    return table(spark, sf, "part").select("p_partkey", device.alias("device"), channel.alias("channel"))


_FRAG = f"WITH {SIGNAL}, n AS (SELECT *, (row_number() OVER (PARTITION BY dev ORDER BY us, id) - 1) // 8 AS seq FROM s) SELECT dev, seq, min(us) AS base, count(*) AS n, string_agg(value::VARCHAR, ',' ORDER BY us, id) AS samples FROM n GROUP BY dev, seq"


def _fragmented(spark, sf, keep_tail):
    out = fr.fragment_series(signal(spark, sf), ["dev"], ["us", "id"], 8, keep_tail=keep_tail)
    return out.select("dev", "seq", "base", F.size("samples").alias("n"), F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


@query("a14_fragment_series", _FRAG)
def a14(spark, sf):
    return _fragmented(spark, sf, True)


@query("a14_fragment_series_full_only", _FRAG + " HAVING count(*) = 8")
def a14_full(spark, sf):
    return _fragmented(spark, sf, False)


@query("a15_route_to_sinks", """WITH r AS (SELECT * FROM (VALUES ('click', NULL, '', [1, 2]), ('error', 8, NULL, [2]), ('error', NULL, 'k', [3, 4]), ('view', NULL, 'z', [1])) t(method, device_id, identifier, sink_ids)),
p AS (SELECT event_id, unnest(sink_ids) AS sink_id FROM events JOIN r ON r.method = event_type AND (r.device_id IS NULL OR r.device_id = user_id) AND (r.identifier IS NULL OR r.identifier IN ('', 'k')))
SELECT DISTINCT event_id, sink_id, CASE sink_id WHEN 1 THEN 'http' WHEN 2 THEN 'kafka' ELSE 'db' END AS kind FROM p WHERE sink_id <> 4""")
def a15(spark, sf):
    rules = spark.createDataFrame([("click", None, "", [1, 2]), ("error", 8, None, [2]), ("error", None, "k", [3, 4]), ("view", None, "z", [1])], "method string, device_id long, identifier string, sink_ids array<int>")
    kinds = spark.createDataFrame([(1, "http", True), (2, "kafka", True), (3, "db", True), (4, "redis", False)], "sink_id int, kind string, enabled boolean")
    msgs = table(spark, sf, "events").select("event_id", F.col("event_type").alias("method"), F.col("user_id").alias("device_id"), F.lit("k").alias("identifier"))
    return sinks.route_to_sinks(msgs, rules, kinds).select("event_id", "sink_id", "kind")


@query("a16_dataset_from_sql", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def a16(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("a16_orders")
    df, names = sheets.dataset_from_sql(spark, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM a16_orders GROUP BY 1, 2")
    return df.select(*names)


_LABELS = {"o_orderstatus": {"O": "open", "F": "filled", "P": "part"}}


@query("a17_sheet_round_trip", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'part' END AS label, printf('%.2f', o_totalprice) AS text, o_orderstatus AS code, round(o_totalprice * 100)::BIGINT AS cents FROM orders")
def a17(spark, sf):
    from sigspark.functions.money import to_cents

    base = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", to_cents(F.col("o_totalprice")).alias("price"))
    path, schema = fresh_dir(spark, "sheet"), "o_orderkey long, o_orderstatus string, price string"
    sheets.export_table(base, path, _LABELS, ["price"])
    shown = spark.read.option("header", True).schema(schema).csv(path).select("o_orderkey", F.col("o_orderstatus").alias("label"), F.col("price").alias("text"))
    back = sheets.import_table(spark, path, schema, _LABELS, ["price"])
    return back.join(shown, "o_orderkey").select("o_orderkey", "label", "text", F.col("o_orderstatus").alias("code"), F.col("price").alias("cents"))
