"""Features, quality metrics and anomaly detection over the event series, order lines and fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.functions import burst
from sigspark.operators import detect, filters, windows
from sigspark.operators import features as fx
from sigspark.operators.series import positions
from sigspark.plans.registry import FRAGMENTS, NUMBERED, SIGNAL, fragments, query, rnd, signal, table
from sigspark.plans.windowing import DAY, SMOOTH, W, _R, smoothed

KEYS, ORDER = ["dev"], ["us", "id"]
BURST = ["amplitude", "energy", "area", "skewness", "rise_time", "hit_duration", "counts", "ra", "af"]


def long_signal(spark, sf):
    """Order lines as a longer series: device = supplier, sample = quantity."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("dev"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"),
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("value"),
    )


LONG_ORDER = ["us", "o", "ln", "p"]
LONG = "q AS (SELECT l_suppkey AS dev, epoch_us(l_shipdate) AS us, l_orderkey AS o, l_linenumber AS ln, l_partkey AS p, l_quantity AS value FROM lineitem)"


def _burst_sql(source: str, key: str, v: str) -> str:
    """``source`` defines x with the key, 0-based i and the sample."""
    return f"""WITH {source},
b AS (SELECT {key}, max(abs({v})) AS amp, avg({v}) AS mean FROM x GROUP BY {key}),
t AS (SELECT x.{key} AS k, x.i, x.{v} AS v, b.amp, b.mean, abs(x.{v}) >= b.amp * 0.25 AS above FROM x JOIN b ON b.{key} = x.{key}),
u AS (SELECT *, above AND NOT coalesce(lag(above) OVER (PARTITION BY k ORDER BY i), false) AS edge FROM t),
g AS (SELECT k, count(*) AS n, max(amp) AS amplitude, sum(v * v) AS energy, sum(abs(v)) / 1000.0 AS area, sum(v) AS s1, sum(pow(v - mean, 3)) AS c3,
  min(CASE WHEN abs(v) = amp THEN i END) AS peak, min(CASE WHEN above THEN i END) AS fst, max(CASE WHEN above THEN i END) AS lst, count(*) FILTER (WHERE edge) AS counts FROM u GROUP BY k),
h AS (SELECT *, sqrt(greatest(energy / n - (s1 / n) * (s1 / n), 0)) AS sg, CASE WHEN peak >= fst THEN (peak - fst) / 1000.0 ELSE 0 END AS rise, (lst - fst) / 1000.0 AS dur FROM g)
SELECT k AS {key}, round(amplitude, 6) AS amplitude, round(energy, 4) AS energy, round(area, 6) AS area, round(CASE WHEN sg > 1e-15 THEN c3 / n / (sg * sg * sg) ELSE 0 END, 5) + 0.0 AS skewness,
  round(rise, 6) AS rise_time, round(dur, 6) AS hit_duration, counts, round(CASE WHEN amplitude > 1e-15 THEN rise / amplitude ELSE 0 END, 6) AS ra,
  round(CASE WHEN dur > 1e-15 THEN counts / dur ELSE 0 END, 4) AS af FROM h"""


def _burst_out(df, key):
    digits = {"energy": 4, "skewness": 5, "af": 4}
    return df.select(key, *[(F.col(c) if c == "counts" else rnd(c, digits.get(c, 6))).alias(c) for c in BURST])


@query("g01_burst_features", _burst_sql(FRAGMENTS, "frag", "v"))
def g01(spark, sf):
    return _burst_out(fx.burst_features_array(fragments(spark, sf), rate=1000.0), "frag")


@query("g01_burst_features_series", _burst_sql(SIGNAL + f", x AS (SELECT dev, value, row_number() OVER ({W}) - 1 AS i FROM s)", "dev", "value"))
def g01_series(spark, sf):
    placed = positions(signal(spark, sf), KEYS, ORDER, "i")
    return _burst_out(fx.burst_features(placed, KEYS, ORDER, "i", rate=1000.0), "dev")


@query("m02_burst_aggregate", _burst_sql(SIGNAL + f", x AS (SELECT dev, value, row_number() OVER ({W}) - 1 AS i FROM s)", "dev", "value"))
def m02_aggregate(spark, sf):
    burst.register(spark)
    positions(signal(spark, sf), KEYS, ORDER, "i").createOrReplaceTempView("m02_samples")
    parts = "SELECT dev, burst_partial(i, value) AS part FROM m02_samples GROUP BY dev, i DIV 20"
    return _burst_out(spark.sql(f"SELECT dev, b.* FROM (SELECT dev, burst_final(burst_merge(part), 1000D) AS b FROM ({parts}) GROUP BY dev)"), "dev")


@query("e14_threshold_edges", f"""WITH {FRAGMENTS}, t AS (SELECT frag, i, v >= 0.1 AS above FROM x),
u AS (SELECT *, above AND NOT coalesce(lag(above) OVER (PARTITION BY frag ORDER BY i), false) AS edge FROM t)
SELECT frag, min(CASE WHEN above THEN i END) AS first_above, max(CASE WHEN above THEN i END) AS last_above, count(*) FILTER (WHERE edge) AS rising FROM u GROUP BY frag""")
def e14(spark, sf):
    above = F.transform("samples", lambda x: x >= 0.1)
    df = fragments(spark, sf).select("frag", above.alias("a"))
    hit = F.array_position("a", F.lit(True))
    rising = F.filter("a", lambda x, i: x & ((i == 0) | ~F.get(F.col("a"), i - 1)))
    return df.select(
        "frag", F.when(hit > 0, hit - 1).alias("first_above"),
        F.when(hit > 0, F.size("a") - F.array_position(F.reverse("a"), F.lit(True))).alias("last_above"), F.size(rising).alias("rising"))


@query("g02_burst_alarm", _burst_sql(FRAGMENTS, "frag", "v").replace("SELECT k AS frag,", """, z AS (SELECT k AS frag, amplitude, energy, counts FROM h)
SELECT frag, CASE WHEN amplitude >= 0.36 THEN 'amplitude' WHEN energy >= 1.0 THEN 'energy' WHEN counts >= 21 THEN 'counts' ELSE '' END AS error_type,
CASE WHEN amplitude >= 0.36 THEN CASE WHEN amplitude >= 0.36 * 1.67 THEN 3 WHEN amplitude >= 0.36 * 1.33 THEN 2 ELSE 1 END
 WHEN energy >= 1.0 THEN CASE WHEN energy >= 1.67 THEN 3 WHEN energy >= 1.33 THEN 2 ELSE 1 END
 WHEN counts >= 21 THEN CASE WHEN counts >= 21 * 1.67 THEN 3 WHEN counts >= 21 * 1.33 THEN 2 ELSE 1 END ELSE 0 END AS alert_level FROM z --""", 1).replace("\n  round(rise", " --").replace("\n  round(CASE WHEN dur", " --"))
def g02(spark, sf):
    feats = fx.burst_features_array(fragments(spark, sf), rate=1000.0)
    return fx.burst_alarm(feats, amplitude=0.36, energy=1.0, counts=21).select("frag", "error_type", "alert_level")


_AFTER = "CASE WHEN nz < 1e-10 THEN 60.0 ELSE least(60, greatest(-20, 10 * log10(sg / nz))) END"


@query("g03_snr_after", f"""WITH {SMOOTH}, p AS (SELECT dev, avg(y * y) AS sg, avg((value - y) * (value - y)) AS nz FROM m GROUP BY dev)
SELECT dev, round({_AFTER}, 6) + 0.0 AS snr_after FROM p""")
def g03(spark, sf):
    return fx.snr_after(smoothed(spark, sf), KEYS).select("dev", rnd("snr_after").alias("snr_after"))


_LW = "PARTITION BY dev ORDER BY us, o, ln, p"
_SMOOTHED_LONG = f"""{LONG}, c AS (SELECT *, least(50, count(*) OVER (PARTITION BY dev) // 10) AS w, count(*) OVER (PARTITION BY dev) AS n, row_number() OVER ({_LW}) - 1 AS i,
  list(value) OVER ({_LW} ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) AS l FROM q),
sm AS (SELECT dev, n, w, value, list_sum(l[greatest(least(i, 25) - w // 2, 0) + 1 : least(i, 25) + (w - 1) // 2 + 1]) / w AS sm FROM c),
p AS (SELECT dev, max(n) AS n, max(w) AS w, avg(sm * sm) AS sg, avg((value - sm) * (value - sm)) AS nz FROM sm GROUP BY dev)"""


@query("g04_snr_before", f"""WITH {_SMOOTHED_LONG} SELECT dev, round(CASE WHEN n < 100 OR w < 3 THEN 10.0 WHEN nz < 1e-10 THEN 30.0 ELSE least(40, greatest(0, 10 * log10(sg / nz))) END, 5) + 0.0 AS snr_before FROM p""")
def g04(spark, sf):
    return fx.snr_before(long_signal(spark, sf), KEYS, LONG_ORDER).select("dev", rnd("snr_before", 5).alias("snr_before"))


@query("g05_worker_snr", f"""WITH {_SMOOTHED_LONG} SELECT dev, round(CASE WHEN w < 3 THEN 10.0 ELSE least(40, greatest(-20, 10 * log10(sg / greatest(nz, 1e-10)))) END, 5) + 0.0 AS snr_before FROM p""")
def g05(spark, sf):
    out = fx.snr_before(long_signal(spark, sf), KEYS, LONG_ORDER, quiet=None, low=-20.0, high=40.0, least=0)
    return out.select("dev", rnd("snr_before", 5).alias("snr_before"))


_WINDOWED = f"""WITH {SMOOTH}, p AS (SELECT id, us, dev, avg(value * value) {_R} AS rp, avg(y * y) {_R} AS fp, avg((value - y) * (value - y)) {_R} AS np, count(*) {_R} AS n FROM m)"""


@query("g06_windowed_snr", f"""{_WINDOWED} SELECT id, np <= 0 AS no_noise, CASE WHEN np > 0 THEN round(10 * log10(rp / np), 4) + 0.0 END AS snr_before,
  CASE WHEN np > 0 THEN round(10 * log10(fp / np) - 10 * log10(rp / np), 4) + 0.0 END AS snr_delta FROM p""")
def g06(spark, sf):
    out = fx.windowed_snr(windows.trailing_power(smoothed(spark, sf), KEYS, "us", 3 * DAY))
    quiet = F.col("snr_before") == float("inf")
    return out.select("id", quiet.alias("no_noise"), *[rnd(F.when(~quiet, F.col(c)), 4).alias(c) for c in ("snr_before", "snr_delta")])


@query("g07_power_ratio", f"""WITH {SMOOTH} SELECT dev, round(10 * log10(avg(y * y) / avg(value * value)), 6) + 0.0 AS improvement, round(10 * log10(avg(value * value) / avg(y * y)), 6) + 0.0 AS inverse FROM m GROUP BY dev""")
def g07(spark, sf):
    df = smoothed(spark, sf)
    one = fx.power_ratio(df, KEYS).withColumnRenamed("ratio_db", "improvement")
    return one.select("dev", rnd("improvement").alias("improvement"), rnd(-F.col("improvement")).alias("inverse"))


@query("g08_energy_sigmoid", f"WITH {FRAGMENTS} SELECT frag, round(sqrt(avg(v * v)), 6) AS rms, round(1 / (1 + exp(-sqrt(avg(v * v)) / 50 + 2)), 6) AS energy_level FROM x GROUP BY frag")
def g08(spark, sf):
    e = fx.rms(F.col("samples"))
    return fragments(spark, sf).select("frag", rnd(e).alias("rms"), rnd(fx.sigmoid_energy(e)).alias("energy_level"))


_DFT = """k AS (SELECT unnest(range(32)) AS k), d AS (SELECT frag, k, sqrt(pow(sum(v * cos(2 * pi() * k * i / 64.0)), 2) + pow(sum(v * sin(2 * pi() * k * i / 64.0)), 2)) AS m FROM x, k GROUP BY frag, k)"""


@query("g09_spectrum", f"WITH {FRAGMENTS}, {_DFT} SELECT frag, k AS bin, round(m, 6) AS magnitude FROM d")
def g09(spark, sf):
    out = fx.spectrum(fragments(spark, sf).select("frag", "samples")).select("frag", F.posexplode("magnitudes").alias("bin", "m"))
    return out.select("frag", "bin", rnd("m").alias("magnitude"))


@query("g10_high_share", f"WITH {FRAGMENTS}, {_DFT} SELECT frag, round(sum(CASE WHEN k >= 16 THEN m ELSE 0 END) / sum(m), 6) AS share FROM d GROUP BY frag")
def g10(spark, sf):
    return fx.spectrum(fragments(spark, sf).select("frag", "samples")).select("frag", rnd(fx.high_share()).alias("share"))


_BIQUAD2 = """kk AS (SELECT (1 - cos(w)) / 2 / (1 + a) AS b0, (1 - cos(w)) / (1 + a) AS b1, -2 * cos(w) / (1 + a) AS a1, (1 - a) / (1 + a) AS a2
  FROM (SELECT w, sin(w) * (hi - lo) / (2 * w) AS a FROM (SELECT sqrt(lo * hi) AS w, lo, hi FROM (SELECT 2 * pi() * 1e4 / 1e6 AS lo, 2 * pi() * 5e5 / 1e6 AS hi)))),
r AS (SELECT frag, i, v AS x1, 0.0::DOUBLE AS x2, b0 * v AS y1, 0.0::DOUBLE AS y2, b0 * b0 * v AS z1, 0.0::DOUBLE AS z2 FROM x, kk WHERE i = 0
 UNION ALL SELECT x.frag, x.i, x.v, r.x1, b0 * x.v + b1 * r.x1 + b0 * r.x2 - a1 * r.y1 - a2 * r.y2, r.y1,
  b0 * (b0 * x.v + b1 * r.x1 + b0 * r.x2 - a1 * r.y1 - a2 * r.y2) + b1 * r.y1 + b0 * r.y2 - a1 * r.z1 - a2 * r.z2, r.z1
  FROM r JOIN x ON x.frag = r.frag AND x.i = r.i + 1 JOIN kk ON true),
y AS (SELECT frag, i, z1 AS v FROM r)"""


@query("g11_energy_frequency", f"""WITH RECURSIVE {FRAGMENTS}, {_BIQUAD2}, {_DFT.replace("FROM x, k", "FROM y, k")},
a AS (SELECT frag, sum(CASE WHEN k >= 16 THEN m ELSE 0 END) / sum(m) AS fs FROM d GROUP BY frag),
b AS (SELECT frag, 1 / (1 + exp(-sqrt(avg(v * v)) / 50 + 2)) AS es FROM y GROUP BY frag)
SELECT frag, round(es, 6) AS energy_level, round(fs, 6) AS frequency_score, round((es + fs) / 2, 6) AS anomaly_score, (es + fs) / 2 > 0.75 AS is_anomaly,
 CASE WHEN (es + fs) / 2 <= 0.75 THEN 'NORMAL' WHEN es > 0.8 THEN 'HIGH_ENERGY' WHEN fs > 0.8 THEN 'FREQUENCY_ANOMALY' ELSE 'MIXED_ANOMALY' END AS anomaly_type FROM a JOIN b USING (frag)""")
def g11(spark, sf):
    out = detect.energy_frequency(fragments(spark, sf))
    return out.select("frag", *[rnd(c).alias(c) for c in ("energy_level", "frequency_score", "anomaly_score")], "is_anomaly", "anomaly_type")


@query("g12_crossing_frequency", f"""WITH {FRAGMENTS}, z AS (SELECT frag, v, (sign(v) <> lag(sign(v)) OVER (PARTITION BY frag ORDER BY i))::INT AS x FROM x)
SELECT frag, round(coalesce(sum(x), 0) / 2.0 / (count(*) / 1000.0), 4) AS frequency, round(min(v), 6) + 0.0 AS low, round(max(v), 6) + 0.0 AS high, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std FROM z GROUP BY frag""")
def g12(spark, sf):
    long = fragments(spark, sf).select("frag", F.posexplode("samples").alias("i", "value"))
    out = fx.crossing_frequency(long, ["frag"], ["i"], rate=1000.0)
    return out.select("frag", rnd("frequency", 4).alias("frequency"), *[rnd(c).alias(c) for c in ("low", "high", "mean", "std")])


@query("g13_reference_metrics", f"""WITH {SIGNAL}, m AS (SELECT dev, value, avg(value) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS y, sum(value) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS ref FROM s),
k AS (SELECT dev, avg(pow(value - ref, 2)) AS mb, avg(pow(y - ref, 2)) AS ma, corr(ref, value) AS cb, corr(ref, y) AS ca FROM m GROUP BY dev)
SELECT dev, round(mb, 4) AS mse_before, round(ma, 4) AS mse_after, round((mb - ma) / mb * 100, 4) + 0.0 AS improvement, round(cb, 5) + 0.0 AS corr_before, round(ca, 5) + 0.0 AS corr_after FROM k""")
def g13(spark, sf):
    df = smoothed(spark, sf).withColumnRenamed("filtered", "y").drop("residual")
    df = filters.apply_filter(df, "MOVING_AVERAGE", KEYS, ORDER, size=5)
    out = fx.reference_metrics(df, KEYS, "filtered", "value", "y")
    digits = {"corr_before": 5, "corr_after": 5}
    return out.select("dev", *[rnd(c, digits.get(c, 4)).alias(c) for c in ("mse_before", "mse_after", "improvement", "corr_before", "corr_after")])


_IIR = "f AS (SELECT frag, i, v, v AS y FROM x WHERE i = 0 UNION ALL SELECT x.frag, x.i, x.v, 0.1 * x.v + 0.9 * f.y FROM f JOIN x ON x.frag = f.frag AND x.i = f.i + 1)"


def _findings(spark, sf):
    return detect.fragment_findings(filters.filter_fragments(fragments(spark, sf), "IIR"))


def _found(df, kind):
    one = df.select("frag", F.explode("findings").alias("f")).filter(F.col("f.type") == kind)
    return one.select("frag", F.col("f.level").alias("level"), rnd("f.score", 5).alias("score"), F.col("f.points").alias("points"))


@query("g14_residual_detector", f"""WITH RECURSIVE {FRAGMENTS}, {_IIR}, b AS (SELECT frag, avg(v - y) AS mu, stddev_pop(v - y) AS sd, count(*) AS n FROM f GROUP BY frag),
c AS (SELECT f.frag, count(*) FILTER (WHERE abs(v - y - mu) > 2 * sd) AS k, max(n) AS n FROM f JOIN b USING (frag) WHERE sd >= 1e-10 GROUP BY f.frag)
SELECT frag, CASE WHEN k / n < 0.01 THEN 'WARN' ELSE 'ERROR' END AS level, round(least(1.0, k / n * 50), 5) AS score, k AS points FROM c WHERE k / n > 0.002""")
def g14(spark, sf):
    return _found(_findings(spark, sf), "RESIDUAL_ANOMALY")


@query("g15_sudden_change", f"""WITH {FRAGMENTS}, j AS (SELECT frag, v - lag(v) OVER (PARTITION BY frag ORDER BY i) AS d FROM x),
b AS (SELECT frag, avg(d) AS mu, stddev_pop(d) AS sd FROM j WHERE d IS NOT NULL GROUP BY frag),
c AS (SELECT j.frag, count(*) AS k, max(abs(d)) AS top, max(sd) AS sd FROM j JOIN b USING (frag) WHERE abs(d - mu) > 3.5 * sd AND sd >= 1e-10 GROUP BY j.frag)
SELECT frag, CASE WHEN k < 3 THEN 'WARN' ELSE 'ERROR' END AS level, round(least(1.0, top / (3.5 * sd * 2)), 5) AS score, k AS points FROM c""")
def g15(spark, sf):
    return _found(_findings(spark, sf), "SUDDEN_CHANGE")


@query("g16_amplitude_drift", f"""WITH RECURSIVE {FRAGMENTS}, b AS (SELECT e.label AS dev, x.frag, avg(v) AS m, stddev_pop(v) AS sd FROM x JOIN e ON e.frag = x.frag GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY dev ORDER BY frag) - 1 AS i FROM b),
h AS (SELECT dev, i, frag, m, sd, m AS hm, sd AS hs FROM n WHERE i = 0
 UNION ALL SELECT n.dev, n.i, n.frag, n.m, n.sd, 0.99 * h.hm + 0.01 * n.m, 0.99 * h.hs + 0.01 * n.sd FROM h JOIN n ON n.dev = h.dev AND n.i = h.i + 1)
SELECT frag, round(hm, 6) + 0.0 AS history_mean, round(hs, 6) AS history_std, round(abs(m - hm) / hs, 5) AS mean_deviation, round(abs(sd - hs) / hs, 5) AS std_deviation,
 CASE WHEN i + 1 > 10 AND abs(m - hm) / hs > 0.1 THEN CASE WHEN abs(m - hm) / hs < 6 THEN 'WARN' ELSE 'ERROR' END END AS mean_level FROM h""")
def g16(spark, sf):
    df = fragments(spark, sf).withColumnRenamed("label", "dev")
    out = detect.drift_findings(df, ["dev"], ["frag"], sigmas=0.1)
    return out.select("frag", rnd("history_mean").alias("history_mean"), rnd("history_std").alias("history_std"),
                      rnd("mean_deviation", 5).alias("mean_deviation"), rnd("std_deviation", 5).alias("std_deviation"), "mean_level")


@query("g17_extreme_value", f"""WITH {FRAGMENTS}, b AS (SELECT frag, avg(v) AS mu, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi FROM x GROUP BY frag)
SELECT frag, 'WARN' AS level, round(least(1.0, greatest((hi - mu) / sd, (mu - lo) / sd) / (1.2 * 3)), 5) AS score FROM b WHERE greatest((hi - mu) / sd, (mu - lo) / sd) > 1.2 * 1.5""")
def g17(spark, sf):
    found = fragments(spark, sf).select("frag", detect.extreme_finding("samples", 1.2).alias("f")).filter(F.col("f").isNotNull())
    return found.select("frag", F.col("f.level").alias("level"), rnd("f.score", 5).alias("score"))


def _energy_sql(expr: str, limit: float) -> str:
    return f"""{_WINDOWED}, e AS (SELECT *, {expr} AS energy FROM p)
SELECT id, energy > {limit} AS anomaly, count(*) FILTER (WHERE energy > {limit}) OVER (PARTITION BY dev ORDER BY us, id) AS anomaly_count FROM e"""


def _energy(mode: str, limit: float):
    def run(spark, sf):
        out = detect.energy_threshold(smoothed(spark, sf), KEYS, ORDER, 3 * DAY, limit, mode)
        return out.select("id", "anomaly", "anomaly_count")

    return run


query("g19_energy_residual", _energy_sql("np * n", 10001.7))(_energy("residual", 10001.7))
query("g19_energy_raw", _energy_sql("rp * n", 20001.7))(_energy("raw", 20001.7))
query("g19_energy_raw_mean", _energy_sql("rp", 3001.7))(_energy("raw_mean", 3001.7))


@query("g20_automatic_threshold", f"WITH {SIGNAL} SELECT dev, round(5 * avg(value * value), 4) AS threshold FROM s GROUP BY dev")
def g20(spark, sf):
    return detect.automatic_threshold(signal(spark, sf), KEYS).select("dev", rnd("threshold", 4).alias("threshold"))


_K13 = "(h.p + 1e-5) / (h.p + 1e-5 + 0.1)"


@query("g21_history_analysis", f"""WITH RECURSIVE {NUMBERED},
h AS (SELECT dev, i, id, us, value, value AS y, 1.0::DOUBLE AS p, us AS st FROM n WHERE i = 0
 UNION ALL SELECT n.dev, n.i, n.id, n.us, n.value, CASE WHEN n.i < 10 THEN (h.y * n.i + n.value) / (n.i + 1) ELSE h.y + {_K13} * (n.value - h.y) END,
  CASE WHEN n.i < 10 THEN 1.0 ELSE (1 - {_K13}) * (h.p + 1e-5) END, CASE WHEN n.us - h.st > {2 * DAY} THEN n.us ELSE h.st END FROM h JOIN n ON n.dev = h.dev AND n.i = h.i + 1),
e AS (SELECT *, sum((value - y) * (value - y)) OVER (PARTITION BY dev, st ORDER BY us, id) AS energy FROM h),
c AS (SELECT dev, list_sort(list(energy)) AS l, count(*) AS n, 95.0 * (count(*) + 1) / 100 AS pos FROM e GROUP BY dev),
t AS (SELECT dev, n, 1.5 * CASE WHEN pos >= n THEN l[n] ELSE l[floor(pos)::INT] + (pos - floor(pos)) * (l[floor(pos)::INT + 1] - l[floor(pos)::INT]) END AS threshold FROM c)
SELECT id, round(y, 5) AS filtered, round(energy, 3) + 0.0 AS energy, energy > threshold AS anomaly, round((us - min(us) OVER (PARTITION BY e.dev)) / 1e6, 6) AS seconds
FROM e JOIN t ON t.dev = e.dev QUALIFY i % greatest(1, n // 20) = 0 OR energy > threshold""")
def g21(spark, sf):
    out = detect.history_analysis(signal(spark, sf), KEYS, ORDER, 2 * DAY, max_points=20)
    return out.select("id", rnd("filtered", 5).alias("filtered"), rnd("energy", 3).alias("energy"), "anomaly", rnd("seconds").alias("seconds"))


_SIG3 = f"""b AS (SELECT dev, avg(value) AS mu, stddev_pop(value) AS sd, count(*) AS n FROM s GROUP BY dev),
amp AS (SELECT s.dev, count(*) AS points, max(n) AS n FROM s JOIN b ON b.dev = s.dev WHERE value > mu + 3 * sd OR value < mu - 3 * sd GROUP BY s.dev)"""


@query("g22_three_sigma", f"WITH {SIGNAL}, {_SIG3} SELECT dev, CASE WHEN points > n * 0.1 THEN 'ERROR' ELSE 'WARNING' END AS severity, points FROM amp")
def g22(spark, sf):
    return detect.amplitude_findings(signal(spark, sf), KEYS).select("dev", "severity", "points")


@query("g22_three_sigma_rows", f"WITH {SIGNAL}, {_SIG3} SELECT id, round(mu + 3 * sd, 5) AS high FROM s JOIN b ON b.dev = s.dev WHERE value > mu + 3 * sd OR value < mu - 3 * sd")
def g22_rows(spark, sf):
    return detect.three_sigma(signal(spark, sf), KEYS).select("id", rnd("high", 5).alias("high"))


_TREND = f"""sz AS (SELECT *, least(10, count(*) OVER (PARTITION BY dev) // 4) AS w, row_number() OVER ({W}) - 1 AS i, list(value) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM s),
ma AS (SELECT *, CASE WHEN i >= w - 1 THEN list_avg(l[len(l) - w + 1 :]) END AS ma FROM sz),
ch AS (SELECT *, abs(ma - lag(ma) OVER ({W})) AS change FROM ma),
th AS (SELECT dev, avg(change) + 2 * stddev_pop(change) AS threshold FROM ch GROUP BY dev),
br AS (SELECT ch.*, i - w + 1 + w // 2 AS at FROM ch JOIN th ON th.dev = ch.dev WHERE change > threshold)"""


@query("g23_trend_breaks", f"WITH {SIGNAL}, {_TREND} SELECT dev, br.at AS position FROM br")
def g23(spark, sf):
    return detect.trend_breaks(signal(spark, sf), KEYS, ORDER).select("dev", F.col("at").alias("position"))


_CENTRED = "s AS (SELECT user_id AS dev, epoch_us(ts) AS us, event_id AS id, value - 60.0 AS value FROM events)"


@query("g24_crossing_rate", f"""WITH {_CENTRED}, x AS (SELECT dev, ((value >= 0) <> (lag(value) OVER ({W}) >= 0))::INT AS c FROM s)
SELECT dev, round(sum(c) / count(*) + 1.3e-8, 6) AS crossing_rate FROM x GROUP BY dev""")
def g24(spark, sf):
    df = signal(spark, sf).withColumn("value", F.col("value") - 60.0)
    return detect.crossing_rate(df, KEYS, ORDER).select("dev", rnd(F.col("crossing_rate") + 1.3e-8).alias("crossing_rate"))


@query("g25_quality_label", f"""WITH {SMOOTH}, r AS (SELECT dev, 10 * log10(avg(y * y) / avg(value * value)) AS d FROM m GROUP BY dev)
SELECT dev, CASE WHEN d > 10 THEN 'excellent' WHEN d > 5 THEN 'good' WHEN d > 0 THEN 'fair' WHEN d > -5 THEN 'poor' ELSE 'bad' END AS label, d < -10 AS fault FROM r""")
def g25(spark, sf):
    out = fx.power_ratio(smoothed(spark, sf), KEYS)
    return out.select("dev", fx.quality_label(F.col("ratio_db")).alias("label"), (F.col("ratio_db") < -10).alias("fault"))


@query("g26_overall_score", f"""WITH {SIGNAL}, {_SIG3}, {_TREND},
x AS (SELECT dev, ((value >= 0) <> (lag(value) OVER ({W}) >= 0))::INT AS c FROM s), fr AS (SELECT dev, sum(c) / count(*) AS r FROM x GROUP BY dev),
m AS (SELECT dev, value, avg(value) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS y FROM s),
f AS (SELECT dev, CASE WHEN points > n * 0.1 THEN 0.8 ELSE 0.5 END AS w FROM amp
 UNION ALL SELECT dev, CASE WHEN count(*) > 3 THEN 0.5 ELSE 0.2 END FROM br GROUP BY dev
 UNION ALL SELECT dev, 0.2 FROM fr WHERE r > 0.5 OR r < 0.01
 UNION ALL SELECT dev, 0.5 FROM m GROUP BY dev HAVING 10 * log10(avg(y * y) / avg(value * value)) < -10)
SELECT dev, count(*) AS findings, round(avg(w), 4) AS score, CASE max(w) WHEN 0.8 THEN 'ERROR' WHEN 0.5 THEN 'WARNING' ELSE 'INFO' END AS level FROM f GROUP BY dev""")
def g26(spark, sf):
    out = detect.health_check(smoothed(spark, sf), KEYS, ORDER)
    return out.select("dev", "findings", rnd("score", 4).alias("score"), "level")


def _zscore_sql(reset: bool) -> str:
    kind = "CASE WHEN n < 20 THEN NULL WHEN z > 2 THEN 'RESIDUAL_ANOMALY' WHEN jump > aj * 4 THEN 'SUDDEN_CHANGE'" + (
        " WHEN unc > mu * 2 THEN 'UNCERTAINTY_HIGH'" if reset else "") + " END"
    score = "CASE WHEN z > 2 THEN least(z / 2, 1.0) WHEN jump > aj * 4 THEN least(jump / (aj * 4), 1.0)" + (
        " ELSE least(unc / (mu * 2), 1.0)" if reset else "") + " END"
    run = "i - coalesce(max(CASE WHEN type IS NULL THEN i END) OVER (PARTITION BY dev ORDER BY i), -1)" if reset else "count(type) OVER (PARTITION BY dev ORDER BY i)"
    return f"""WITH RECURSIVE {NUMBERED},
f AS (SELECT dev, i, id, value, value AS x, 1.0::DOUBLE AS a, 0.0::DOUBLE AS e FROM n WHERE i = 0
 UNION ALL SELECT n.dev, n.i, n.id, n.value, f.x + f.a / (f.a + 0.1) * (n.value - f.x), f.a - f.a / (f.a + 0.1) * f.a, n.value - f.x FROM f JOIN n ON n.dev = f.dev AND n.i = f.i + 1),
j AS (SELECT *, sqrt(a) AS unc, abs(x - lag(x) OVER (PARTITION BY dev ORDER BY i)) AS jump FROM f),
k AS (SELECT *, count(*) OVER w AS n, avg(abs(e)) OVER w AS mu, (abs(e) - avg(abs(e)) OVER w) / (stddev_pop(abs(e)) OVER w + 1e-10) AS z,
  avg(jump) OVER (PARTITION BY dev ORDER BY i ROWS BETWEEN 48 PRECEDING AND CURRENT ROW) AS aj FROM j WINDOW w AS (PARTITION BY dev ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
t AS (SELECT *, {kind} AS type FROM k), c AS (SELECT *, {run} AS consecutive, {score} AS score FROM t)
SELECT id, type, round(score, 4) AS score, consecutive, CASE WHEN consecutive >= 3 THEN 'ERROR' WHEN score > 0.7 THEN 'WARN' ELSE 'INFO' END AS level FROM c WHERE type IS NOT NULL"""


def _zscore(reset: bool):
    def run(spark, sf):
        out = detect.residual_zscore(signal(spark, sf), KEYS, ORDER, sigmas=2.0, reset=reset)
        return out.select("id", "type", rnd("score", 4).alias("score"), "consecutive", "level")

    return run


query("g27_residual_zscore", _zscore_sql(False))(_zscore(False))
query("g27_residual_zscore_reset", _zscore_sql(True))(_zscore(True))


@query("g28_fragment_report", f"""WITH RECURSIVE {FRAGMENTS}, {_IIR}, p AS (SELECT frag, min(v) AS lo, max(v) AS hi, avg(v) AS mu, sqrt(avg(v * v)) AS r, sqrt(avg(y * y)) AS fr, count(*) AS n,
 avg(y * y) AS sg, avg((v - y) * (v - y)) AS nz, avg(abs(v - y)) AS err FROM f GROUP BY frag)
SELECT frag, round(lo, 6) + 0.0 AS low, round(hi, 6) + 0.0 AS high, round(mu, 6) + 0.0 AS mean, round(r, 6) AS rms, round(fr, 6) AS filtered_rms, n AS kept, least(n, 100) AS residuals,
 round({_AFTER}, 2) + 0.0 AS snr_after, round(err, 6) AS current_error FROM p""")
def g28(spark, sf):
    out = fx.fragment_report(filters.filter_fragments(fragments(spark, sf), "IIR"), points=500, gaps=100)
    s = lambda c: rnd(F.col(f"statistics.{c}"))
    return out.select("frag", s("min").alias("low"), s("max").alias("high"), s("avg").alias("mean"), s("rms").alias("rms"), s("filtered_rms").alias("filtered_rms"),
                      F.size("original").alias("kept"), F.size("residuals").alias("residuals"), rnd("snr_after", 2).alias("snr_after"), rnd("current_error").alias("current_error"))


@query("g29_throughput", f"""WITH {SIGNAL} SELECT dev, count(*) AS n, round(count(*) / greatest((max(us) - min(us)) / 1e6, 0.001), 9) AS per_second,
 round((1706745600000000 - max(us)) / 1000.0, 3) AS delay_ms FROM s GROUP BY dev""")
def g29(spark, sf):
    out = fx.throughput(signal(spark, sf), KEYS, now_us=1706745600000000)
    return out.select("dev", "n", rnd("per_second", 9).alias("per_second"), rnd("delay_ms", 3).alias("delay_ms"))


@query("g30_capped_findings", f"""WITH {SIGNAL}, f AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY us, id) AS k, count(*) OVER (PARTITION BY ch) AS total FROM s WHERE value > 100)
SELECT id, ch, total FROM f WHERE k <= 100""")
def g30(spark, sf):
    found = signal(spark, sf).filter(F.col("value") > 100)
    return detect.capped(found, ["ch"], [F.col("us"), F.col("id")], 100).select("id", "ch", "total")


@query("g31_channel_summary", f"WITH {SIGNAL} SELECT dev, ch, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value) + 1.3e-8, 6) AS mean, round(stddev_pop(value), 6) AS std, max(us) - min(us) AS length_us FROM s GROUP BY dev, ch")
def g31(spark, sf):
    out = fx.channel_summary(signal(spark, sf), ["dev", "ch"])
    return out.select("dev", "ch", "n", "low", "high", rnd(F.col("mean") + 1.3e-8).alias("mean"), rnd("std").alias("std"), "length_us")


@query("device_health", f"""{_WINDOWED}, e AS (SELECT p.*, m.value, m.y, np * n > 10001.7 AS anomaly FROM p JOIN m ON m.id = p.id)
SELECT dev, count(*) AS samples, count(*) FILTER (WHERE anomaly) AS anomalies, round(sqrt(avg(value * value)), 5) AS rms,
 round(least(60, greatest(-20, 10 * log10(avg(y * y) / avg((value - y) * (value - y))))), 5) + 0.0 AS snr FROM e GROUP BY dev""")
def device_health(spark, sf):
    df = detect.energy_threshold(smoothed(spark, sf), KEYS, ORDER, 3 * DAY, 10001.7)
    v, y = F.col("value"), F.col("filtered")
    snr = fx.clipped_db(F.avg(y * y), F.avg((v - y) * (v - y)), -20.0, 60.0)
    return df.groupBy("dev").agg(
        F.count(F.lit(1)).alias("samples"), F.count(F.when(F.col("anomaly"), 1)).alias("anomalies"),
        rnd(F.sqrt(F.avg(v * v)), 5).alias("rms"), rnd(snr, 5).alias("snr"))
