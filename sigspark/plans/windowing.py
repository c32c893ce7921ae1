"""Window operators over the event series and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.operators import filters, windows
from sigspark.operators.aggregates import exact_percentile
from sigspark.operators.restart import restart_windows
from sigspark.operators.series import running
from sigspark.plans.registry import NUMBERED, SIGNAL, query, rnd, signal, table

KEYS, ORDER = ["dev"], ["us", "id"]
W = "PARTITION BY dev ORDER BY us, id"
DAY = 86_400_000_000
SMOOTH = f"{SIGNAL}, m AS (SELECT *, avg(value) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS y FROM s)"


def smoothed(spark, sf):
    return filters.apply_filter(signal(spark, sf), "MEAN", KEYS, ORDER)


_R = f"OVER (PARTITION BY dev ORDER BY us RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW)"


@query("e01_trailing_power", f"""WITH {SMOOTH} SELECT id, round(avg(value * value) {_R} + 1.3e-6, 4) AS raw_power, round(avg(y * y) {_R} + 1.3e-6, 4) AS filtered_power,
round(avg((value - y) * (value - y)) {_R} + 1.3e-6, 4) AS residual_power, count(*) {_R} AS n FROM m""")
def e01(spark, sf):
    out = windows.trailing_power(smoothed(spark, sf), KEYS, "us", 3 * DAY)
    return out.select("id", *[rnd(F.col(c) + 1.3e-6, 4).alias(c) for c in ("raw_power", "filtered_power", "residual_power")], "n")


@query("e02_last_n_rows", f"WITH {SIGNAL} SELECT id, round(sum(value) OVER f, 6) AS total, max(value) OVER f AS top FROM s WINDOW f AS ({W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
def e02(spark, sf):
    out = windows.last_n(signal(spark, sf), KEYS, ORDER, 8, total=F.sum("value"), top=F.max("value"))
    return out.select("id", rnd("total").alias("total"), "top")


@query("e03_centred_same_frame", f"WITH {SIGNAL} SELECT id, round(sum(value) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) + 0.0 AS filtered FROM s")
def e03(spark, sf):
    return filters.apply_filter(signal(spark, sf), "MOVING_AVERAGE", KEYS, ORDER, size=5).select("id", rnd("filtered").alias("filtered"))


@query("e04_successive_difference", f"WITH {SIGNAL} SELECT id, round(value - lag(value) OVER ({W}), 6) + 0.0 AS diff FROM s")
def e04(spark, sf):
    return windows.successive_difference(signal(spark, sf), KEYS, ORDER).select("id", rnd("diff").alias("diff"))


def restart_sql(width: int, test: str = ">", where: str = "true") -> str:
    return f"""{SIGNAL}, n AS (SELECT *, row_number() OVER ({W}) - 1 AS i FROM s WHERE {where}),
f AS (SELECT dev, i, id, us, value, us AS st FROM n WHERE i = 0
  UNION ALL SELECT n.dev, n.i, n.id, n.us, n.value, CASE WHEN n.us - f.st {test} {width} THEN n.us ELSE f.st END FROM f JOIN n ON n.dev = f.dev AND n.i = f.i + 1)"""


@query("e05_resetting_window", f"""WITH RECURSIVE {restart_sql(2 * DAY)}
SELECT id, st AS window_start, round(sum(value * value) OVER (PARTITION BY dev, st ORDER BY us, id), 4) + 0.0 AS energy FROM f""")
def e05(spark, sf):
    out = windows.resetting_energy(signal(spark, sf), KEYS, ORDER, 2 * DAY, "value")
    return out.select("id", "window_start", rnd("energy", 4).alias("energy"))


@query("e06_running_counters", f"WITH {SIGNAL} SELECT id, count(*) OVER w AS processed, count(*) FILTER (WHERE value > 200) OVER w AS anomalies FROM s WINDOW w AS ({W})")
def e06(spark, sf):
    return windows.running_counters(signal(spark, sf), KEYS, ORDER, F.col("value") > 200).select("id", "processed", "anomalies")


@query("e07_streak", f"""WITH {NUMBERED} SELECT id, i - coalesce(max(CASE WHEN value <= 20 THEN i END) OVER (PARTITION BY dev ORDER BY i), -1) AS streak FROM n""")
def e07(spark, sf):
    return windows.streak(signal(spark, sf), KEYS, ORDER, F.col("value") > 20).select("id", "streak")


@query("e07_consecutive_days", """WITH d AS (SELECT DISTINCT user_id AS dev, ts::DATE AS day FROM events),
g AS (SELECT dev, day, date_diff('day', DATE '1970-01-01', day) - row_number() OVER (PARTITION BY dev ORDER BY day) AS run FROM d)
SELECT dev, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, count(*) AS days FROM g GROUP BY dev, run""")
def e07_days(spark, sf):
    days = table(spark, sf, "events").select(F.col("user_id").alias("dev"), F.to_date("ts").alias("day"))
    out = windows.runs(days, KEYS, "day")
    return out.select("dev", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "days")


@query("e08_local_spread", f"""WITH {SMOOTH}, c AS (SELECT *, value - y AS r, row_number() OVER ({W}) - 1 AS i, least(10, count(*) OVER (PARTITION BY dev) // 10) AS w FROM m),
k AS (SELECT id, i, w, list(r) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS l, least(i, 10) AS back FROM c)
SELECT id, round(CASE WHEN w < 2 THEN NULL ELSE list_var_pop(l[greatest(back - w, 0) + 1 : back + w]) END, 4) + 0.0 AS spread2 FROM k WHERE i < 100""".replace(
    "list_var_pop(l[greatest(back - w, 0) + 1 : back + w])", "list_aggregate(l[greatest(back - w, 0) + 1 : back + w], 'var_pop')"))
def e08(spark, sf):
    out = windows.local_spread(smoothed(spark, sf), KEYS, ORDER, points=100)
    return out.select("id", rnd(F.col("spread") * F.col("spread"), 4).alias("spread2"))


@query("e09_rank_by_metric", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place, rank() OVER (ORDER BY c_acctbal DESC) AS rank FROM customer")
def e09(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    placed = windows.rank_by(c, "c_acctbal", ["c_custkey"], "place")
    return windows.rank_by(placed, "c_acctbal", ["c_custkey"], "rank", "rank").select("c_custkey", "place", "rank")


@query("e10_latest_per_property", f"WITH {SIGNAL} SELECT dev, ch, id, value FROM (SELECT *, row_number() OVER (PARTITION BY dev, ch ORDER BY us DESC, id DESC) AS k FROM s) WHERE k = 1")
def e10(spark, sf):
    return windows.latest(signal(spark, sf), ["dev", "ch"], ["us", "id"]).select("dev", "ch", "id", "value")


@query("e11_decimate", f"""WITH {SIGNAL}, c AS (SELECT *, row_number() OVER ({W}) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY dev) // 20) AS k FROM s)
SELECT id, value FROM c WHERE i % k = 0 OR value > 300""")
def e11(spark, sf):
    return windows.decimate(signal(spark, sf), KEYS, ORDER, 20, F.col("value") > 300).select("id", "value")


@query("e12_rolling_z", f"""WITH {SMOOTH}, z AS (SELECT id, abs(value - y) AS a, avg(abs(value - y)) OVER f AS mu, sqrt(greatest(var_pop(abs(value - y)) OVER f, 0)) AS sd, count(*) OVER f AS n FROM m
WINDOW f AS ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT id, CASE WHEN n >= 20 THEN round(mu, 6) END AS roll_mean, CASE WHEN n >= 20 THEN round((a - mu) / (sd + 1e-10), 5) + 0.0 END AS z FROM z""")
def e12(spark, sf):
    out = windows.rolling_stats(smoothed(spark, sf), KEYS, ORDER, "residual")
    return out.select("id", rnd("roll_mean").alias("roll_mean"), rnd("z", 5).alias("z"))


@query("e13_average_jump", f"""WITH {SIGNAL}, j AS (SELECT *, abs(value - lag(value) OVER ({W})) AS jump FROM s)
SELECT id, round(coalesce(avg(jump) OVER ({W} ROWS BETWEEN 48 PRECEDING AND CURRENT ROW), 1) + 1.3e-8, 6) AS avg_jump FROM j""")
def e13(spark, sf):
    return windows.average_jump(signal(spark, sf), KEYS, ORDER, "value").select("id", rnd(F.col("avg_jump") + 1.3e-8).alias("avg_jump"))


@query("e15_sequence_report", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS k FROM lineitem),
t AS (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a)
SELECT l_orderkey, count(*) AS received, count(*) FILTER (WHERE l_linenumber < top) AS out_of_order, count(*) - count(DISTINCT l_linenumber) AS repeats,
  max(l_linenumber) - min(l_linenumber) + 1 - count(DISTINCT l_linenumber) AS missing FROM t GROUP BY l_orderkey""")
def e15(spark, sf):
    return windows.sequence_report(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"], "l_linenumber")


@query("g18_report_cooldown", f"WITH RECURSIVE {restart_sql(2 * DAY, '>=', 'value > 60')} SELECT id, dev, us FROM f WHERE st = us")
def g18(spark, sf):
    found = signal(spark, sf).filter(F.col("value") > 60)
    return restart_windows(found, KEYS, ORDER, 2 * DAY, closed=True).filter(F.col("window_start") == F.col("us")).select("id", "dev", "us")


@query("k11_display_throttle", f"""WITH RECURSIVE {SIGNAL}, n AS (SELECT *, row_number() OVER (PARTITION BY dev, ch ORDER BY us, id) - 1 AS i FROM s),
f AS (SELECT dev, ch, i, id, us, us AS st FROM n WHERE i = 0
  UNION ALL SELECT n.dev, n.ch, n.i, n.id, n.us, CASE WHEN n.us - f.st >= {3 * DAY} THEN n.us ELSE f.st END FROM f JOIN n ON n.dev = f.dev AND n.ch = f.ch AND n.i = f.i + 1)
SELECT id, dev, ch FROM f WHERE st = us""")
def k11(spark, sf):
    out = restart_windows(signal(spark, sf), ["dev", "ch"], ORDER, 3 * DAY, closed=True)
    return out.filter(F.col("window_start") == F.col("us")).select("id", "dev", "ch")


# ---- one key that holds every row -----------------------------------------------------------

ONE = "q AS (SELECT 0 AS dev, epoch_us(l_shipdate) AS us, l_orderkey AS o, l_linenumber AS ln, l_partkey AS p, l_suppkey AS sk, l_quantity AS value FROM lineitem)"
ONE_ORDER = ["us", "o", "ln", "p", "sk"]
_ONE_W = "ORDER BY us, o, ln, p, sk"
_ONE_ID = ["o", "ln", "p", "sk"]


def one_key(spark, sf):
    us = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    return table(spark, sf, "lineitem").select(
        F.lit(0).alias("dev"), us.alias("us"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("p"),
        F.col("l_suppkey").alias("sk"), F.col("l_quantity").alias("value"))


@query("f01_mean_one_key", f"WITH {ONE} SELECT o, ln, p, sk, round(avg(value) OVER ({_ONE_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS filtered FROM q")
def f01_one(spark, sf):
    return filters.apply_filter(one_key(spark, sf), "MEAN", ["dev"], ONE_ORDER).select(*_ONE_ID, rnd("filtered").alias("filtered"))


@query("f05_iir_one_key", f"""WITH {ONE} SELECT o, ln, p, sk, round(list_reduce(list(value) OVER ({_ONE_W} ROWS BETWEEN 300 PRECEDING AND CURRENT ROW), lambda a, x: 0.9 * a + 0.1 * x) + 1.3e-9, 6) AS filtered FROM q""")
def f05_one(spark, sf):
    """After 300 samples the start weighs less than 1e-13."""
    return filters.apply_filter(one_key(spark, sf), "IIR", ["dev"], ONE_ORDER).select(*_ONE_ID, rnd(F.col("filtered") + 1.3e-9).alias("filtered"))


@query("e01_trailing_power_one_key", f"WITH {ONE} SELECT o, ln, p, sk, round(avg(value * value) OVER (ORDER BY us RANGE BETWEEN {30 * DAY} PRECEDING AND CURRENT ROW), 4) AS raw_power, count(*) OVER (ORDER BY us RANGE BETWEEN {30 * DAY} PRECEDING AND CURRENT ROW) AS n FROM q")
def e01_one(spark, sf):
    out = windows.trailing_power(one_key(spark, sf).withColumn("filtered", F.lit(0.0)), ["dev"], "us", 30 * DAY)
    return out.select(*_ONE_ID, rnd("raw_power", 4).alias("raw_power"), "n")


@query("e06_running_one_key", f"WITH {ONE} SELECT o, ln, p, sk, row_number() OVER w AS processed, sum(value) OVER w AS total FROM q WINDOW w AS ({_ONE_W} ROWS UNBOUNDED PRECEDING)")
def e06_one(spark, sf):
    return running(one_key(spark, sf), ["dev"], ONE_ORDER, processed=("count", F.lit(1)), total=("sum", "value")).select(*_ONE_ID, "processed", "total")


@query("d06_percentile_one_key", f"""WITH {ONE}, n AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM q), a AS (SELECT *, 0.95 * (n + 1) AS spot FROM n),
b AS (SELECT max(CASE WHEN i = floor(spot) THEN value END) AS lo, max(CASE WHEN i = floor(spot) + 1 THEN value END) AS hi, max(spot - floor(spot)) AS f FROM a) SELECT 0 AS dev, round(lo + f * (hi - lo), 6) AS percentile FROM b""")
def d06_one(spark, sf):
    out = exact_percentile(one_key(spark, sf), ["dev"], "value", 95.0, ONE_ORDER)
    return out.select("dev", rnd("percentile").alias("percentile"))
