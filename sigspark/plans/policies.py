"""Rules, lifecycle policies and plug-in functions on events, orders and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.functions import udf
from sigspark.functions.money import to_cents
from sigspark.operators import filters, lifecycle, rules
from sigspark.operators.scan import AffineMaps, Scan
from sigspark.plans.registry import FRAGMENTS, SIGNAL, fragments, query, rnd, signal, table

METHOD = "CASE event_type WHEN 'error' THEN 'thing.event.post' WHEN 'view' THEN 'thing.service.invoke' WHEN 'signup' THEN 'thing.state.update' ELSE 'thing.property.post' END"
MSG = f"m AS (SELECT event_id AS message_id, user_id AS device_id, user_id % 4 AS product_id, {METHOD} AS method, json_extract_string(props, '$.k')::DOUBLE AS k, value, (event_id % 3)::VARCHAR AS state, ts FROM events)"


def messages(spark, sf):
    t = F.col("event_type")
    method = F.when(t == "error", "thing.event.post").when(t == "view", "thing.service.invoke").when(t == "signup", "thing.state.update").otherwise("thing.property.post")
    params = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("value"), F.col("value").cast("string"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("message_id"), F.col("user_id").alias("device_id"), (F.col("user_id") % 4).alias("product_id"), method.alias("method"),
        F.lit("k").alias("identifier"), params.alias("params"), (F.col("event_id") % 3).cast("string").alias("state"), F.col("ts").alias("report_time"))


def rule_table(spark):
    cond = lambda kind, ident, op, p: (kind, ident, op, p)
    rows = [
        (1, [("property", None, None, "k", ">", "90", None)], [("alert", 11), ("device", 12)]),
        (2, [("property", 8, None, "k", "between", "10, 20", []), ("event", None, 2, "k", "", "", [[cond("property", "value", ">", "100")], []])], [("alert", 21)]),
        (3, [("service", None, 1, "k", None, None, [[cond("state", None, "=", "2"), cond("property", "k", "<", "50")], [cond("property", "value", "<=", "5")]])], [("notify", 31)]),
        (4, [("state", None, None, None, "in", "0,1", [[cond("time", None, "between", "08:00:00,09:30:00")]])], [("notify", 41)]),
        (5, [("property", None, 3, "missing", "=", "1", None)], [("alert", 51)]),
    ]
    return spark.createDataFrame(rows, rules.RULES)


HITS = f"""{MSG}, h AS (SELECT DISTINCT message_id, rule_id FROM (
 SELECT message_id, 1 AS rule_id FROM m WHERE method = 'thing.property.post' AND k > 90
 UNION ALL SELECT message_id, 2 FROM m WHERE method = 'thing.property.post' AND device_id = 8 AND k BETWEEN 10 AND 20
 UNION ALL SELECT message_id, 2 FROM m WHERE method = 'thing.event.post' AND product_id = 2 AND value > 100
 UNION ALL SELECT message_id, 3 FROM m WHERE method = 'thing.service.invoke' AND product_id = 1 AND ((state = '2' AND k < 50) OR value <= 5)
 UNION ALL SELECT message_id, 4 FROM m WHERE method = 'thing.state.update' AND state IN ('0', '1') AND strftime(ts, '%H:%M:%S') BETWEEN '08:00:00' AND '09:30:00'))"""


@query("c05_match_rules", f"WITH {HITS} SELECT message_id, rule_id FROM h")
def c05(spark, sf):
    return rules.match_rules(messages(spark, sf), rule_table(spark)).select("message_id", "rule_id")


@query("l01_trigger_match", f"WITH {HITS} SELECT rule_id, count(*) AS n FROM h GROUP BY 1")
def l01(spark, sf):
    return rules.match_rules(messages(spark, sf), rule_table(spark)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("l02_conditions", f"WITH {HITS} SELECT rule_id, count(*) AS n, min(message_id) AS first FROM h GROUP BY 1")
def l02(spark, sf):
    return rules.match_rules(messages(spark, sf), rule_table(spark)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.min("message_id").alias("first"))


_MANY = """SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 5 = 0 THEN p_partkey // 5 % 50 END AS device, CASE WHEN p_partkey % 5 = 1 THEN p_partkey % 4 END AS product,
 CASE p_partkey % 4 WHEN 0 THEN '>' WHEN 1 THEN '<' WHEN 2 THEN '=' ELSE 'between' END AS op, p_partkey % 1009 / 4.0 AS x, p_size AS w FROM part"""


def many_rules(spark, sf):
    """A rule per part: thresholds, exact values and ranges on the value, for a device, a product or all."""
    k = F.col("p_partkey")
    x = (k % 1009) / 4.0
    op = F.element_at(F.array(*[F.lit(o) for o in (">", "<", "=", "between")]), (k % 4 + 1).cast("int"))
    far = F.when(op == ">", 300 + x).when(op == "<", x / 100)
    text = F.when(op == "between", F.concat_ws(", ", x.cast("string"), (x + F.col("p_size") / 1000).cast("string"))).when(op == "=", x.cast("string")).otherwise(far.cast("string"))
    trigger = F.struct(
        F.lit("property").alias("type"), F.when(k % 5 == 0, F.floor(k / 5) % 50).alias("device_id"), F.when(k % 5 == 1, k % 4).alias("product_id"), F.lit("value").alias("identifier"),
        op.alias("operator"), text.alias("value"), F.lit(None).cast("array<array<struct<type:string,identifier:string,operator:string,param:string>>>").alias("groups"))
    return table(spark, sf, "part").select(k.alias("rule_id"), F.array(trigger).alias("triggers"), F.array(F.struct(F.lit("alert").alias("kind"), k.alias("target"))).alias("actions"))


@query("c05_many_rules", f"""WITH {MSG}, r AS ({_MANY}) SELECT rule_id, count(*) AS n, min(message_id) AS first FROM r JOIN m ON m.method = 'thing.property.post'
 AND (device IS NULL OR device = device_id) AND (product IS NULL OR product = product_id)
 AND CASE op WHEN '>' THEN value > 300 + x WHEN '<' THEN value < x / 100 WHEN '=' THEN value = x ELSE value BETWEEN x AND x + w / 1000 END GROUP BY 1""")
def c05_many(spark, sf):
    m = messages(spark, sf).withColumn("identifier", F.lit("value"))
    return rules.match_rules(m, many_rules(spark, sf), first="message_id").groupBy("rule_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


@query("l03_scene_actions", f"WITH {HITS}, a AS (SELECT * FROM (VALUES (1, 'alert', 11), (1, 'device', 12), (2, 'alert', 21), (3, 'notify', 31), (4, 'notify', 41)) t(rule_id, kind, target)) SELECT message_id, rule_id, kind, target FROM h JOIN a USING (rule_id)")
def l03(spark, sf):
    r = rule_table(spark)
    return rules.scene_actions(rules.match_rules(messages(spark, sf), r), r).select("message_id", "rule_id", "kind", "target")


@query("l04_alerts", f"WITH {SIGNAL}, r AS (SELECT id, dev, us, value, min(CASE WHEN value < 10 THEN us END) OVER (PARTITION BY dev ORDER BY us, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS recovered_at FROM s) SELECT id, recovered_at, CASE WHEN recovered_at IS NULL THEN 'open' ELSE 'recovered' END AS status FROM r WHERE value > 100")
def l04(spark, sf):
    return rules.alert_records(signal(spark, sf), ["dev"], "us", "id", F.col("value") > 100, F.col("value") < 10).select("id", "recovered_at", "status")


_NOW = "1998-06-01"


def now():
    return F.lit(_NOW).cast("timestamp_ntz")


@query("l05_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 14 DAY")
def l05(spark, sf):
    return lifecycle.retain(table(spark, sf, "events"), "ts", F.lit("2024-01-25").cast("timestamp_ntz"), 14).select("event_id")


@query("l06_expire_rows", f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '{_NOW}' - INTERVAL 2 HOUR THEN 'C' WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '{_NOW}' - INTERVAL 7 DAY AND o_totalprice > 1000 THEN 'R' ELSE o_orderstatus END AS status FROM orders""")
def l06(spark, sf):
    o = table(spark, sf, "orders").withColumn("status", F.col("o_orderstatus"))
    o = lifecycle.expire_rows(o, "status", "O", "o_orderdate", now(), F.make_dt_interval(hours=F.lit(2)), "C")
    o = lifecycle.expire_rows(o, "status", "P", "o_orderdate", now(), F.make_dt_interval(F.lit(7)), "R", F.col("o_totalprice") > 1000)
    return o.select("o_orderkey", "status")


_POOL = "c AS (SELECT o_orderkey AS id, o_custkey AS owner, o_orderkey % 5 = 0 AS locked, o_orderstatus = 'F' AS dealt, o_orderdate AS owner_time, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 1 DAY * (o_orderkey % 90) END AS contact_last_time FROM orders)"


def pool(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    return o.select(k.alias("id"), F.col("o_custkey").alias("owner"), (k % 5 == 0).alias("locked"), (F.col("o_orderstatus") == "F").alias("dealt"), F.col("o_orderdate").alias("owner_time"),
                    F.when(k % 3 != 0, F.col("o_orderdate") + F.make_dt_interval((k % 90).cast("int"))).alias("contact_last_time"))


@query("l07_release_customers", f"WITH {_POOL}, t AS (SELECT *, TIMESTAMP '{_NOW}' AS now FROM c) SELECT id FROM t WHERE owner > 0 AND NOT locked AND NOT dealt AND (owner_time < now - INTERVAL 300 DAY OR (owner_time < now - INTERVAL 60 DAY AND (contact_last_time < now - INTERVAL 60 DAY OR contact_last_time IS NULL)))")
def l07(spark, sf):
    return lifecycle.release_customers(pool(spark, sf), now(), 300, 60).select("id")


@query("l07_release_reminders", f"WITH {_POOL}, t AS (SELECT *, TIMESTAMP '{_NOW}' AS now FROM c) SELECT id FROM t WHERE NOT locked AND NOT dealt AND (owner_time BETWEEN now - INTERVAL 300 DAY AND now - INTERVAL 285 DAY OR (owner_time BETWEEN now - INTERVAL 60 DAY AND now - INTERVAL 45 DAY AND (contact_last_time BETWEEN now - INTERVAL 60 DAY AND now - INTERVAL 45 DAY OR contact_last_time IS NULL)))")
def l07_remind(spark, sf):
    return lifecycle.release_reminders(pool(spark, sf), now(), 300, 60, 15).select("id")


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "price"]
LINES = "li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(l_extendedprice * 100)::BIGINT AS price, l_returnflag <> 'R' AS chosen FROM lineitem)"


def lines(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", to_cents(F.col("l_extendedprice")).alias("price"), (F.col("l_returnflag") != "R").alias("chosen"))


def _apportion_sql(ctes: str, weight: str, amount: str, name: str, chosen: str = "true") -> str:
    """``ctes`` must define li and a per-order table am(l_orderkey, amount)."""
    return f"""{ctes}, tt AS (SELECT l_orderkey, sum({weight}) AS total FROM li WHERE {chosen} GROUP BY 1),
pp AS (SELECT li.*, am.amount, row_number() OVER (PARTITION BY li.l_orderkey, {chosen} ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, price DESC) AS rk, floor(am.amount * ({weight}::DOUBLE / tt.total))::BIGINT AS part FROM li LEFT JOIN tt USING (l_orderkey) JOIN am USING (l_orderkey)),
qq AS (SELECT *, CASE WHEN NOT ({chosen}) THEN 0 WHEN rk = 1 THEN amount - coalesce(sum(CASE WHEN ({chosen}) AND rk > 1 THEN part END) OVER (PARTITION BY l_orderkey), 0) ELSE part END::BIGINT AS {name} FROM pp)"""


@query("l08_apportion", "WITH " + _apportion_sql(f"{LINES}, am AS (SELECT o_orderkey AS l_orderkey, floor(round(o_totalprice * 100) / 10)::BIGINT AS amount FROM orders)", "price", "amount", "share", "chosen") + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, share FROM qq")
def l08(spark, sf):
    amounts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.floor(to_cents(F.col("o_totalprice")) / 10).cast("long").alias("amount"))
    out = lifecycle.apportion(lines(spark, sf), "l_orderkey", ORDER, "price", amounts, "amount", "share", "chosen")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "share")


_ZONES = [(0, 10.0, 800, 5.0, 200), (1, 20.0, 1000, 10.0, 150), (2, 5.0, 500, 1.0, 90)]
_ZV = ", ".join(f"({z}, {a}, {b}, {c}, {d})" for z, a, b, c, d in _ZONES)


@query("l09_freight", "WITH " + _apportion_sql(f"{LINES}, z AS (SELECT * FROM (VALUES {_ZV}) t(zone, sc, sp, ec, ep)), s AS (SELECT l_orderkey, l_orderkey % 3 AS zone, sum(l_quantity) AS v FROM li GROUP BY 1), am AS (SELECT l_orderkey, (sp + CASE WHEN v <= sc THEN 0 ELSE ceil((v - sc) / ec) * ep END)::BIGINT AS amount FROM s JOIN z USING (zone))", "l_quantity", "amount", "freight") + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, freight FROM qq")
def l09(spark, sf):
    t = spark.createDataFrame(_ZONES, "zone long, start_count double, start_price int, extra_count double, extra_price int")
    li = lines(spark, sf).withColumn("zone", F.col("l_orderkey") % 3)
    return lifecycle.freight(li, "l_orderkey", ORDER, "l_quantity", t, "zone").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "freight")


_REWARDS = [{"limit": 5_000_000, "discount": 10_000, "points": 50}, {"limit": 20_000_000, "discount": 60_000, "points": 300}]


@query("l10_tiered_reward", "WITH " + _apportion_sql(f"{LINES}, am AS (SELECT l_orderkey, CASE WHEN sum(price) >= 20000000 THEN 60000 WHEN sum(price) >= 5000000 THEN 10000 ELSE 0 END AS amount FROM li GROUP BY 1)", "price", "amount", "reward_discount") + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, reward_discount FROM qq")
def l10(spark, sf):
    out = lifecycle.tiered_reward(lines(spark, sf), "l_orderkey", ORDER, "price", "l_quantity", _REWARDS)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "reward_discount")


@query("l10_reward_points", f"WITH {LINES}, o AS (SELECT l_orderkey, sum(l_quantity) AS v FROM li GROUP BY 1) SELECT l_orderkey, CASE WHEN v >= 200 THEN 300 WHEN v >= 100 THEN 50 ELSE 0 END AS points FROM o")
def l10_points(spark, sf):
    tiers = [{"limit": 100, "points": 50}, {"limit": 200, "points": 300}]
    out = lifecycle.tiered_reward(lines(spark, sf), "l_orderkey", ORDER, "price", "l_quantity", tiers, on="count")
    return out.groupBy("l_orderkey").agg(F.sum("reward_points").alias("points"))


@query("l11_line_brokerage", f"WITH {LINES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 4 = 0 THEN 500 WHEN l_suppkey % 6 > 0 THEN price * (l_suppkey % 6) // 100 ELSE 0 END AS brokerage FROM li")
def l11(spark, sf):
    fixed = F.when(F.col("l_linenumber") % 4 == 0, 500)
    return lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", lifecycle.line_brokerage(F.col("price"), F.col("l_suppkey") % 6, fixed).alias("brokerage"))


@query("l13_balance_moves", "WITH a AS (SELECT c_custkey, round(c_acctbal * 100)::BIGINT AS frozen FROM customer), m AS (SELECT o_custkey, sum(floor(o_totalprice / 50))::BIGINT AS v FROM orders GROUP BY 1) SELECT c_custkey, frozen >= coalesce(v, 0) AS accepted, CASE WHEN frozen >= coalesce(v, 0) THEN frozen - coalesce(v, 0) ELSE frozen END AS frozen, CASE WHEN frozen >= coalesce(v, 0) THEN coalesce(v, 0) ELSE 0 END AS available FROM a LEFT JOIN m ON o_custkey = c_custkey")
def l13(spark, sf):
    a = table(spark, sf, "customer").select("c_custkey", to_cents(F.col("c_acctbal")).alias("frozen"), F.lit(0).cast("long").alias("available"))
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.floor(F.col("o_totalprice") / 50).alias("amount"))
    return lifecycle.move_balance(a, m, "c_custkey", "frozen", "available", "amount").select("c_custkey", "accepted", "frozen", "available")


@query("k13_offline_devices", "SELECT user_id AS device_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_report FROM events WHERE user_id % 5 <> 0 GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 900 MINUTE")
def k13(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("device_id"), F.col("ts").alias("report_time"))
    devices = e.select("device_id").distinct().withColumn("online", F.col("device_id") % 5 != 0)
    out = rules.offline_devices(devices, e, "device_id", F.lit("2024-01-31").cast("timestamp_ntz"), 36000, 1.5)
    return out.select("device_id", F.date_format("report_time", "yyyy-MM-dd HH:mm:ss").alias("last_report"))


# ---- plug-in points -------------------------------------------------------------------------


def _half_step() -> Scan:
    return Scan(AffineMaps(1), lambda c: ((0 * c["value"] + 0.5)[:, None, None], (0.5 * c["value"])[:, None]), lambda c: c["value"][:, None], lambda prev, cur, c: {"filtered": cur[:, 0]})


@query("m01_filter_plugin", f"""WITH RECURSIVE {SIGNAL}, n AS (SELECT *, row_number() OVER (PARTITION BY dev ORDER BY us, id) - 1 AS i FROM s),
f AS (SELECT dev, i, id, value AS y FROM n WHERE i = 0 UNION ALL SELECT n.dev, n.i, n.id, 0.5 * f.y + 0.5 * n.value FROM f JOIN n ON n.dev = f.dev AND n.i = f.i + 1) SELECT id, round(y + 1.3e-8, 6) AS filtered FROM f""")
def m01(spark, sf):
    filters.register_filter("half_step", _half_step)
    return filters.apply_filter(signal(spark, sf), "HALF_STEP", ["dev"], ["us", "id"]).select("id", rnd(F.col("filtered") + 1.3e-8).alias("filtered"))


@query("m02_burst_function", f"WITH {FRAGMENTS}, b AS (SELECT frag, max(abs(v)) AS a FROM x GROUP BY 1), t AS (SELECT x.frag, i, v, a, abs(v) >= a * 0.25 AS above FROM x JOIN b USING (frag)), u AS (SELECT *, above AND NOT coalesce(lag(above) OVER (PARTITION BY frag ORDER BY i), false) AS edge FROM t) SELECT frag, round(max(a), 6) AS amplitude, round(sum(v * v), 6) AS energy, count(*) FILTER (WHERE edge) AS counts FROM u GROUP BY frag")
def m02(spark, sf):
    udf.register_all(spark)
    fragments(spark, sf).createOrReplaceTempView("m02_fragments")
    out = spark.sql("SELECT frag, burst_summary(samples) AS b FROM m02_fragments")
    return out.select("frag", rnd("b.amplitude").alias("amplitude"), rnd("b.energy").alias("energy"), F.col("b.counts").alias("counts"))


@query("m03_samples_table_function", f"WITH {FRAGMENTS} SELECT frag, i AS sample_index, 1000 + i * 500 AS ts_ns, round(v, 9) + 0.0 AS voltage FROM x")
def m03(spark, sf):
    udf.register_all(spark)
    fragments(spark, sf).createOrReplaceTempView("m03_fragments")
    out = spark.sql("SELECT f.frag, s.* FROM m03_fragments f, LATERAL explode_samples(1000L, 2e6D, f.samples) s")
    return out.select("frag", "sample_index", "ts_ns", rnd("voltage", 9).alias("voltage"))


@query("m04_matcher_plugin", f"WITH {MSG} SELECT message_id FROM m WHERE method = 'thing.service.invoke' AND value > 150")
def m04(spark, sf):
    rules.register_trigger("loud_service", lambda t: F.col("params")["value"].try_cast("double") > t["value"].try_cast("double"), 50, "thing.service.invoke")
    r = spark.createDataFrame([(9, [("loud_service", None, None, None, None, "150", None)], [("alert", 1)])], rules.RULES)
    return rules.match_rules(messages(spark, sf), r).select("message_id")


@query("m05_row_permission", "SELECT c_custkey FROM customer WHERE c_nationkey < 5 OR c_acctbal > 9000")
def m05(spark, sf):
    udf.register_permission("customer", lambda: (F.col("c_nationkey") < 5) | (F.col("c_acctbal") > 9000))
    return udf.read_table(spark, sf, "customer").select("c_custkey")
