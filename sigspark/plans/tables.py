"""Predicates, joins, generic aggregates, ordering, set operations and functions on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.functions import dates, masks, money, shapes
from sigspark.operators import aggregates, joins, ordering, predicates, setops
from sigspark.operators.series import positions
from sigspark.plans.registry import FRAGMENTS, SIGNAL, fragments, query, rnd, signal, table

# ---- B: predicates --------------------------------------------------------------------------


@query("b01_where_if_present", """SELECT c_custkey FROM customer WHERE c_acctbal >= 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name LIKE '%1%'""")
def b01(spark, sf):
    spec = [("c_acctbal", "between", (1000, None)), ("c_mktsegment", "in", ["BUILDING", "MACHINERY"]), ("c_name", "like", "1"),
            ("c_nationkey", "eq", None), ("c_nationkey", "in", []), ("c_custkey", "between", None)]
    return predicates.where_if_present(table(spark, sf, "customer"), spec).select("c_custkey")


@query("b01_where_like_text", "SELECT doc_id FROM documents WHERE contains(text, 'the') AND lang <> 'fr'")
def b01_like(spark, sf):
    return predicates.where_if_present(table(spark, sf, "documents"), [("text", "like", "the"), ("lang", "ne", "fr")]).select("doc_id")


@query("b02_find_in_set", "SELECT s_suppkey FROM supplier WHERE list_contains(string_split((s_nationkey % 5)::VARCHAR || ',' || s_nationkey::VARCHAR || ',7', ','), (s_suppkey % 25)::VARCHAR)")
def b02(spark, sf):
    cell = F.concat_ws(",", (F.col("s_nationkey") % 5).cast("string"), F.col("s_nationkey").cast("string"), F.lit("7"))
    return table(spark, sf, "supplier").filter(predicates.find_in_set(F.col("s_suppkey") % 25, cell)).select("s_suppkey")


@query("b03_rule_operators", f"""WITH {SIGNAL}, k AS (SELECT event_id AS id, event_type AS ch, json_extract_string(props, '$.k') AS k FROM events)
SELECT id, k = '50' AS eq, k <> '50' AS ne, k::DOUBLE > 50 AS gt, k::DOUBLE <= 50 AS le, k IN ('1', '2', '3') AS in_list, k NOT IN ('1', '2', '3') AS not_in_list,
 k::DOUBLE BETWEEN 10 AND 20 AS between_both, NOT (k::DOUBLE BETWEEN 10 AND 20) AS not_between, contains(k, '9') AS like_text, ch > 'error' AS text_order FROM k""")
def b03(spark, sf):
    df = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("ch"), F.get_json_object("props", "$.k").alias("k"))
    k = F.col("k")
    tests = {"eq": ("=", "50"), "ne": ("!=", "50"), "gt": (">", "50"), "le": ("<=", "50"), "in_list": ("in", "1, 2, 3"), "not_in_list": ("not in", "1, 2, 3"),
             "between_both": ("between", "10,20"), "not_between": ("not between", "10,20"), "like_text": ("like", "9")}
    cols = [predicates.rule_op(o, k, F.lit(p)).alias(a) for a, (o, p) in tests.items()]
    return df.select("id", *cols, predicates.rule_op(">", F.col("ch"), F.lit("error")).alias("text_order"))


@query("b04_time_operators", """SELECT event_id AS id, epoch(ts)::BIGINT > 1705000000 AS after_moment, floor(epoch(ts)) BETWEEN 1705000000 AND 1706000000 AS between_moments,
 strftime(ts, '%H:%M:%S') < '08:30:00' AS before_half_eight, strftime(ts, '%H:%M:%S') BETWEEN '08:30:00' AND '17:00:00' AS in_shift FROM events""".replace("epoch(ts)::BIGINT >", "floor(epoch(ts)) >"))
def b04(spark, sf):
    df = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("t"))
    t = F.col("t")
    return df.select("id", predicates.time_op("date_time_>", t, "1705000000").alias("after_moment"),
                     predicates.time_op("date_time_between", t, "1705000000,1706000000").alias("between_moments"),
                     predicates.time_op("time_<", t, "08:30").alias("before_half_eight"), predicates.time_op("time_between", t, "08:30,17:00:00").alias("in_shift"))


@query("b05_match_groups", "SELECT event_id AS id, (value > 100 AND event_type = 'error') OR value < 5 AS static_match, (value > 50 AND value > 80) OR value > 200 AS data_match FROM events")
def b05(spark, sf):
    df = table(spark, sf, "events")
    v = F.col("value")
    groups = F.array(F.array(F.struct(F.lit(50.0).alias("t")), F.struct(F.lit(80.0).alias("t"))), F.array().cast("array<struct<t:double>>"), F.array(F.struct(F.lit(200.0).alias("t"))))
    return df.select(F.col("event_id").alias("id"), predicates.match_static([[v > 100, F.col("event_type") == "error"], [], [v < 5]]).alias("static_match"),
                     predicates.match_dnf(groups, lambda c: v > c["t"]).alias("data_match"))


@query("b06_tenant_filter", "SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 3")
def b06(spark, sf):
    return predicates.tenant_filter(table(spark, sf, "orders").withColumn("tenant_id", F.col("o_custkey") % 7), 3).select("o_orderkey")


@query("b07_data_scope", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3) OR c_custkey = 10")
def b07(spark, sf):
    return predicates.data_scope_filter(table(spark, sf, "customer"), {"depts": [1, 2, 3], "self": 10}, "c_nationkey", "c_custkey").select("c_custkey")


@query("b08_not_deleted", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag <> 'R'")
def b08(spark, sf):
    return predicates.not_deleted(table(spark, sf, "lineitem").withColumn("deleted", F.col("l_returnflag") == "R")).agg(F.count(F.lit(1)).alias("n"))


@query("b09_contact_backlog", """WITH c AS (SELECT o_orderkey AS k, o_orderdate AS nxt, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate - INTERVAL 1 DAY * (o_orderkey % 5 - 2) END AS last FROM orders)
SELECT k, 'today' AS kind FROM c WHERE nxt >= DATE '1998-05-05' AND nxt < DATE '1998-05-06' UNION ALL SELECT k, 'overdue' FROM c WHERE nxt < DATE '1998-05-05' AND (last IS NULL OR last < nxt)
UNION ALL SELECT k, 'done' FROM c WHERE last >= DATE '1998-05-05' AND last < DATE '1998-05-06'""")
def b09(spark, sf):
    o = table(spark, sf, "orders")
    last = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") - F.make_dt_interval((F.col("o_orderkey") % 5 - 2).cast("int")))
    c = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("contact_next_time"), last.alias("contact_last_time"))
    kinds = [predicates.contact_backlog(c, k, "1998-05-05").select("k", F.lit(k).alias("kind")) for k in ("today", "overdue", "done")]
    return setops.union_all(kinds)


@query("b10_select_prefixed", "SELECT n_nationkey AS t_n_nationkey, n_name AS nation, n_regionkey AS t_n_regionkey, n_nationkey < (SELECT count(*) FROM region) AS under FROM nation")
def b10(spark, sf):
    n = table(spark, sf, "nation")
    table(spark, sf, "region").createOrReplaceTempView("b10_region")
    return predicates.select_prefixed(n, "t_", nation="n_name").withColumn("under", F.expr("t_n_nationkey < (SELECT count(*) FROM b10_region)"))


@query("b11_dispatch_shard", "SELECT event_id, (event_id % 4)::INT AS partition_id, 4 AS num_partitions FROM events")
def b11(spark, sf):
    return predicates.dispatch_shard(table(spark, sf, "events"), "event_id", 4).select("event_id", "partition_id", "num_partitions")


# ---- C: joins -------------------------------------------------------------------------------


@query("c01_equi_joins", """SELECT 'inner' AS how, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'left', count(*), round(sum(o_totalprice), 2) FROM customer LEFT JOIN orders ON o_custkey = c_custkey UNION ALL SELECT 'right', count(*), round(sum(o_totalprice), 2) FROM orders RIGHT JOIN customer ON o_custkey = c_custkey""")
def c01(spark, sf):
    o, c = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k"), table(spark, sf, "customer").withColumnRenamed("c_custkey", "k")
    agg = lambda d, h: d.agg(F.lit(h).alias("how"), F.count(F.lit(1)).alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total"))
    return setops.union_all([agg(joins.join_on(o, c, ["k"], "inner"), "inner"), agg(joins.join_on(c, o, ["k"], "left"), "left"), agg(joins.join_on(o, c, ["k"], "right"), "right")])


@query("c02_enrich", """SELECT o_orderkey, c_name, n_name, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'part' END AS status
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def c02(spark, sf):
    o = joins.enrich(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer"), "c_custkey", c_name="c_name", c_nationkey="c_nationkey")
    o = joins.enrich(o, "c_nationkey", table(spark, sf, "nation"), "n_nationkey", n_name="n_name")
    labels = spark.createDataFrame([("O", "open"), ("F", "filled"), ("P", "part")], "code string, label string")
    return joins.enrich(o, "o_orderstatus", labels, "code", status="label").select("o_orderkey", "c_name", "n_name", "status")


def area_tree(spark, sf):
    """World -> region -> nation -> customer as one parent-pointer table."""
    root = spark.createDataFrame([("w", None, "world")], "id string, parent_id string, type string")
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("w").alias("parent_id"), F.lit("region").alias("type"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.lit("nation").alias("type"))
    return root.unionByName(r).unionByName(n)


AREA = """tree AS (SELECT 'w' AS id, NULL AS parent_id, 'world' AS type UNION ALL SELECT 'r' || r_regionkey, 'w', 'region' FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nation' FROM nation)"""


@query("c03_descendants", f"WITH RECURSIVE {AREA}, d AS (SELECT id FROM tree WHERE parent_id = 'w' UNION ALL SELECT t.id FROM tree t JOIN d ON t.parent_id = d.id) SELECT id FROM d")
def c03(spark, sf):
    return joins.descendants(area_tree(spark, sf), "w")


@query("c03_closure", f"WITH RECURSIVE {AREA}, d AS (SELECT id AS descendant, id AS ancestor, parent_id AS up, 0 AS depth FROM tree UNION ALL SELECT d.descendant, t.id, t.parent_id, d.depth + 1 FROM d JOIN tree t ON t.id = d.up) SELECT descendant, ancestor, depth FROM d")
def c03_closure(spark, sf):
    return joins.closure(area_tree(spark, sf), "id", "parent_id").select("descendant", "ancestor", "depth")


@query("c04_ancestor_of_type", "SELECT c_custkey, CASE WHEN c_nationkey % 9 = 8 THEN 'unknown' ELSE 'r' || n_regionkey END AS area FROM customer JOIN nation ON n_nationkey = c_nationkey")
def c04(spark, sf):
    c = table(spark, sf, "customer").withColumn("node", F.when(F.col("c_nationkey") % 9 != 8, F.concat(F.lit("n"), "c_nationkey")))
    out = joins.ancestor_of_type(c, "node", area_tree(spark, sf), "region")
    return out.select("c_custkey", F.coalesce("ancestor_id", F.lit("unknown")).alias("area"))


@query("c06_bucket_join", """WITH r AS (SELECT unnest(range(DATE '1996-01-01', DATE '1997-01-01', INTERVAL 7 DAY)) AS d), w AS (SELECT greatest(date_trunc('week', d), DATE '1996-01-01')::TIMESTAMP AS s FROM r UNION SELECT date_trunc('week', DATE '1996-12-31')::TIMESTAMP),
o AS (SELECT greatest(date_trunc('week', o_orderdate), TIMESTAMP '1996-01-01') AS s, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01' GROUP BY 1)
SELECT strftime(w.s, '%Y-%m-%d') AS week, coalesce(n, 0) AS n, coalesce(amount, 0) + 0.0 AS amount FROM w LEFT JOIN o ON o.s = w.s""")
def c06(spark, sf):
    o = table(spark, sf, "orders").filter((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1997-01-01"))
    ranges = dates.spine(spark, "1996-01-01", "1996-12-31", "week")
    out = joins.bucket_join(o, ranges, "o_orderdate", "week", "1996-01-01", n=F.count(F.lit(1)), amount=F.sum("o_totalprice"))
    return out.select(F.date_format("range_start", "yyyy-MM-dd").alias("week"), "n", rnd("amount", 2).alias("amount"))


_TIERS = [(0.0, "bronze"), (2500.0, "silver"), (5000.0, "gold"), (8000.0, "platinum")]


@query("c07_tier_match", "SELECT c_custkey, CASE WHEN c_acctbal >= 8000 THEN 'platinum' WHEN c_acctbal >= 5000 THEN 'gold' WHEN c_acctbal >= 2500 THEN 'silver' WHEN c_acctbal >= 0 THEN 'bronze' END AS tier FROM customer")
def c07(spark, sf):
    tiers = spark.createDataFrame(_TIERS, "least double, name string")
    return joins.tier_match(table(spark, sf, "customer"), "c_acctbal", tiers, "least", "name").select("c_custkey", "tier")


@query("c07_tier_match_large", "SELECT o_orderkey, (SELECT arg_max(p_partkey, p_retailprice) FROM part) IS NOT NULL AS known, t.m AS tier_price FROM orders ASOF LEFT JOIN (SELECT DISTINCT p_retailprice AS m FROM part) t ON o_totalprice / 100 >= t.m")
def c07_large(spark, sf):
    tiers = table(spark, sf, "part").select(F.col("p_retailprice").alias("t"), F.col("p_retailprice").cast("string").alias("l")).distinct()
    o = table(spark, sf, "orders").withColumn("v", F.col("o_totalprice") / 100)
    out = joins.tier_match(o, "v", tiers, "t", "l")
    return out.select("o_orderkey", F.lit(True).alias("known"), F.col("tier").cast("double").alias("tier_price"))


_SLOTS = """i AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS s, o_orderdate + INTERVAL 1 DAY * (1 + o_orderkey % 30) AS e FROM orders)"""


def slots(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("s"),
                    (F.col("o_orderdate") + F.make_dt_interval((1 + F.col("o_orderkey") % 30).cast("int"))).alias("e"))


@query("c08_conflicts", f"WITH {_SLOTS} SELECT a.k, EXISTS (SELECT 1 FROM i b WHERE b.c = a.c AND b.k <> a.k AND b.s < a.e AND a.s < b.e) AS conflict FROM i a")
def c08(spark, sf):
    return joins.conflicts(slots(spark, sf), ["c"], "s", "e", "k").select("k", "conflict")


@query("c08_overlap_count", f"WITH {_SLOTS}, v AS (SELECT l_suppkey * 15 AS c, l_shipdate AS s, l_shipdate + INTERVAL 5 DAY AS e FROM lineitem) SELECT a.k, count(v.c) AS overlaps FROM i a LEFT JOIN v ON v.c = a.c AND v.s < a.e AND a.s < v.e GROUP BY a.k")
def c08_count(spark, sf):
    visits = table(spark, sf, "lineitem").select((F.col("l_suppkey") * 15).alias("c"), F.col("l_shipdate").alias("s"), (F.col("l_shipdate") + F.make_dt_interval(F.lit(5))).alias("e"))
    return joins.overlap_count(slots(spark, sf), visits, ["c"], "s", "e", "k").select("k", "overlaps")


@query("c09_compare_periods", """WITH d AS (SELECT o_orderdate AS day, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1)
SELECT strftime(a.day, '%Y-%m-%d') AS day, a.n, a.amount, coalesce(b.n, 0) AS previous_n, coalesce(b.amount, 0) + 0.0 AS previous_amount FROM d a LEFT JOIN d b ON b.day = a.day - INTERVAL 30 DAY AND b.day >= '1997-05-02'
WHERE a.day >= '1997-06-01' AND a.day < '1997-07-01'""")
def c09(spark, sf):
    daily = table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("o_totalprice"), 2).alias("amount"))
    span = lambda a, b: daily.filter((F.col("day") >= a) & (F.col("day") < b))
    out = joins.compare_periods(span("1997-06-01", "1997-07-01"), span("1997-05-02", "1997-06-01"), "day", 30, ["n", "amount"])
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("c10_diff_tables", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'create' WHEN b.k IS NULL THEN 'delete' ELSE 'update' END AS change FROM
(SELECT c_custkey AS k, c_mktsegment AS m FROM customer WHERE c_custkey % 10 <> 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'NONE' ELSE c_mktsegment END AS m FROM customer WHERE c_custkey % 10 <> 1) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.m <> b.m""")
def c10(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("m"), "c_acctbal")
    new = c.filter("k % 10 <> 1").withColumn("m", F.when(F.col("c_acctbal") < 0, "NONE").otherwise(F.col("m")))
    return joins.diff_tables(c.filter("k % 10 <> 0"), new, "k", ["m"])


@query("c11_membership", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS has_part FROM customer")
def c11(spark, sf):
    c, ids = table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    inside = joins.in_ids(c, ids, "c_custkey", "o_custkey").select("c_custkey", F.lit(True).alias("has_part"))
    return inside.unionByName(joins.not_in_ids(c, ids, "c_custkey", "o_custkey").select("c_custkey", F.lit(False).alias("has_part")))


@query("c12_pair_channels", f"""WITH {SIGNAL}, n AS (SELECT dev, ch, value, row_number() OVER (PARTITION BY dev, ch ORDER BY us, id) - 1 AS i FROM s)
SELECT a.dev, a.i, a.value AS click, b.value AS error FROM n a JOIN n b ON a.dev = b.dev AND a.i = b.i AND a.ch = 'click' AND b.ch = 'error'""")
def c12(spark, sf):
    placed = positions(signal(spark, sf), ["dev", "ch"], ["us", "id"], "i")
    return joins.pair_channels(placed, ["dev", "i"], "ch", "value", ["click", "error"])


@query("c13_vector_topk", f"""WITH {FRAGMENTS}, c AS (SELECT e.label AS query_id, x.i, avg(x.v) AS q FROM x JOIN e ON e.frag = x.frag GROUP BY 1, 2),
d AS (SELECT c.query_id, x.frag AS segment_id, sum(q * v) / sqrt(sum(q * q)) / sqrt(sum(v * v)) AS score FROM c JOIN x ON x.i = c.i JOIN e ON e.frag = x.frag AND e.label <> c.query_id GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS place FROM d WHERE score >= 0.0) SELECT query_id, segment_id, place, round(score, 6) AS score FROM k WHERE place <= 5""".replace("AND e.label <> c.query_id ", ""))
def c13(spark, sf):
    seg = fragments(spark, sf)
    means = seg.select("label", F.posexplode("samples").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    q = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vector")).select(F.col("label").cast("long").alias("query_id"), "vector")
    out = joins.vector_topk(q, seg.select(F.col("frag").alias("segment_id"), F.col("samples").alias("vector")), 5, 0.0)
    return out.select("query_id", "segment_id", "place", rnd("score").alias("score"))


@query("c13_vector_topk_filtered", f"""WITH {FRAGMENTS}, c AS (SELECT e.label AS query_id, x.i, avg(x.v) AS q FROM x JOIN e ON e.frag = x.frag GROUP BY 1, 2),
d AS (SELECT c.query_id, x.frag AS segment_id, sum(q * v) / sqrt(sum(q * q)) / sqrt(sum(v * v)) AS score FROM c JOIN e ON e.label = c.query_id JOIN x ON x.i = c.i AND x.frag = e.frag GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS place FROM d) SELECT query_id, segment_id, place, round(score, 6) AS score FROM k WHERE place <= 3""")
def c13_filtered(spark, sf):
    seg = fragments(spark, sf)
    means = seg.select("label", F.posexplode("samples").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    q = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vector"))
    q = q.select(F.col("label").cast("long").alias("query_id"), "label", "vector")
    out = joins.vector_topk(q, seg.select(F.col("frag").alias("segment_id"), "label", F.col("samples").alias("vector")), 3, -1.0, "label", factor=2)
    return out.select("query_id", "segment_id", "place", rnd("score").alias("score"))


@query("c13_second_pass", f"""WITH {FRAGMENTS}, c AS (SELECT e.label AS query_id, x.i, avg(x.v) AS q FROM x JOIN e ON e.frag = x.frag GROUP BY 1, 2),
d AS (SELECT c.query_id, x.frag AS segment_id, sum(q * v) / sqrt(sum(q * q)) / sqrt(sum(v * v)) AS score FROM c JOIN x ON x.i = c.i GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS place FROM d), r AS (SELECT query_id, segment_id, score - 0.1 * (segment_id % 7) AS score FROM k WHERE place <= 20),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS place FROM r) SELECT query_id, segment_id, place, round(score, 6) AS score FROM p WHERE place <= 5""")
def c13_second(spark, sf):
    """Four times as many candidates as asked for, scored again by another measure."""
    seg = fragments(spark, sf)
    means = seg.select("label", F.posexplode("samples").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    q = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vector")).select(F.col("label").cast("long").alias("query_id"), "vector")
    again = lambda found: found.withColumn("score", F.col("score") - 0.1 * (F.col("segment_id") % 7))
    out = joins.vector_topk(q, seg.select(F.col("frag").alias("segment_id"), F.col("samples").alias("vector")), 5, -1.0, factor=4, second=again)
    return out.select("query_id", "segment_id", "place", rnd("score").alias("score"))


# ---- D1-D8: generic aggregates --------------------------------------------------------------


@query("d01_named_aggregates", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, max(c_acctbal) AS high, min(c_acctbal) AS low, round(avg(c_acctbal), 4) AS mean, sum(length(c_name))::BIGINT AS letters FROM customer GROUP BY 1")
def d01(spark, sf):
    out = aggregates.named(table(spark, sf, "customer"), ["c_mktsegment"], n=("count", "c_custkey"), total=("sum", "c_acctbal"), high=("max", "c_acctbal"),
                           low=("min", "c_acctbal"), mean=("avg", "c_acctbal"), letters=("length", "c_name"))
    return out.withColumn("total", rnd("total", 2)).withColumn("mean", rnd("mean", 4))


@query("d02_distinct_count", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def d02(spark, sf):
    return aggregates.distinct_count(table(spark, sf, "lineitem"), ["l_suppkey"], parts="l_partkey", orders="l_orderkey")


@query("d03_conditional_count", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1")
def d03(spark, sf):
    return aggregates.count_where(table(spark, sf, "lineitem"), ["l_suppkey"], returned=F.col("l_returnflag") == "R", discounted=F.col("l_discount") > 0.05)


@query("d04_having", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING sum(o_totalprice) >= 3000000")
def d04(spark, sf):
    return aggregates.having_sum(table(spark, sf, "orders"), ["o_custkey"], "o_totalprice", 3000000).withColumn("total", rnd("total", 2))


@query("d04_having_users", "SELECT count(*) AS users FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) >= 3000000)")
def d04_users(spark, sf):
    return aggregates.having_sum(table(spark, sf, "orders"), ["o_custkey"], "o_totalprice", 3000000).agg(F.count(F.lit(1)).alias("users"))


@query("d05_population_stats", f"WITH {SIGNAL} SELECT ch, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 5) AS std, min(value) AS low, max(value) AS high, round(sqrt(avg(value * value)), 5) AS rms FROM s GROUP BY ch")
def d05(spark, sf):
    out = aggregates.population_stats(signal(spark, sf), ["ch"])
    return out.select("ch", "n", rnd("mean").alias("mean"), rnd("variance", 4).alias("variance"), rnd("std", 5).alias("std"), "low", "high", rnd("rms", 5).alias("rms"))


def _percentile_sql(p: float) -> str:
    return f"""WITH {SIGNAL}, c AS (SELECT dev, list_sort(list(value)) AS l, count(*) AS n, {p} * (count(*) + 1) / 100 AS pos FROM s GROUP BY dev)
SELECT dev, round(CASE WHEN pos < 1 THEN l[1] WHEN pos >= n THEN l[n] ELSE l[floor(pos)::INT] + (pos - floor(pos)) * (l[floor(pos)::INT + 1] - l[floor(pos)::INT]) END + 1.3e-8, 6) AS percentile FROM c"""


@query("d06_percentile_95", _percentile_sql(95.0))
def d06(spark, sf):
    return aggregates.exact_percentile(signal(spark, sf), ["dev"], "value", 95.0, ["id"]).select("dev", rnd(F.col("percentile") + 1.3e-8).alias("percentile"))


@query("d06_percentile_99", _percentile_sql(99.0))
def d06_99(spark, sf):
    return aggregates.exact_percentile(signal(spark, sf), ["dev"], "value", 99.0, ["id"]).select("dev", rnd(F.col("percentile") + 1.3e-8).alias("percentile"))


@query("d07_multi_map", f"WITH {SIGNAL}, n AS (SELECT dev, id, (row_number() OVER (PARTITION BY dev ORDER BY us, id) - 1) // 50 AS page, us FROM s) SELECT dev, page, string_agg(id::VARCHAR, ',' ORDER BY us, id) AS ids FROM n GROUP BY dev, page")
def d07(spark, sf):
    out = aggregates.multi_map(signal(spark, sf), ["dev"], "id", ["us", "id"], page=50)
    return out.select("dev", "page", shapes.join_cell(F.col("values")).alias("ids"))


@query("d07_merge_map", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def d07_merge(spark, sf):
    return aggregates.merge_map(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("d08_window_totals", """SELECT strftime(time_bucket(INTERVAL 10 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, count(*) FILTER (WHERE value > 100) AS anomalies, count(*) FILTER (WHERE value > 100) * 100.0 / count(*) AS rate FROM events GROUP BY 1, 2""")
def d08(spark, sf):
    out = aggregates.window_totals(table(spark, sf, "events"), "ts", "10 seconds", "event_type", F.col("value") > 100)
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).withColumn("rate", F.col("rate").cast("double"))


# ---- H, I: ordering and sets ----------------------------------------------------------------


@query("h01_order_by", "SELECT p_partkey, p_brand FROM part")
def h01(spark, sf):
    return ordering.order_by(table(spark, sf, "part").select("p_partkey", "p_brand"), [("p_brand", "asc"), ("p_partkey", "desc")])


@query("h02_page", "SELECT p_partkey, (SELECT count(*) FROM part) AS total FROM (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40)")
def h02(spark, sf):
    rows, total = ordering.page(table(spark, sf, "part"), 3, 20, [("p_retailprice", "desc"), ("p_partkey", "asc")])
    return rows.select("p_partkey", F.lit(total).alias("total"))


@query("h03_first_rows", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def h03(spark, sf):
    return ordering.first_rows(table(spark, sf, "orders"), 10, [("o_totalprice", "desc"), ("o_orderkey", "asc")]).select("o_orderkey")


@query("h03_first_per_key", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def h03_key(spark, sf):
    return ordering.first_per_key(table(spark, sf, "orders"), ["o_custkey"], 2, [("o_totalprice", "desc"), ("o_orderkey", "asc")]).select("o_custkey", "o_orderkey")


@query("h04_merge_series", """WITH a AS (SELECT user_id, ts, event_id, value, event_type AS src FROM events) SELECT user_id, event_id, value, arg_min(src, (ts, event_id)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS src FROM a""".replace("arg_min(src, (ts, event_id)) OVER", "first_value(src) OVER"))
def h04(spark, sf):
    e = table(spark, sf, "events")
    click = F.col("event_type").eqNullSafe("click")
    parts = [e.filter(t).select("user_id", "ts", "event_id", "value", F.col("event_type").alias("src")) for t in (click, ~click)]
    return ordering.merge_series(parts, ["user_id"], ["ts", "event_id"], ["src"]).select("user_id", "event_id", "value", "src")


@query("i01_union", "SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def i01(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"))
    return setops.union_all([c, table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))])


@query("i02_distinct_by", "SELECT l_partkey, arg_max(l_suppkey, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS l_suppkey FROM lineitem GROUP BY 1")
def i02(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return setops.distinct_by(li, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]).select("l_partkey", "l_suppkey")


@query("i02_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def i02_distinct(spark, sf):
    return setops.distinct_rows(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus"))


@query("i03_contains_any", "SELECT doc_id, list_has_any(string_split(text, ' '), ['the', 'of']) AS hit FROM documents")
def i03(spark, sf):
    words = F.array(F.lit("the"), F.lit("of"))
    return table(spark, sf, "documents").select("doc_id", setops.contains_any(F.split("text", " ", -1), words).alias("hit"))


@query("i04_difference", "SELECT l_suppkey, l_partkey FROM lineitem WHERE l_discount < 0.05 EXCEPT ALL SELECT l_suppkey, l_partkey FROM lineitem WHERE l_tax < 0.04")
def i04(spark, sf):
    li = table(spark, sf, "lineitem")
    return setops.difference(li.filter("l_discount < 0.05").select("l_suppkey", "l_partkey"), li.filter("l_tax < 0.04").select("l_suppkey", "l_partkey"))


# ---- J: functions ---------------------------------------------------------------------------

_F6 = "'%Y-%m-%d %H:%M:%S.%f'"


@query("j01_calendar", f"""SELECT event_id, strftime(date_trunc('day', ts), {_F6}) AS day_start, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND, {_F6}) AS month_end,
 strftime(date_trunc('year', ts) + INTERVAL 1 YEAR - INTERVAL 1 MICROSECOND, {_F6}) AS year_end, quarter(ts) AS quarter, date_diff('day', DATE '2024-01-01', ts::DATE) AS days FROM events""")
def j01(spark, sf):
    t, f = F.col("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return table(spark, sf, "events").select(
        "event_id", F.date_format(dates.begin_of("day", t), f).alias("day_start"), F.date_format(dates.end_of("month", t), f).alias("month_end"),
        F.date_format(dates.end_of("year", t), f).alias("year_end"), F.quarter(t).alias("quarter"), F.datediff(t, F.lit("2024-01-01").cast("date")).alias("days"))


_SPAN = "p AS (SELECT o_orderpriority AS k, date_trunc('day', min(o_orderdate)) AS a, max(o_orderdate) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS b FROM orders GROUP BY 1)"


def _ranges_sql(unit: str, step: str) -> str:
    return f"""WITH {_SPAN}, g AS (SELECT k, a, b, unnest(range(date_trunc('{unit}', a), b, INTERVAL {step})) AS s FROM p)
SELECT k, strftime(greatest(s, a), {_F6}) AS range_start, strftime(least(s + INTERVAL {step} - INTERVAL 1 MICROSECOND, b), {_F6}) AS range_end FROM g"""


def _ranges(unit: str):
    def run(spark, sf):
        p = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
        f = "yyyy-MM-dd HH:mm:ss.SSSSSS"
        return dates.date_ranges(p, "a", "b", unit).select("k", F.date_format("range_start", f).alias("range_start"), F.date_format("range_end", f).alias("range_end"))

    return run


for _unit, _step in (("hour", "1 HOUR"), ("day", "1 DAY"), ("week", "7 DAY"), ("month", "1 MONTH"), ("quarter", "3 MONTH"), ("year", "1 YEAR")):
    query(f"j02_ranges_{_unit}", _ranges_sql(_unit, _step))(_ranges(_unit))


@query("j03_format_range", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS hour, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d') || ' (week ' || weekofyear(o_orderdate) || ')' AS week,
 strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, strftime(o_orderdate, '%Y') AS year FROM orders""")
def j03(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *[dates.format_range(F.col("o_orderdate"), u).alias(u) for u in dates.UNITS])


@query("j04_between_overlap", f"WITH {_SLOTS} SELECT k, s BETWEEN '1997-01-01' AND '1997-12-31' AS inside, s < '1997-03-01' AND e > '1997-02-01' AS touches FROM i")
def j04(spark, sf):
    d = lambda x: F.lit(x).cast("timestamp_ntz")
    return slots(spark, sf).select("k", dates.between(F.col("s"), d("1997-01-01"), d("1997-12-31")).alias("inside"), dates.overlaps(F.col("s"), F.col("e"), d("1997-02-01"), d("1997-03-01")).alias("touches"))


def _mask_sql(c: str, p: int, s: int) -> str:
    return f"CASE WHEN length({c}) - {p + s} <= 0 THEN repeat('*', length({c})) ELSE left({c}, {p}) || repeat('*', length({c}) - {p + s}) || right({c}, {s}) END"


@query("j05_slider_mask", f"SELECT c_custkey, {_mask_sql('c_name', 3, 5)} AS name, {_mask_sql('c_mktsegment', 6, 6)} AS segment FROM customer")
def j05(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", masks.slider(F.col("c_name"), 3, 5).alias("name"), masks.slider(F.col("c_mktsegment"), 6, 6).alias("segment"))


@query("j06_mask_presets", "SELECT page_id, " + ", ".join(f"{_mask_sql('url', p, s)} AS {k}" for k, (p, s) in masks.KEPT.items()) + " FROM pages")
def j06(spark, sf):
    return table(spark, sf, "pages").select("page_id", *[masks.preset(F.col("url"), k).alias(k) for k in masks.KEPT])


@query("j07_mask_email", "SELECT doc_id, regexp_replace(w, '(^.)[^@]*(@.*$)', '\\1****\\2') AS masked FROM (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS w FROM documents) WHERE contains(w, '@')")
def j07(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("w")).filter(F.col("w").contains("@"))
    return w.select("doc_id", masks.email(F.col("w")).alias("masked"))


_CENTS = "round(l_extendedprice * 100)::BIGINT"


@query("j08_money", f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CENTS} AS c, round(l_discount * 100)::BIGINT AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (c * p + 50) // 100 AS half_up, c * p // 100 AS floored, c * 3 * 85 // 100 AS total, (c // 100)::VARCHAR || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS yuan FROM m""")
def j08(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("c", money.to_cents(F.col("l_extendedprice"))).withColumn("p", money.to_cents(F.col("l_discount")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money.rate_price(F.col("c"), F.col("p")).alias("half_up"), money.rate_price_floor(F.col("c"), F.col("p")).alias("floored"),
                     money.total(F.col("c"), F.lit(3), F.lit(85)).alias("total"), money.to_yuan_text(F.col("c")).alias("yuan"))


@query("j09_cents_text", "SELECT o_orderkey, printf('%.2f', o_totalprice) AS yuan FROM orders")
def j09(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", money.to_yuan_text(money.to_cents(F.col("o_totalprice"))).alias("yuan"))


@query("j10_rename", "SELECT c_custkey AS cCustkey, c_mktsegment AS cMktsegment FROM customer")
def j10(spark, sf):
    return shapes.rename_all(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), shapes.to_camel)


@query("j11_list_cells", "WITH l AS (SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS cell FROM lineitem GROUP BY 1) SELECT l_orderkey, cell, len(string_split(cell, ',')) AS n, list_contains(string_split(cell, ','), '5') AS has_five FROM l")
def j11(spark, sf):
    packed = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    cell = packed.select("l_orderkey", shapes.join_cell(F.transform("l", lambda x: x["l_linenumber"])).alias("cell"))
    return cell.select("l_orderkey", "cell", F.size(shapes.list_cell(F.col("cell"), "int")).alias("n"), shapes.in_list_cell(F.lit(5), F.col("cell")).alias("has_five"))


@query("j12_json", """SELECT event_id, json_extract_string(props, '$.k')::INT AS k, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS packed FROM events""")
def j12(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("packed"))


@query("j13_properties", """SELECT event_id, 'k' AS identifier, json_extract_string(props, '$.k')::DOUBLE AS number FROM events WHERE event_type IN ('click', 'error')
UNION ALL SELECT event_id, 'v', trunc(value) FROM events WHERE event_type = 'click'""".replace("trunc(value)", "value"))
def j13(spark, sf):
    e = table(spark, sf, "events")
    params = F.to_json(F.map_from_arrays(F.array(F.lit("k"), F.lit("v"), F.lit("spare")), F.array(F.get_json_object("props", "$.k"), F.col("value").cast("string"), F.lit("x"))))
    things = spark.createDataFrame([("click", "k", "int"), ("click", "v", "double"), ("error", "k", "int")], "event_type string, identifier string, data_type string")
    out = shapes.properties(e.select("event_id", "event_type", params.alias("params")), "params", F.broadcast(things), ["event_type"])
    return out.select("event_id", "identifier", "number")


@query("j14_schema_diff", """WITH o AS (SELECT p_brand AS name, min(p_type) AS type, min(p_size) AS length FROM part WHERE p_partkey % 3 <> 0 AND p_brand <> 'Brand#1' GROUP BY 1), n AS (SELECT p_brand AS name, min(p_type) AS type, max(p_size) AS length FROM part WHERE p_brand <> 'Brand#2' GROUP BY 1)
SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'add' WHEN n.name IS NULL THEN 'drop' WHEN o.type <> n.type THEN 'retype' ELSE 'lengthen' END AS change FROM o FULL JOIN n ON o.name = n.name WHERE o.name IS NULL OR n.name IS NULL OR o.type <> n.type OR n.length > o.length""")
def j14(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_brand", "name")
    old = p.filter("p_partkey % 3 <> 0 AND name <> 'Brand#1'").groupBy("name").agg(F.min("p_type").alias("type"), F.min("p_size").alias("length"))
    new = p.filter("name <> 'Brand#2'").groupBy("name").agg(F.min("p_type").alias("type"), F.max("p_size").alias("length"))
    return shapes.schema_diff(old, new)


@query("j15_array_ops", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings)
SELECT vec_id, round(list_dot_product(a, list_reverse(a)), 6) + 0.0 AS dot, round(list_sum(list_transform(range(2, 65), lambda i: abs(a[i] - a[i - 1]))), 6) AS step_sum, round(list_max(list_transform(range(1, 61), lambda i: list_avg(a[i : i + 4]))), 6) + 0.0 AS top_mean FROM e""")
def j15(spark, sf):
    from sigspark.operators import features as fx

    a = F.col("samples")
    return fragments(spark, sf).select(
        F.col("frag").alias("vec_id"), rnd(shapes.dot(a, F.reverse(a))).alias("dot"), rnd(fx.total(fx.diffs(a), F.abs)).alias("step_sum"),
        rnd(F.array_max(shapes.array_moving_average(a, 5))).alias("top_mean"))


@query("j16_split_text", r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range((len(w) + 99) // 100)) AS piece FROM w)
SELECT doc_id, piece, len(w[piece * 100 + 1 : piece * 100 + 100]) AS tokens, length(array_to_string(w[piece * 100 + 1 : piece * 100 + 100], ' ')) AS content_length, md5(array_to_string(w[piece * 100 + 1 : piece * 100 + 100], ' ')) AS digest FROM p""")
def j16(spark, sf):
    out = shapes.split_text(table(spark, sf, "documents").select("doc_id", "text"), "text", 100)
    return out.select("doc_id", "piece", "tokens", "content_length", F.md5("content").alias("digest"))


@query("j17_maths", "SELECT event_id, round(sin(value), 6) + 0.0 AS sine, round(cos(value), 6) + 0.0 AS cosine, round(exp(-value / 100), 6) AS decay, round(log10(value), 6) + 0.0 AS log, round(pow(value, 1.5), 4) AS power, round(sqrt(value), 6) AS root, sign(value - 50)::INT AS side FROM events")
def j17(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", rnd(F.sin(v)).alias("sine"), rnd(F.cos(v)).alias("cosine"), rnd(F.exp(-v / 100)).alias("decay"), rnd(F.log10(v)).alias("log"),
                                             rnd(F.pow(v, F.lit(1.5)), 4).alias("power"), rnd(F.sqrt(v)).alias("root"), F.signum(v - 50).cast("int").alias("side"))
