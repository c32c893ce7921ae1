"""Shop, CRM, ERP and device statistics with the star schema as the business tables.

Shop orders are ``orders`` (cents, pay time = order date + key mod 3 days, paid = not 'O'), after-sales
are returned ``lineitem`` rows, owners are nations, departments are regions, contracts are orders,
receivables are line items, follow-ups and visits are ``events``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.functions.money import to_cents
from sigspark.operators import aggregates, business as biz
from sigspark.operators.joins import enrich
from sigspark.plans.registry import query, rnd, table
from sigspark.plans.tables import area_tree

_DAY = "yyyy-MM-dd"


def shop(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("delivery_type"),
        F.col("o_orderdate").alias("create_time"), (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 3).cast("int"))).alias("pay_time"),
        (F.col("o_orderstatus") != "O").alias("paid"), to_cents(F.col("o_totalprice")).alias("price"))


SHOP = """t AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS status, o_orderpriority AS delivery_type, o_orderdate AS create_time, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 3) AS pay_time,
 o_orderstatus <> 'O' AS paid, round(o_totalprice * 100)::BIGINT AS price FROM orders)"""


def refunds(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    return li.select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("time"), F.col("l_linestatus").alias("status"), to_cents(F.col("l_extendedprice")).alias("price"))


REFUNDS = "r AS (SELECT l_orderkey AS order_id, l_shipdate AS time, l_linestatus AS status, round(l_extendedprice * 100)::BIGINT AS price FROM lineitem WHERE l_returnflag = 'R')"


def brokerage(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("user_id"), F.col("l_shipdate").alias("time"), F.col("l_linestatus").alias("status"), F.floor(to_cents(F.col("l_extendedprice")) * F.round(F.col("l_discount") * 100) / 100).cast("long").alias("price"))


BROKERAGE = "b AS (SELECT l_suppkey AS user_id, l_shipdate AS time, l_linestatus AS status, round(l_extendedprice * 100)::BIGINT * round(l_discount * 100)::BIGINT // 100 AS price FROM lineitem)"


@query("d10_order_totals", f"WITH {SHOP} SELECT count(*) AS created, count(*) FILTER (WHERE paid) AS paid, sum(price) FILTER (WHERE paid)::BIGINT AS amount FROM t WHERE create_time >= '1997-01-01' AND create_time < '1997-07-01'")
def d10(spark, sf):
    return biz.period_totals(shop(spark, sf), "create_time", "1997-01-01", "1997-07-01", created=F.count(F.lit(1)), paid=F.count(F.when(F.col("paid"), 1)), amount=F.sum(F.when(F.col("paid"), F.col("price"))))


@query("d11_distinct_buyers", f"WITH {SHOP} SELECT count(DISTINCT user_id) AS created, count(DISTINCT user_id) FILTER (WHERE paid) AS paid FROM t WHERE create_time >= '1997-01-01' AND create_time < '1997-03-01'")
def d11(spark, sf):
    return biz.period_totals(shop(spark, sf), "create_time", "1997-01-01", "1997-03-01", created=F.countDistinct("user_id"), paid=F.countDistinct(F.when(F.col("paid"), F.col("user_id"))))


def _trend_sql(unit: str, a: str, b: str) -> str:
    return f"""WITH {SHOP}, g AS (SELECT DISTINCT greatest(date_trunc('{unit}', d), TIMESTAMP '{a}') AS s FROM (SELECT unnest(range(TIMESTAMP '{a}', TIMESTAMP '{b}' + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d)),
f AS (SELECT greatest(date_trunc('{unit}', create_time), TIMESTAMP '{a}') AS s, count(*) AS n, sum(price)::BIGINT AS amount FROM t WHERE create_time >= '{a}' AND create_time < TIMESTAMP '{b}' + INTERVAL 1 DAY GROUP BY 1)
SELECT strftime(g.s, '%Y-%m-%d') AS day, coalesce(n, 0) AS n, coalesce(amount, 0)::BIGINT AS amount FROM g LEFT JOIN f ON f.s = g.s"""


def _trend(unit: str, a: str, b: str):
    def run(spark, sf):
        out = biz.trend(shop(spark, sf), "create_time", a, b, unit, n=F.count(F.lit(1)), amount=F.sum("price"))
        return out.select(F.date_format("range_start", _DAY).alias("day"), "n", "amount")

    return run


query("d12_order_trend_day", _trend_sql("day", "1997-03-01", "1997-04-15"))(_trend("day", "1997-03-01", "1997-04-15"))
query("d12_order_trend_month", _trend_sql("month", "1997-01-01", "1998-12-31"))(_trend("month", "1997-01-01", "1998-12-31"))


@query("d13_orders_by_area", "SELECT 'r' || n_regionkey AS area, count(*) AS orders, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS amount FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey <> 7 GROUP BY 1 UNION ALL SELECT 'unknown', count(*), sum(round(o_totalprice * 100)::BIGINT)::BIGINT FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7")
def d13(spark, sf):
    o = shop(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey"), "user_id")
    o = o.withColumn("node", F.when(F.col("c_nationkey") != 7, F.concat(F.lit("n"), "c_nationkey")))
    return biz.by_area(o, "node", area_tree(spark, sf), "region", orders=F.count(F.lit(1)), amount=F.sum("price"))


@query("d14_status_by_delivery", f"WITH {SHOP} SELECT status, delivery_type, count(*) AS n FROM t GROUP BY 1, 2")
def d14(spark, sf):
    return biz.counts_by(shop(spark, sf), ["status", "delivery_type"])


@query("d14_refund_status", f"WITH {SHOP}, {REFUNDS}, x AS (SELECT id, count(order_id) AS k FROM t LEFT JOIN r ON r.order_id = t.id GROUP BY id) SELECT CASE WHEN k = 0 THEN 'none' WHEN k = 1 THEN 'part' ELSE 'many' END AS refund_status, count(*) AS n FROM x GROUP BY 1")
def d14_refund(spark, sf):
    per = refunds(spark, sf).groupBy("order_id").agg(F.count(F.lit(1)).alias("k"))
    o = shop(spark, sf).join(per, F.col("id") == F.col("order_id"), "left")
    return biz.counts_by(o.withColumn("refund_status", F.when(F.col("k").isNull(), "none").when(F.col("k") == 1, "part").otherwise("many")), ["refund_status"])


@query("d15_today_and_yesterday", f"WITH {SHOP} SELECT count(*) FILTER (WHERE pay_time >= '1997-05-06' AND pay_time < '1997-05-07') AS orders, count(*) FILTER (WHERE pay_time >= '1997-05-05' AND pay_time < '1997-05-06') AS reference_orders, coalesce(sum(price) FILTER (WHERE pay_time >= '1997-05-06' AND pay_time < '1997-05-07'), 0)::BIGINT AS amount, coalesce(sum(price) FILTER (WHERE pay_time >= '1997-05-05' AND pay_time < '1997-05-06'), 0)::BIGINT AS reference_amount FROM t WHERE paid")
def d15(spark, sf):
    return biz.two_periods(shop(spark, sf), "pay_time", ("1997-05-06", "1997-05-07"), ("1997-05-05", "1997-05-06"), {"orders": F.lit(1), "amount": F.col("price")}, F.col("paid"))


@query("d16_daily_facts", f"""WITH {SHOP}, {REFUNDS}, {BROKERAGE},
u AS (SELECT create_time AS day, 1 AS created, 0 AS paid, 0 AS amount, 0 AS refunds, 0 AS refund_price, 0 AS settled FROM t UNION ALL SELECT pay_time, 0, 1, price, 0, 0, 0 FROM t WHERE paid
 UNION ALL SELECT time, 0, 0, 0, 1, price, 0 FROM r UNION ALL SELECT time, 0, 0, 0, 0, 0, price FROM b WHERE status = 'F')
SELECT strftime(date_trunc('day', day), '%Y-%m-%d') AS day, sum(created)::BIGINT AS created, sum(paid)::BIGINT AS paid, sum(amount)::BIGINT AS amount, sum(refunds)::BIGINT AS refunds, sum(refund_price)::BIGINT AS refund_price, sum(settled)::BIGINT AS settled FROM u
WHERE day NOT BETWEEN '1997-01-01' AND '1997-01-10' GROUP BY 1""")
def d16(spark, sf):
    t = shop(spark, sf)
    done = spark.range(10).select((F.lit("1997-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("day"))
    out = biz.daily_facts({
        "created": (t, "create_time", {"created": F.count(F.lit(1))}), "paid": (t.filter("paid"), "pay_time", {"paid": F.count(F.lit(1)), "amount": F.sum("price")}),
        "refunds": (refunds(spark, sf), "time", {"refunds": F.count(F.lit(1)), "refund_price": F.sum("price")}),
        "brokerage": (brokerage(spark, sf).filter("status = 'F'"), "time", {"settled": F.sum("price")}),
    }, done)
    return out.withColumn("day", F.date_format("day", _DAY))


@query("d17_period_analysis", f"WITH {SHOP} SELECT coalesce(sum(price) FILTER (WHERE pay_time >= '1997-06-01'), 0)::BIGINT AS amount, coalesce(sum(price) FILTER (WHERE pay_time < '1997-06-01'), 0)::BIGINT AS reference_amount, count(*) FILTER (WHERE pay_time >= '1997-06-01') AS orders, count(*) FILTER (WHERE pay_time < '1997-06-01') AS reference_orders FROM t WHERE paid AND pay_time >= '1997-05-02' AND pay_time < '1997-07-01'")
def d17(spark, sf):
    return biz.two_periods(shop(spark, sf), "pay_time", ("1997-06-01", "1997-07-01"), ("1997-05-02", "1997-06-01"), {"amount": F.col("price"), "orders": F.lit(1)}, F.col("paid"))


@query("d18_after_sale", f"WITH {REFUNDS} SELECT status, count(*) AS n, sum(price)::BIGINT AS refund_price FROM r GROUP BY 1")
def d18(spark, sf):
    return biz.counts_by(refunds(spark, sf), ["status"], refund_price=F.sum("price"))


@query("d19_brokerage_settlement", f"WITH {BROKERAGE} SELECT sum(price) FILTER (WHERE status = 'F')::BIGINT AS settled, count(*) FILTER (WHERE status = 'O') AS open FROM b WHERE time >= '1997-01-01' AND time < '1998-01-01'")
def d19(spark, sf):
    return biz.period_totals(brokerage(spark, sf), "time", "1997-01-01", "1998-01-01", settled=F.sum(F.when(F.col("status") == "F", F.col("price"))), open=F.count(F.when(F.col("status") == "O", 1)))


@query("d20_wallet_summary", f"WITH {SHOP}, {REFUNDS} SELECT (SELECT sum(price)::BIGINT FROM t WHERE paid AND delivery_type = '1-URGENT') AS recharge, (SELECT sum(price)::BIGINT FROM r) AS refund, (SELECT sum(price)::BIGINT FROM t WHERE paid AND delivery_type <> '1-URGENT') AS payment")
def d20(spark, sf):
    t, urgent = shop(spark, sf).filter("paid"), F.col("delivery_type") == "1-URGENT"
    parts = [
        t.agg(F.lit(1).alias("k"), F.sum(F.when(urgent, F.col("price"))).alias("recharge"), F.sum(F.when(~urgent, F.col("price"))).alias("payment")),
        refunds(spark, sf).agg(F.lit(1).alias("k"), F.sum("price").alias("refund")),
    ]
    return biz.merge_owners("k", parts).select("recharge", "refund", "payment")


def visits(spark, sf):
    """Events as product visits: product = event id mod 200."""
    return table(spark, sf, "events").select((F.col("event_id") % 200).alias("product"), F.col("user_id"), F.date_trunc("month", "ts").alias("month"))


def sales(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_partkey") % 200).alias("product"), (F.col("l_orderkey") % 40).alias("user_id"), (F.col("l_linestatus") == "F").alias("paid"), to_cents(F.col("l_extendedprice")).alias("price"), F.col("l_shipdate").alias("time"), "l_quantity")


_PRODUCT = """v AS (SELECT event_id % 200 AS product, count(*) AS browse_count, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1),
s AS (SELECT l_partkey % 200 AS product, count(*) AS order_count, count(*) FILTER (WHERE l_linestatus = 'F') AS paid_count, count(DISTINCT l_orderkey % 40) FILTER (WHERE l_linestatus = 'F') AS buyers, sum(round(l_extendedprice * 100)::BIGINT) FILTER (WHERE l_linestatus = 'F')::BIGINT AS paid_price FROM lineitem GROUP BY 1),
p AS (SELECT coalesce(v.product, s.product) AS product, coalesce(browse_count, 0) AS browse_count, coalesce(visitors, 0) AS visitors, coalesce(order_count, 0) AS order_count, coalesce(paid_count, 0) AS paid_count, coalesce(buyers, 0) AS buyers, coalesce(paid_price, 0)::BIGINT AS paid_price FROM v FULL JOIN s ON v.product = s.product),
q AS (SELECT *, CASE WHEN visitors = 0 THEN 0 ELSE buyers * 100 // visitors END AS convert_percent FROM p)"""


@query("d21_product_daily", f"WITH {_PRODUCT} SELECT * FROM q")
def d21(spark, sf):
    return biz.product_daily(visits(spark, sf), sales(spark, sf), ["product"])


@query("d22_product_ranking", f"WITH {_PRODUCT} SELECT product % 50 AS grp, sum(browse_count)::BIGINT AS browse_count, sum(visitors)::BIGINT AS visitors, sum(order_count)::BIGINT AS order_count, sum(paid_count)::BIGINT AS paid_count, sum(paid_price)::BIGINT AS paid_price, round(avg(convert_percent), 4) AS convert_percent FROM q GROUP BY 1 ORDER BY browse_count DESC, grp LIMIT 10")
def d22(spark, sf):
    daily = biz.product_daily(visits(spark, sf), sales(spark, sf), ["product"]).withColumn("grp", F.col("product") % 50)
    out = biz.ranking(daily, "grp", 10, "browse_count", ["browse_count", "visitors", "order_count", "paid_count", "paid_price"], ["convert_percent"])
    return out.withColumn("convert_percent", rnd("convert_percent", 4))


@query("d23_product_trend", "SELECT strftime(date_trunc('day', l_shipdate), '%Y-%m-%d') AS day, count(*) AS n, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS amount FROM lineitem WHERE l_shipdate >= '1997-02-01' AND l_shipdate < '1997-03-01' GROUP BY 1")
def d23(spark, sf):
    out = biz.trend(sales(spark, sf), "time", "1997-02-01", "1997-02-28", "day", n=F.count(F.lit(1)), amount=F.sum("price"))
    return out.filter("n > 0").select(F.date_format("range_start", _DAY).alias("day"), "n", "amount")


@query("d24_members_by_group", "SELECT 'segment' AS kind, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'sex', (c_custkey % 3)::VARCHAR, count(*) FROM customer GROUP BY 2 UNION ALL SELECT 'area', 'r' || n_regionkey, count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 2")
def d24(spark, sf):
    c = table(spark, sf, "customer").withColumn("node", F.concat(F.lit("n"), "c_nationkey")).withColumn("sex", (F.col("c_custkey") % 3).cast("string"))
    area = biz.by_area(c, "node", area_tree(spark, sf), "region", n=F.count(F.lit(1))).select(F.lit("area").alias("kind"), F.col("area").alias("value"), "n")
    grouped = [biz.counts_by(c, [k]).select(F.lit(n).alias("kind"), F.col(k).alias("value"), "n") for n, k in (("segment", "c_mktsegment"), ("sex", "sex"))]
    return area.unionByName(grouped[0]).unionByName(grouped[1])


_FIRST = "f AS (SELECT o_custkey, min(o_orderdate) AS joined FROM orders GROUP BY 1)"


@query("d24_registrations_per_day", f"WITH {_FIRST} SELECT strftime(joined, '%Y-%m-%d') AS day, count(*) AS n FROM f WHERE joined >= '1995-02-01' AND joined < '1995-04-01' GROUP BY 1")
def d24_days(spark, sf):
    f = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("joined"))
    out = biz.trend(f, "joined", "1995-02-01", "1995-03-31", "day", n=F.count(F.lit(1))).filter("n > 0")
    return out.select(F.date_format("range_start", _DAY).alias("day"), "n")


@query("d25_distinct_visitors", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT json_extract_string(props, '$.k')) AS addresses FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-08'")
def d25(spark, sf):
    return biz.period_totals(table(spark, sf, "events"), "ts", "2024-01-05", "2024-01-08", users=F.countDistinct("user_id"), addresses=F.countDistinct(F.get_json_object("props", "$.k")))


@query("d26_brokerage_rank", f"WITH {BROKERAGE} SELECT user_id, count(*) AS n, sum(price)::BIGINT AS price FROM b WHERE status = 'F' GROUP BY 1 ORDER BY price DESC, user_id LIMIT 20")
def d26(spark, sf):
    b = brokerage(spark, sf).filter("status = 'F'").withColumn("n", F.lit(1))
    return biz.ranking(b, "user_id", 20, "price", ["n", "price"])


@query("d26_invited_users", "SELECT c_nationkey AS inviter, count(*) AS invited FROM customer WHERE c_acctbal > 0 GROUP BY 1 ORDER BY invited DESC, inviter LIMIT 10")
def d26_invited(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("inviter"), F.lit(1).alias("invited"))
    return biz.ranking(c, "inviter", 10, "invited", ["invited"])


@query("d27_withdrawals", f"WITH {BROKERAGE} SELECT user_id, status, count(*) AS n, sum(price)::BIGINT AS price FROM b GROUP BY 1, 2")
def d27(spark, sf):
    return biz.counts_by(brokerage(spark, sf), ["user_id", "status"], price=F.sum("price"))


@query("d28_coupons_taken", "SELECT o_orderpriority AS template, o_custkey AS user_id, count(*) AS n FROM orders GROUP BY 1, 2")
def d28(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("template"), F.col("o_custkey").alias("user_id"))
    return biz.counts_by(o, ["template", "user_id"])


@query("d29_participants", "SELECT l_partkey AS activity, count(DISTINCT l_suppkey) AS helpers, count(DISTINCT l_orderkey) AS records FROM lineitem GROUP BY 1")
def d29(spark, sf):
    return aggregates.distinct_count(table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "activity"), ["activity"], helpers="l_suppkey", records="l_orderkey")


# ---- CRM ------------------------------------------------------------------------------------

USERS = "JOIN nation ON n_nationkey = owner JOIN region ON r_regionkey = n_regionkey"


def people(spark, sf):
    users = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("dept_id"))
    return users, table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))


def contracts(spark, sf):
    owners = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("owner"))
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("time"), F.col("o_orderstatus").alias("status"), to_cents(F.col("o_totalprice")).alias("price"))
    return o.join(owners, "customer_id")


CONTRACTS = "k AS (SELECT o_orderkey AS id, o_custkey AS customer_id, c_nationkey AS owner, o_orderdate AS time, o_orderstatus AS status, round(o_totalprice * 100)::BIGINT AS price FROM orders JOIN customer ON c_custkey = o_custkey)"


def received(spark, sf):
    """Receivables, aggregated per contract before they meet the contract's owner."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("contract_id"), F.col("l_shipdate").alias("time"), to_cents(F.col("l_extendedprice")).alias("price"), F.col("l_partkey").alias("product"), F.col("l_quantity").alias("quantity"))


RECEIVED = "v AS (SELECT l_orderkey AS contract_id, l_shipdate AS time, round(l_extendedprice * 100)::BIGINT AS price, l_partkey AS product, l_quantity AS quantity FROM lineitem)"
FOLLOWS = "w AS (SELECT e.event_id AS id, e.user_id AS customer_id, c_nationkey AS owner, e.ts AS time, e.event_type AS type FROM events e JOIN customer ON c_custkey = e.user_id)"


def follows(spark, sf):
    owners = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("owner"))
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("customer_id"), F.col("ts").alias("time"), F.col("event_type").alias("type"))
    return e.join(owners, "customer_id")


def _rank(name: str, ctes: str, source: str, measure_sql: str, frame, measure):
    @query(f"d30_rank_{name}", f"WITH {ctes}, g AS (SELECT owner, {measure_sql} AS measure FROM {source} GROUP BY owner) SELECT owner, measure, n_name AS nickname, r_name AS dept_name FROM g {USERS}")
    def run(spark, sf):
        users, depts = people(spark, sf)
        return biz.owner_rank(frame(spark, sf), "owner", measure(), users, "id", depts, "id")


def _received_by_owner(spark, sf):
    per = received(spark, sf).groupBy("contract_id").agg(F.sum("price").alias("price"), F.sum("quantity").alias("quantity"))
    return per.join(contracts(spark, sf).select(F.col("id").alias("contract_id"), "owner"), "contract_id")


def _customers(spark, sf):
    return table(spark, sf, "customer").withColumnRenamed("c_nationkey", "owner")


_VK = f"{CONTRACTS}, {RECEIVED}, vk AS (SELECT owner, v.price, v.quantity FROM v JOIN k ON k.id = v.contract_id)"
_rank("contract_price", CONTRACTS, "k", "sum(price)::BIGINT", contracts, lambda: F.sum("price"))
_rank("receivable_price", _VK, "vk", "sum(price)::BIGINT", _received_by_owner, lambda: F.sum("price"))
_rank("contract_count", CONTRACTS, "k", "count(*)", contracts, lambda: F.count(F.lit(1)))
_rank("product_sales", _VK, "vk", "sum(quantity)", _received_by_owner, lambda: F.sum("quantity"))
_rank("customers", "c AS (SELECT c_nationkey AS owner FROM customer)", "c", "count(*)", _customers, lambda: F.count(F.lit(1)))
_rank("contacts", "c AS (SELECT c_nationkey AS owner, c_mktsegment AS m FROM customer)", "c", "count(DISTINCT m)", _customers, lambda: F.countDistinct("c_mktsegment"))
_rank("follow_ups", FOLLOWS, "w", "count(*)", follows, lambda: F.count(F.lit(1)))
_rank("followed_customers", FOLLOWS, "w", "count(DISTINCT customer_id)", follows, lambda: F.countDistinct("customer_id"))


def _performance(name: str, ctes: str, source: str, measure_sql: str, frame, measure):
    @query(f"d31_performance_{name}", f"""WITH {ctes}, m AS (SELECT date_trunc('month', time) AS m, {measure_sql} AS v FROM {source} GROUP BY 1), s AS (SELECT unnest(range(TIMESTAMP '1997-01-01', TIMESTAMP '1998-01-01', INTERVAL 1 MONTH)) AS m)
SELECT strftime(s.m, '%Y-%m') AS month, coalesce(a.v, 0)::BIGINT AS this_month, coalesce(b.v, 0)::BIGINT AS last_month, coalesce(c.v, 0)::BIGINT AS last_year FROM s LEFT JOIN m a ON a.m = s.m LEFT JOIN m b ON b.m = s.m - INTERVAL 1 MONTH LEFT JOIN m c ON c.m = s.m - INTERVAL 1 YEAR""")
    def run(spark, sf):
        out = biz.performance(frame(spark, sf), "time", measure(), 1997)
        return out.select(F.date_format("range_start", "yyyy-MM").alias("month"), "this_month", "last_month", "last_year")


_performance("contract_count", CONTRACTS, "k", "count(*)", contracts, lambda: F.count(F.lit(1)))
_performance("contract_price", CONTRACTS, "k", "sum(price)::BIGINT", contracts, lambda: F.sum("price"))
_performance("receivable", RECEIVED, "v", "sum(price)::BIGINT", received, lambda: F.sum("price"))


@query("d32_funnel", f"WITH {CONTRACTS} SELECT 0 AS step, 'customers' AS stage, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 1, 'opportunities', (SELECT count(*) FROM k) UNION ALL SELECT 2, 'wins', (SELECT count(*) FROM k WHERE status = 'F')")
def d32(spark, sf):
    o = table(spark, sf, "orders")
    return biz.funnel({"customers": table(spark, sf, "customer"), "opportunities": o, "wins": o.filter("o_orderstatus = 'F'")})


@query("d33_opportunities_by_status", f"WITH {CONTRACTS} SELECT status, count(*) AS n, sum(price)::BIGINT AS price FROM k GROUP BY 1")
def d33(spark, sf):
    return biz.counts_by(contracts(spark, sf), ["status"], price=F.sum("price"))


@query("d33_opportunities_by_range", f"""WITH {CONTRACTS}, g AS (SELECT unnest(range(TIMESTAMP '1997-01-01', TIMESTAMP '1998-01-01', INTERVAL 3 MONTH)) AS q)
SELECT strftime(q, '%Y-%m-%d') AS range, count(id) AS n, count(id) FILTER (WHERE status = 'F') AS wins, coalesce(sum(price), 0)::BIGINT AS price FROM g LEFT JOIN k ON date_trunc('quarter', time) = q GROUP BY 1""")
def d33_range(spark, sf):
    out = biz.trend(contracts(spark, sf), "time", "1997-01-01", "1997-12-31", "quarter", n=F.count(F.lit(1)), wins=F.count(F.when(F.col("status") == "F", 1)), price=F.sum("price"))
    return out.select(F.date_format("range_start", _DAY).alias("range"), "n", "wins", "price")


def _deals(spark, sf):
    won = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("deal", F.lit(1))
    return table(spark, sf, "customer").join(won, "c_custkey", "left").withColumn("deal", F.coalesce("deal", F.lit(0)))


_DEALS = "c AS (SELECT *, (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))::INT AS deal FROM customer)"


@query("d34_portrait_area", f"WITH {_DEALS} SELECT 'r' || n_regionkey AS area, count(*) AS customers, sum(deal)::BIGINT AS deals FROM c JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def d34_area(spark, sf):
    c = _deals(spark, sf).withColumn("node", F.concat(F.lit("n"), "c_nationkey"))
    return biz.by_area(c, "node", area_tree(spark, sf), "region", customers=F.count(F.lit(1)), deals=F.sum("deal"))


_PORTRAITS = {"industry": ("c_mktsegment", lambda: F.col("c_mktsegment")), "source": ("c_custkey % 4", lambda: F.col("c_custkey") % 4), "level": ("floor(c_acctbal / 2500)::INT", lambda: F.floor(F.col("c_acctbal") / 2500).cast("int"))}
for _name, (_sql, _col) in _PORTRAITS.items():
    def _portrait(spark, sf, name=_name, col=_col):
        return biz.counts_by(_deals(spark, sf).withColumn(name, col()), [name], deals=F.sum("deal"))

    query(f"d34_portrait_{_name}", f"WITH {_DEALS} SELECT {_sql} AS {_name}, count(*) AS n, sum(deal)::BIGINT AS deals FROM c GROUP BY 1")(_portrait)

_LIFE = "l AS (SELECT o_custkey AS customer_id, c_nationkey AS owner, min(o_orderdate) - INTERVAL 1 DAY * (o_custkey % 60) AS created, min(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS deal FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, c_nationkey)"


def life(spark, sf):
    first = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(F.min("o_orderdate").alias("__f"), F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("deal"))
    first = first.withColumn("created", F.col("__f") - F.make_dt_interval((F.col("customer_id") % 60).cast("int"))).drop("__f")
    return first.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("owner")), "customer_id")


@query("d35_customers_by_range", f"WITH {_LIFE}, g AS (SELECT unnest(range(TIMESTAMP '1995-01-01', TIMESTAMP '1996-01-01', INTERVAL 1 MONTH)) AS m) SELECT strftime(m, '%Y-%m') AS month, (SELECT count(*) FROM l WHERE date_trunc('month', created) = m) AS created, (SELECT count(*) FROM l WHERE date_trunc('month', deal) = m) AS deals FROM g")
def d35(spark, sf):
    l = life(spark, sf)
    made = biz.trend(l, "created", "1995-01-01", "1995-12-31", "month", created=F.count(F.lit(1))).select("range_start", "created")
    done = biz.trend(l, "deal", "1995-01-01", "1995-12-31", "month", deals=F.count(F.lit(1))).select("range_start", "deals")
    return made.join(done, "range_start").select(F.date_format("range_start", "yyyy-MM").alias("month"), "created", "deals")


@query("d35_customers_by_owner", f"WITH {_LIFE}, {_VK} SELECT n_nationkey AS owner, (SELECT count(*) FROM l WHERE owner = n_nationkey) AS created, (SELECT count(*) FROM l WHERE owner = n_nationkey AND deal IS NOT NULL) AS deals, coalesce((SELECT sum(price) FROM k WHERE owner = n_nationkey), 0)::BIGINT AS contract_price, coalesce((SELECT sum(price) FROM vk WHERE owner = n_nationkey), 0)::BIGINT AS receivable_price FROM nation")
def d35_owner(spark, sf):
    l = life(spark, sf)
    return biz.merge_owners("owner", [
        l.groupBy("owner").agg(F.count(F.lit(1)).alias("created"), F.count("deal").alias("deals")),
        contracts(spark, sf).groupBy("owner").agg(F.sum("price").alias("contract_price")), _received_by_owner(spark, sf).groupBy("owner").agg(F.sum("price").alias("receivable_price")),
        table(spark, sf, "nation").select(F.col("n_nationkey").alias("owner")),
    ])


@query("d36_follow_ups_by_day", f"WITH {FOLLOWS} SELECT strftime(time, '%Y-%m-%d') AS day, count(*) AS follow_ups, count(DISTINCT customer_id) AS customers FROM w GROUP BY 1")
def d36(spark, sf):
    out = biz.trend(follows(spark, sf), "time", "2024-01-01", "2024-01-31", "day", follow_ups=F.count(F.lit(1)), customers=F.countDistinct("customer_id"))
    return out.filter("follow_ups > 0").select(F.date_format("range_start", _DAY).alias("day"), "follow_ups", "customers")


@query("d36_follow_ups_by_owner", f"WITH {FOLLOWS} SELECT owner, count(*) AS n, count(DISTINCT customer_id) AS customers FROM w GROUP BY 1")
def d36_owner(spark, sf):
    return biz.counts_by(follows(spark, sf), ["owner"], customers=F.countDistinct("customer_id"))


@query("d36_follow_ups_by_type", f"WITH {FOLLOWS} SELECT type, count(*) AS n FROM w GROUP BY 1")
def d36_type(spark, sf):
    return biz.counts_by(follows(spark, sf), ["type"])


@query("d37_contract_summary", f"WITH {CONTRACTS}, {RECEIVED}, g AS (SELECT contract_id, sum(price)::BIGINT AS received FROM v GROUP BY 1) SELECT k.id, c_name, k.owner, k.price, coalesce(received, 0)::BIGINT AS received FROM k JOIN customer ON c_custkey = customer_id LEFT JOIN g ON g.contract_id = k.id WHERE status = 'F'")
def d37(spark, sf):
    per = received(spark, sf).groupBy(F.col("contract_id").alias("id")).agg(F.sum("price").alias("received"))
    k = contracts(spark, sf).filter("status = 'F'").join(per, "id", "left").fillna(0, ["received"])
    return enrich(k, "customer_id", table(spark, sf, "customer"), "c_custkey", c_name="c_name").select("id", "c_name", "owner", "price", "received")


@query("d38_cycle_by_owner", f"WITH {_LIFE} SELECT owner, round(avg(date_diff('day', created, deal)), 4) AS cycle_days, count(*) AS n FROM l WHERE deal IS NOT NULL GROUP BY 1")
def d38(spark, sf):
    out = biz.cycle_days(life(spark, sf).filter("deal IS NOT NULL"), "created", "deal", ["owner"])
    return out.withColumn("cycle_days", rnd("cycle_days", 4))


@query("d38_cycle_by_month", f"WITH {_LIFE}, d AS (SELECT strftime(deal, '%Y-%m') AS month, deal, avg(date_diff('day', created, deal)) AS m, count(*) AS n FROM l WHERE deal IS NOT NULL GROUP BY 1, 2) SELECT month, round(sum(m), 4) AS cycle_days, sum(n)::BIGINT AS n FROM d GROUP BY 1")
def d38_month(spark, sf):
    l = life(spark, sf).filter("deal IS NOT NULL").withColumn("month", F.date_format("deal", "yyyy-MM"))
    return biz.cycle_days(l, "created", "deal", ["month"], daily_mean_sum=True).withColumn("cycle_days", rnd("cycle_days", 4))


@query("d38_cycle_by_area", f"WITH {_LIFE} SELECT n_regionkey AS area, round(avg(date_diff('day', created, deal)), 4) AS cycle_days, count(*) AS n FROM l JOIN nation ON n_nationkey = owner WHERE deal IS NOT NULL GROUP BY 1")
def d38_area(spark, sf):
    l = enrich(life(spark, sf).filter("deal IS NOT NULL"), "owner", table(spark, sf, "nation"), "n_nationkey", area="n_regionkey")
    return biz.cycle_days(l, "created", "deal", ["area"]).withColumn("cycle_days", rnd("cycle_days", 4))


@query("d38_cycle_by_product", "SELECT l_partkey AS product, round(avg(date_diff('day', o_orderdate, l_shipdate)), 4) AS cycle_days, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def d38_product(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("product"), "l_shipdate")
    j = li.join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return biz.cycle_days(j, "o_orderdate", "l_shipdate", ["product"]).withColumn("cycle_days", rnd("cycle_days", 4))


@query("d39_received_per_contract", f"WITH {RECEIVED} SELECT contract_id, count(*) AS n, sum(price)::BIGINT AS price FROM v GROUP BY 1")
def d39(spark, sf):
    return biz.counts_by(received(spark, sf), ["contract_id"], price=F.sum("price"))


# ---- ERP and devices ------------------------------------------------------------------------


@query("d40_sale_totals", f"WITH {RECEIVED} SELECT coalesce(sum(price) FILTER (WHERE time >= '1997-05-06' AND time < '1997-05-07'), 0)::BIGINT AS today, coalesce(sum(price) FILTER (WHERE time >= '1997-05-05' AND time < '1997-05-06'), 0)::BIGINT AS yesterday, coalesce(sum(price) FILTER (WHERE time >= '1997-05-01' AND time < '1997-05-07'), 0)::BIGINT AS month, coalesce(sum(price) FILTER (WHERE time >= '1997-01-01' AND time < '1997-05-07'), 0)::BIGINT AS year FROM v")
def d40(spark, sf):
    spans = {"today": ("1997-05-06", "1997-05-07"), "yesterday": ("1997-05-05", "1997-05-06"), "month": ("1997-05-01", "1997-05-07"), "year": ("1997-01-01", "1997-05-07")}
    lit = lambda x: F.lit(x).cast("timestamp_ntz")
    sums = {a: F.coalesce(F.sum(F.when((F.col("time") >= lit(s)) & (F.col("time") < lit(e)), F.col("price"))), F.lit(0)) for a, (s, e) in spans.items()}
    return biz.period_totals(received(spark, sf), "time", "1997-01-01", "1997-05-07", **sums)


@query("d40_sale_months", f"WITH {RECEIVED} SELECT strftime(m, '%Y-%m') AS month, (SELECT coalesce(sum(price), 0)::BIGINT FROM v WHERE date_trunc('month', time) = m) AS price FROM (SELECT unnest(range(TIMESTAMP '1996-12-01', TIMESTAMP '1997-06-01', INTERVAL 1 MONTH)) AS m)")
def d40_months(spark, sf):
    out = biz.trend(received(spark, sf), "time", "1996-12-01", "1997-05-31", "month", price=F.sum("price"))
    return out.select(F.date_format("range_start", "yyyy-MM").alias("month"), "price")


@query("d41_item_quantities", "SELECT l_orderkey, l_partkey, sum(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS shipped, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1, 2")
def d41(spark, sf):
    back = F.col("l_returnflag") == "R"
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum(F.when(~back, F.col("l_quantity"))).alias("shipped"), F.sum(F.when(back, F.col("l_quantity"))).alias("returned"))


_MOVES = "m AS (SELECT l_partkey AS product, l_suppkey % 3 AS warehouse, l_shipdate AS time, l_orderkey AS o, l_linenumber AS ln, l_suppkey AS sp, CASE WHEN l_returnflag = 'N' THEN -l_quantity ELSE l_quantity END AS change FROM lineitem)"


def moves(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_partkey").alias("product"), (F.col("l_suppkey") % 3).alias("warehouse"), F.col("l_shipdate").alias("time"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"),
                     F.col("l_suppkey").alias("sp"), F.when(F.col("l_returnflag") == "N", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("change"))


@query("d42_stock_on_hand", f"WITH {_MOVES} SELECT product, sum(change) AS on_hand FROM m GROUP BY 1")
def d42(spark, sf):
    return biz.stock_on_hand(moves(spark, sf), ["product"], "change")


@query("d42_stock_ledger", f"WITH {_MOVES} SELECT product, warehouse, o, ln, sp, change, sum(change) OVER (PARTITION BY product, warehouse ORDER BY time, o, ln, sp ROWS UNBOUNDED PRECEDING) AS balance FROM m")
def d42_ledger(spark, sf):
    return biz.stock_ledger(moves(spark, sf), ["product", "warehouse"], ["time", "o", "ln", "sp"], "change").select("product", "warehouse", "o", "ln", "sp", "change", "balance")


@query("l12_stock_guard", f"WITH {_MOVES}, b AS (SELECT *, sum(change) OVER (PARTITION BY product ORDER BY time, o, ln, sp ROWS UNBOUNDED PRECEDING) AS balance FROM m) SELECT product, count(*) AS moves, count(*) FILTER (WHERE balance < 0) AS refused FROM b GROUP BY 1")
def l12(spark, sf):
    out = biz.stock_ledger(moves(spark, sf), ["product"], ["time", "o", "ln", "sp"], "change")
    return out.groupBy("product").agg(F.count(F.lit(1)).alias("moves"), F.count(F.when(F.col("negative"), 1)).alias("refused"))


@query("d43_devices", "SELECT c_mktsegment AS product, c_custkey % 3 AS state, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 9000) AS fresh FROM customer GROUP BY 1, 2")
def d43(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("product"), (F.col("c_custkey") % 3).alias("state"), "c_acctbal")
    return biz.counts_by(c, ["product", "state"], fresh=F.count(F.when(F.col("c_acctbal") > 9000, 1)))


@query("d44_messages_per_hour", """SELECT strftime(h, '%Y-%m-%d %H') AS hour, (SELECT count(*) FROM events WHERE date_trunc('hour', ts) = h AND event_type IN ('click', 'error')) AS upstream, (SELECT count(*) FROM events WHERE date_trunc('hour', ts) = h AND event_type NOT IN ('click', 'error')) AS downstream
FROM (SELECT unnest(range(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-06', INTERVAL 1 HOUR)) AS h)""")
def d44(spark, sf):
    up = F.col("event_type").isin("click", "error")
    out = biz.trend(table(spark, sf, "events"), "ts", "2024-01-03", "2024-01-05", "hour", upstream=F.count(F.when(up, 1)), downstream=F.count(F.when(~up, 1)))
    return out.select(F.date_format("range_start", "yyyy-MM-dd HH").alias("hour"), "upstream", "downstream")


@query("d45_messages_per_conversation", "SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS users FROM conversations GROUP BY 1")
def d45(spark, sf):
    return biz.counts_by(table(spark, sf, "conversations"), ["conv_id"], users=F.count(F.when(F.col("role") == "user", 1)))


@query("d45_embedded_share", "SELECT label, count(*) AS n, count(*) FILTER (WHERE embedding[1] > 0) AS embedded, round(count(*) FILTER (WHERE embedding[1] > 0) / count(*), 6) AS share FROM embeddings GROUP BY 1")
def d45_share(spark, sf):
    out = biz.embedded_share(table(spark, sf, "embeddings"), ["label"], F.get("embedding", F.lit(0)) > 0)
    return out.withColumn("share", rnd("share"))
