"""The rule index against a plain evaluation of every rule, and the cases of the trigger types."""

import random

import pytest

from sigspark.operators import rules
from sigspark.sources import sinks

MESSAGES = "message_id long, device_id long, product_id long, method string, identifier string, params map<string,string>, state string, report_time timestamp"


def number(x):
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def holds(op, src, one):
    """Plain meaning of an operator on text."""
    if src is None or one is None:
        return op == "not null" and src is not None
    items = [x.strip() for x in one.split(",")]
    nums, num = [number(x) for x in items], number(src)
    numeric = num is not None and all(x is not None for x in nums)
    if op in ("=", "!="):
        return (src == one) == (op == "=")
    if op in (">", ">=", "<", "<="):
        a, b = (num, number(one)) if numeric else (src, one)
        return a is not None and b is not None and {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
    if op in ("in", "not in"):
        return (src in items) == (op == "in")
    if op in ("between", "not between"):
        x, bounds = (num, nums) if numeric else (src, items)
        if len(bounds) < 2:                                    # unknown above a missing bound
            return op == "not between" and x < bounds[0]
        return (bounds[0] <= x <= bounds[1]) == (op == "between")
    return one in src if op == "like" else op == "not null"


def plain(messages, table):
    out = []
    for m in messages:
        source = lambda i: m["params"].get(i, m["params"].get("")) if m["params"] is not None else None  # noqa: B023, E731
        for rule, triggers, _ in table:
            for kind, device, product, ident, op, value, groups in triggers:
                if m["method"] != rules.METHODS.get(kind) or (device is not None and device != m["device_id"]) or (product is not None and product != m["product_id"]):
                    continue
                if kind == "state":
                    fires = holds(op, m["state"], value)
                else:
                    fires = ident is not None and ident == m["identifier"]
                    if kind == "property" or (kind == "event" and op and value):
                        fires = fires and holds(op, source(ident), value)
                test = lambda c: holds(c[2], m["state"] if c[0] == "state" else source(c[1]), c[3])  # noqa: B023, E731
                if fires and (not groups or any(g and all(map(test, g)) for g in groups)):
                    out.append((m["message_id"], rule))
                    break
    return sorted(out)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(4)
    pick = rng.choice
    values = ["5", "5.0", "7", "abc", "12.5", "", "1e2", "-3", "0,1"]
    messages = [dict(
        message_id=i, device_id=pick([1, 2, 3, None]), product_id=pick([1, 2, None]), method=pick([*rules.METHODS.values(), "other", None]), identifier=pick(["k", "t", "", None]),
        params=pick([None, {"k": pick(values)}, {"": pick(values)}, {"k": pick(values), "t": pick(values)}]), state=pick(["0", "1", "2", None]), report_time=None) for i in range(300)]
    ops = [">", ">=", "<", "<=", "=", "!=", "in", "not in", "between", "not between", "like", "", None]
    operands = ["5", "7", "6, 13", "abc", "5,7", "-10,10", "zz", "", None, "1e1"]
    table = []
    for r in range(400):
        triggers = []
        for _ in range(rng.randrange(1, 4)):
            kind = pick(["property", "property", "event", "service", "state"])
            groups = pick([None, [], [[]], [[(pick(["property", "state"]), "k", pick(ops[:6]), pick(operands[:5]))], []], [[("state", None, "=", "1"), ("property", "t", ">", "1")]]])
            triggers.append((kind, pick([None, None, 1, 2]), pick([None, None, 1]), pick(["k", "t", None]), pick(ops), pick(operands), groups))
        table.append((r, triggers, [("alert", r)]))
    return messages, table


def test_index_equals_plain_evaluation(spark, case):
    messages, table = case
    df = spark.createDataFrame([tuple(m.values()) for m in messages], MESSAGES)
    rows = [(r, [t[:6] + (None if t[6] is None else [[(c[0], c[1], c[2], c[3]) for c in g] for g in t[6]],) for t in ts], a) for r, ts, a in table]
    index = rules.index_rules(spark.createDataFrame(rows, rules.RULES))
    got = rules.match_rules(df, index).select("message_id", "rule_id").collect()
    assert sorted(map(tuple, got)) == plain(messages, table)
    assert rules.match_rules(df, spark.createDataFrame([], rules.RULES)).count() == 0
    assert rules.match_rules(df.limit(0), index).count() == 0


def test_rows_met_follow_the_hits(spark):
    """Of 20,000 thresholds on one identifier a message that exceeds ten meets one page."""
    rows = [(r, [("property", None, None, "k", ">", str(r * 10), None)], []) for r in range(20_000)]
    index = rules.index_rules(spark.createDataFrame(rows, rules.RULES))
    assert index.pages.count() == -(-20_000 // rules.PAGE)
    df = spark.createDataFrame([(1, 1, 1, rules.METHODS["property"], "k", {"k": "95"}, None, None)], MESSAGES)
    assert sorted(r.rule_id for r in rules.match_rules(df, index).collect()) == list(range(10))


def test_routing_by_equality(spark):
    msgs = spark.createDataFrame([(1, "a", 7, "k"), (2, "a", 8, "t"), (3, "b", None, None), (4, None, 7, "k")], "id int, method string, device_id long, identifier string")
    r = spark.createDataFrame([("a", None, None, [1, 2]), ("a", 7, "", [2, 3]), ("a", 8, "k", [4]), ("b", None, "", [9]), ("a", None, "t", [5])], "method string, device_id long, identifier string, sink_ids array<int>")
    kinds = spark.createDataFrame([(i, "x", i != 5) for i in range(1, 10)], "sink_id int, kind string, enabled boolean")
    got = sorted((x.id, x.sink_id) for x in sinks.route_to_sinks(msgs, r, kinds).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 9)]


def folded(pairs):
    out = {}
    for message, rule in pairs:
        n, first = out.get(rule, (0, message))
        out[rule] = n + 1, min(first, message)
    return out


def got_folded(df):
    out = {}
    for r in df.collect():
        assert r.n > 0
        n, first = out.get(r.rule_id, (0, r.first))
        out[r.rule_id] = n + r.n, min(first, r.first)
    return out


def rule_rows(spark, table):
    return spark.createDataFrame([(r, [t[:6] + (None if t[6] is None else [[(c[0], c[1], c[2], c[3]) for c in g] for g in t[6]],) for t in ts], a) for r, ts, a in table], rules.RULES)


def test_folded_matches_equal_plain_evaluation(spark, case):
    """Counted along a line or by text, or tested one by one: the same matches of every rule, rules and messages that come twice too."""
    messages, table = case
    single = [(1000 + i, [t[:6] + (g,)], a) for i, (_, ts, a) in enumerate(table) for t, g in [(ts[0], None if i % 2 else [])]]
    df = spark.createDataFrame([tuple(m.values()) for m in messages], MESSAGES)
    twice = spark.createDataFrame([tuple(m.values()) for m in messages[:50]], MESSAGES)
    index = rules.index_rules(rule_rows(spark, table + single))
    assert {c[4] for c in index.codes if c[-1]} == {"up", "down", "eq", "span"} and not all(c[-1] for c in index.codes)
    want = folded(plain(messages, table + single))
    assert len(want) > 100 and got_folded(rules.match_rules(df, index, "message_id")) == want
    both = got_folded(rules.match_rules(df.union(twice), rules.index_rules(rule_rows(spark, table + single + single)), "message_id"))
    assert both == folded(plain(messages + messages[:50], table + single + single))
    assert rules.match_rules(df, spark.createDataFrame([], rules.RULES), "message_id").columns == ["rule_id", "n", "first"]
    assert rules.match_rules(df.limit(0), index, "message_id").count() == 0


def test_folded_thresholds_at_the_value(spark):
    values = ["5", "5.0", "-0.0", "0", "abc", "", None, "nan", "1e400", "-1e400", "7"]
    messages = [dict(message_id=i, device_id=1, product_id=None, method=rules.METHODS["property"], identifier="k", params=None if v is None else {"k": v}, state=None, report_time=None) for i, v in enumerate(values)]
    table = [(i, [("property", d, p, "k", op, x, g)], []) for i, (op, x, d, p, g) in enumerate(
        (op, x, *where) for op in (">", ">=", "<", "between", "<=", "=", "in") for x in ("5", "0", "-0.0", "7,5", "abc", "0,6", "5, 5", "-1e500,7,1")
        for where in ((None, None, None), (1, None, []), (1, 1, None), (2, None, None), (None, None, [[("property", "k", "<", "6")]])))]
    df, r = spark.createDataFrame([tuple(m.values()) for m in messages], MESSAGES), rule_rows(spark, table)
    each = folded(map(tuple, rules.match_rules(df, r).select("message_id", "rule_id").collect()))
    assert len(each) > 40 and got_folded(rules.match_rules(df, r, "message_id")) == each


def test_folded_ranges_of_any_width(spark):
    """600 values, some equal, under ranges of no, few and all values: number and least id."""
    rng = random.Random(9)
    values = [rng.randrange(400) / 4 for _ in range(600)]
    ids = rng.sample(range(1000), 600)
    ends = [sorted((rng.randrange(-40, 440) / 4, rng.randrange(-40, 440) / 4)) for _ in range(150)] + [[x, x] for x in (5.0, 7.25, 7.3)] + [[50.0, 20.0], [-1.0, 500.0]]
    df = spark.createDataFrame([(i, 1, 1, rules.METHODS["property"], "k", {"k": str(v)}, None, None) for i, v in zip(ids, values)], MESSAGES)
    table = [(r, [("property", None, None, "k", "between", f"{a},{b}", None)], []) for r, (a, b) in enumerate(ends)]
    for size in (str(64 << 20), "4000"):
        spark.conf.set("sigspark.sliceBytes", size)
        try:
            got = got_folded(rules.match_rules(df, rule_rows(spark, table), "message_id"))
        finally:
            spark.conf.unset("sigspark.sliceBytes")
        assert got == folded((i, r) for r, (a, b) in enumerate(ends) for i, v in zip(ids, values) if a <= v <= b)


def test_folded_matches_are_not_made_one_by_one(spark):
    """4,000 messages above 4,000 thresholds: the plan that folds them meets no page of thresholds, and any number of slices counts alike."""
    table = [(r, [("property", None, None, "k", ">=" if r % 2 else "<", str(r), None)], []) for r in range(4_000)]
    index = rules.index_rules(spark.createDataFrame(table, rules.RULES))
    df = spark.range(4_000).selectExpr(
        "id AS message_id", "1L AS device_id", "1L AS product_id", "'thing.property.post' AS method", "'k' AS identifier", "map('k', string(id)) AS params", "'' AS state", "timestamp'2024-01-01' AS report_time")
    for size in (str(64 << 20), "20000"):
        spark.conf.set("sigspark.sliceBytes", size)
        try:
            out = rules.match_rules(df, index, "message_id")
            got = got_folded(out)
        finally:
            spark.conf.unset("sigspark.sliceBytes")
        assert out.count() == 3_999                             # none is below 0
        assert all(got[r] == ((4_000 - r, r) if r % 2 else (r, 0)) for r in range(1, 4_000))
