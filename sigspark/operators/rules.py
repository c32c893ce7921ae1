"""Device rules: triggers, condition groups, scenes, alerts, offline detection.

Messages: ``message_id, device_id, product_id, method, identifier, params MAP<STRING,STRING>,
state, report_time``. Rules: ``rule_id, triggers ARRAY<STRUCT>, actions ARRAY<STRUCT>`` as in RULES.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.operators.predicates import RULE_OPS, match_dnf, rule_op_by
from sigspark.operators.series import positions, running
from sigspark.session import written

RULES = (
    "rule_id long, triggers array<struct<type:string,device_id:long,product_id:long,identifier:string,operator:string,value:string,"
    "groups:array<array<struct<type:string,identifier:string,operator:string,param:string>>>>>, actions array<struct<kind:string,target:long>>"
)
# The message method each trigger type listens to.
METHODS = {
    "property": "thing.property.post", "event": "thing.event.post",
    "service": "thing.service.invoke", "state": "thing.state.update",
}

Matcher = Callable[[Column], Column]
#: Operators that the rules at hand use; the others need not be tried.
_IN_USE: ContextVar[tuple[str, ...]] = ContextVar("in_use", default=RULE_OPS)


def _compare(op: Column, source: Column, param: Column) -> Column:
    return rule_op_by(op, source, param, _IN_USE.get())


def _source(identifier: Column) -> Column:
    """The named parameter, or the whole value when the message carries a single unnamed one."""
    return F.coalesce(F.get(F.array(F.col("params")[identifier]), F.lit(0)), F.col("params")[""])


def _property(t: Column) -> Column:
    return (t["identifier"] == F.col("identifier")) & _compare(t["operator"], _source(t["identifier"]), t["value"])


def _event(t: Column) -> Column:
    tested = (F.coalesce(t["operator"], F.lit("")) != "") & (F.coalesce(t["value"], F.lit("")) != "")
    return (t["identifier"] == F.col("identifier")) & (~tested | _compare(t["operator"], _source(t["identifier"]), t["value"]))


def _service(t: Column) -> Column:
    return t["identifier"] == F.col("identifier")


def _state(t: Column) -> Column:
    return _compare(t["operator"], F.col("state"), t["value"])


def _condition_time(c: Column) -> Column:
    clock = F.date_format("report_time", "HH:mm:ss")
    return _compare(c["operator"], clock, c["param"])


TRIGGERS: dict[str, tuple[int, Matcher]] = {
    "property": (10, _property), "event": (20, _event), "service": (30, _service), "state": (40, _state),
}
_BUILT_IN = dict(TRIGGERS)
CONDITIONS: dict[str, Matcher] = {
    "property": lambda c: _compare(c["operator"], _source(c["identifier"]), c["param"]),
    "state": lambda c: _compare(c["operator"], F.col("state"), c["param"]),
    "time": _condition_time,
}


def register_trigger(kind: str, matcher: Matcher, priority: int = 100, method: str | None = None) -> None:
    """Add a trigger type; lower priorities are tried first. Without a method it sees every message."""
    TRIGGERS[kind] = (priority, matcher)
    if method:
        METHODS[kind] = method


def register_condition(kind: str, matcher: Matcher) -> None:
    CONDITIONS[kind] = matcher


def _by_type(kinds: dict[str, Matcher], item: Column) -> Column:
    chosen = reduce(lambda acc, kv: acc.when(item["type"] == kv[0], kv[1](item)), kinds.items(), F.when(F.lit(False), F.lit(False)))
    return F.coalesce(chosen.otherwise(False), F.lit(False))


# ---- index ----------------------------------------------------------------------------------

PAGE = 128
_KEY = ["code", "method", "identifier", "scope_id", "text"]


@dataclass(frozen=True)
class RuleIndex:
    """Rules by what a message must bring to fire them.

    ``codes`` (at most a few dozen) name the kinds of keys in use: whether a method and an identifier are asked for, the scope (device,
    product or any) and how the operand is met: ``eq`` by its text, ``up`` / ``down`` by thresholds in ascending / descending
    order, ``span`` by both ends of a range, ``all`` not at all; last whether a message that meets the key on its side of the threshold
    has fired the rule, with nothing left to test. ``ops``, ``kinds`` and ``conditions`` are the operators and types in use, ``several`` whether a rule has more
    than one trigger. ``pages`` holds the triggers of a key in pages of ``PAGE``, sorted by threshold; ``heads`` the
    first threshold and the greatest upper end of each of a key's pages.
    """

    codes: tuple[tuple[bool, bool, str, str, str, bool], ...]
    heads: DataFrame
    pages: DataFrame
    ops: tuple[str, ...] = RULE_OPS
    kinds: tuple[str, ...] = ()
    conditions: tuple[str, ...] = ()
    several: bool = True


def _flat(rules: DataFrame) -> DataFrame:
    """One row per trigger and key it is found by: parsed operand, threshold, the triggers of its rule before it."""
    kinds = sorted(TRIGGERS.items(), key=lambda kv: kv[1][0])
    listens = reduce(lambda acc, k: acc.when(F.col("t.type") == k, METHODS[k]), [k for k, _ in kinds if k in METHODS], F.when(F.lit(False), ""))
    t = F.col("t")
    rows = rules.select("rule_id", "triggers", F.posexplode("triggers").alias("__at", "t")).filter(t["type"].isin(list(TRIGGERS)))
    rows = rows.withColumn("method", listens).withColumn("earlier", F.slice("triggers", 1, F.col("__at")))
    source = F.when(t["type"].isin("property", "event"), "param").when(t["type"] == "state", "state").otherwise("none")
    named = t["type"].isin("property", "event", "service")
    op, one = F.coalesce(t["operator"], F.lit("")), t["value"]
    items = F.transform(F.split(one, ","), lambda x: F.trim(x))
    nums = F.transform(items, lambda x: x.try_cast("double"))
    whole, low = one.try_cast("double"), F.get(nums, F.lit(0))
    spread = (op == "between") & (F.size(nums) >= 2) & F.forall(nums, lambda x: x.isNotNull())
    tested = (source != "none") & one.isNotNull() & ((t["type"] != "event") | (one != ""))
    met = (
        F.when(~tested, "all").when(op == "=", "eq").when(op == "in", "eq").when(op.isin(">", ">=") & whole.isNotNull(), "up")
        .when(op.isin("<", "<=") & whole.isNotNull(), "down").when(spread, "span").otherwise("all")
    )
    plain = t["type"].isin([k for k in ("property", "event", "state") if TRIGGERS.get(k) == _BUILT_IN[k]]) & (t["device_id"].isNull() | t["product_id"].isNull())
    alone = plain & (F.size("triggers") == 1) & (t["groups"].isNull() | (F.size(t["groups"]) == 0)) & (
        (met == "eq") | (met.isin("up", "down") & ~F.isnan(whole)) | ((met == "span") & ~F.isnan(low) & ~F.isnan(F.get(nums, F.lit(1)))))
    scope = F.when(t["device_id"].isNotNull(), "device").when(t["product_id"].isNotNull(), "product").otherwise("any")
    keyed = rows.filter(~named | t["identifier"].isNotNull()).select(
        "rule_id", "t", "earlier", F.coalesce("method", F.lit("")).alias("method"), F.col("method").isNotNull().alias("listens"),
        F.when(named, t["identifier"]).otherwise("").alias("identifier"), source.alias("source"),
        named.alias("named"), scope.alias("scope"),
        F.coalesce(F.when(scope == "device", t["device_id"]).when(scope == "product", t["product_id"]), F.lit(0)).alias("scope_id"), met.alias("met"), F.coalesce(alone, F.lit(False)).alias("alone"),
        F.when(met == "span", low).when(met == "up", whole).when(met == "down", -whole).alias("__x"), F.when(met == "span", F.get(nums, F.lit(1))).alias("__y"),
        F.when(met == "eq", F.when(op == "in", F.array_distinct(items)).otherwise(F.array(one))).otherwise(F.array(F.lit(""))).alias("__texts"),
    )
    return keyed.withColumn("text", F.explode("__texts")).drop("__texts")


def index_rules(rules: DataFrame) -> RuleIndex:
    """Flatten, parse and sort the triggers once and write them; the index serves any number of batches."""
    flat = written(_flat(rules), "rules")
    kind = ["listens", "named", "source", "scope", "met", "alone"]
    tests = F.flatten(F.coalesce(F.col("t.groups"), F.array()))
    used = flat.agg(                                           # sets of a few dozen values at most
        F.collect_set(F.struct(*kind)).alias("codes"), F.collect_set("t.type").alias("kinds"), F.max(F.size("earlier") > 0).alias("several"),
        F.array_distinct(F.flatten(F.collect_set(F.array_intersect(
            F.concat(F.array("t.operator"), tests["operator"]), F.array(*map(F.lit, RULE_OPS)))))).alias("ops"),
        F.array_distinct(F.flatten(F.collect_set(F.array_distinct(tests["type"])))).alias("conditions"),
    ).first()
    codes = sorted(tuple(r) for r in used["codes"])
    code = reduce(lambda acc, ic: acc.when(
        reduce(lambda a, b: a & b, [F.col(k) == v for k, v in zip(kind, ic[1], strict=True)]), F.lit(ic[0])), enumerate(codes), F.when(F.lit(False), F.lit(0)))
    keyed = flat.select(code.cast("int").alias("code"), "method", "identifier", "scope_id", "text", F.coalesce("__x", F.lit(0.0)).alias("x"), F.coalesce("__y", F.lit(float("inf"))).alias("y"), "rule_id", "t", "earlier")
    placed = positions(keyed, _KEY, ["x", "rule_id"], "__p").withColumn("page", F.floor(F.col("__p") / PAGE).cast("int"))
    pages = placed.groupBy(*_KEY, "page").agg(
        F.min("x").alias("low"), F.max("y").alias("high"), F.collect_list(F.struct("x", "y", "rule_id", "t", "earlier")).alias("entries"))
    pages = written(pages, "rule-pages")
    ends = pages.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("page", "low", "high"))).alias("__ends"))
    heads = written(ends.select(*_KEY, F.col("__ends.low").alias("lows"), F.col("__ends.high").alias("highs")), "rule-heads")
    return RuleIndex(
        tuple(codes), heads, pages, tuple(o for o in RULE_OPS if o in used["ops"]), tuple(used["kinds"]), tuple(used["conditions"]), bool(used["several"]))


def match_rules(msgs: DataFrame, rules: DataFrame | RuleIndex, first: str | None = None) -> DataFrame:
    """(message_id, device_id, report_time, rule_id), once per message row, for every rule with a trigger whose groups hold.

    A message asks the index for the keys that it can fire, at most one per code; of sorted thresholds it takes the pages that begin on
    its side of its value, of ranges those that may reach it, so the rows met follow the hits, not the number of rules. Triggers met are then tested
    exactly. Of a rule's triggers the first that fires counts.

    ``first``, a column of the messages, asks for the matches folded by rule: rows (rule_id, n, first) with the number of matches and the
    least value of the column. A rule may have several rows, whose numbers add up. The messages that have fired a rule by its threshold or text alone are then
    counted along one line of messages and thresholds in order, or by text, not match by match; all others are matched as ever.
    """
    index = rules if isinstance(rules, RuleIndex) else index_rules(rules)
    ways = {"param": "__param", "state": "__state"}

    def probe(i: int, code: tuple) -> Column:
        listens, named, kind, scope, met, alone = code
        said = F.col(ways[kind]) if kind in ways else F.lit(None).cast("string")
        number = F.col(f"{ways[kind]}_number") if kind in ways else F.lit(None).cast("double")
        limit = {"up": number, "span": number, "down": -number}.get(met, F.lit(None).cast("double"))
        counted = F.when(said.isNull(), "none").when(F.lit(met == "eq") | (number.isNotNull() & ~F.isnan(number)), met).otherwise("pages")
        return F.struct(
            F.lit(i).alias("code"), (F.col("method") if listens else F.lit("")).alias("method"), (F.col("identifier") if named else F.lit("")).alias("identifier"),
            {"device": F.col("device_id"), "product": F.col("product_id")}.get(scope, F.lit(0)).cast("long").alias("scope_id"),
            (said if met == "eq" else F.lit("")).alias("text"), limit.alias("limit"), (counted if alone and first else F.lit("pages")).alias("way"),
        )

    if not index.codes:
        none = msgs.select("message_id", "device_id", "report_time", F.lit(None).cast("long").alias("rule_id")).limit(0)
        return none if first is None else none.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).join(msgs.select(first).limit(0).toDF("first"), F.lit(True))
    told = msgs.select("*", _source(F.col("identifier")).cast("string").alias("__param"), F.col("state").cast("string").alias("__state"))
    told = told.select("*", *[F.col(w).try_cast("double").alias(f"{w}_number") for w in ways.values()])
    spread = told.repartition(int(msgs.sparkSession.conf.get("spark.sql.shuffle.partitions")))      # a small file of messages may fire many rules
    asked = spread.withColumn("__q", F.explode(F.array(*[probe(i, c) for i, c in enumerate(index.codes)])))
    keyed = asked.select("*", *[F.col(f"__q.{c}").alias(f"__{c}") for c in [*_KEY, "limit", "way"]]).drop("__q")
    folded = _folded(keyed, index, first) if first is not None else None
    keyed = keyed.filter(F.col("__way") == "pages").drop("__way")

    def same(side: str, names: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"__{c}") == F.col(f"__{side}_{c}") for c in names])

    anywhere = F.col("__limit").isNull() | F.isnan("__limit")
    heads = index.heads.select(*[F.col(c).alias(f"__h_{c}") for c in _KEY], "lows", "highs")
    found = keyed.join(heads, same("h", _KEY))
    pages = F.filter(F.sequence(F.lit(0), F.size("lows") - 1), lambda i: anywhere | ((F.get("lows", i) <= F.col("__limit")) & (F.get("highs", i) >= F.col("__limit"))))
    turned = found.withColumn("__page", F.explode(pages))
    page = index.pages.select(*[F.col(c).alias(f"__p_{c}") for c in _KEY], F.col("page").alias("__p_page"), "entries")
    met = turned.join(page, same("p", [*_KEY, "page"]))
    near = F.filter("entries", lambda e: anywhere | ((e["x"] <= F.col("__limit")) & (e["y"] >= F.col("__limit"))))
    rows = met.withColumn("__e", F.explode(near)).select(*msgs.columns, F.col("__e.rule_id").alias("rule_id"), F.col("__e.t").alias("t"), F.col("__e.earlier").alias("__earlier"))
    kinds = {k: m for k, (_, m) in sorted(TRIGGERS.items(), key=lambda kv: kv[1][0]) if k in index.kinds}
    conditions = {k: m for k, m in CONDITIONS.items() if k in index.conditions}

    def fires(t: Column) -> Column:
        scope = (t["device_id"].isNull() | (t["device_id"] == F.col("device_id"))) & (t["product_id"].isNull() | (t["product_id"] == F.col("product_id")))
        heard = reduce(lambda acc, k: acc.when(t["type"] == k, F.col("method") == METHODS[k]), [k for k in kinds if k in METHODS], F.when(F.lit(False), F.lit(True))).otherwise(True)
        return F.coalesce(scope & heard & _by_type(kinds, t) & match_dnf(t["groups"], lambda c: _by_type(conditions, c)), F.lit(False))

    token = _IN_USE.set(index.ops)
    try:
        hits = rows.filter(fires(F.col("t")))
        hits = hits.filter((F.size("__earlier") == 0) | ~F.exists("__earlier", fires)) if index.several else hits
    finally:
        _IN_USE.reset(token)
    if folded is None:
        return hits.select("message_id", "device_id", "report_time", "rule_id")
    return hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first")).unionByName(folded)


def _folded(keyed: DataFrame, index: RuleIndex, first: str) -> DataFrame | None:
    """(rule_id, n, first) of the rules that a message's key decides; None if there are none."""
    codes = {met: [i for i, c in enumerate(index.codes) if c[-1] and c[4] in met] for met in (("eq",), ("up", "down"), ("span",))}
    every = [i for some in codes.values() for i in some]
    if not every:
        return None
    asked = keyed.filter(F.col("__way").isin("eq", "up", "down", "span")).select(*[F.col(f"__{c}").alias(c) for c in _KEY], (F.col("__limit") + F.lit(0.0)).alias("x"), F.col(first).alias("first"))
    asked = written(asked.join(index.heads.filter(F.col("code").isin(every)).select(*_KEY), _KEY, "left_semi"), "rule-asked")
    entries = index.pages.filter(F.col("code").isin(every)).select(*_KEY, "page", F.posexplode("entries").alias("at", "e")).select(
        *_KEY, "page", "at", (F.col("e.x") + F.lit(0.0)).alias("x"), (F.col("e.y") + F.lit(0.0)).alias("y"), "e.rule_id", F.col("e.t.operator").alias("op"))
    by = {("eq",): _by_text, ("up", "down"): _by_threshold, ("span",): _by_range}
    return reduce(DataFrame.unionByName, [by[m](*[d.filter(F.col("code").isin(some)) for d in (asked, entries)]) for m, some in codes.items() if some])


def _by_text(asked: DataFrame, entries: DataFrame) -> DataFrame:
    said = asked.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    return entries.join(said, _KEY).select("rule_id", "n", "first")


def _line(asked: DataFrame, *marks: DataFrame) -> DataFrame:
    """Messages (``turn`` 1) and the marks of rules, whose columns the messages have as nulls."""
    line = asked.withColumn("turn", F.lit(1)).withColumn("tie", F.xxhash64("first"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marks, line)


def _by_threshold(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """Down from the greatest value: the messages before a rule have fired it, those at a threshold that may be reached included."""
    turn = F.when(F.col("op").isin(">", "<"), 0).otherwise(2)
    line = _line(asked, entries.select(*_KEY, "x", turn.alias("turn"), F.col("rule_id").cast("long").alias("tie"), "rule_id")).withColumn("x", -F.col("x"))
    met = running(line, _KEY, ["x", "turn", "tie"], n=("count", F.when(F.col("turn") == 1, 1)), least=("min", F.when(F.col("turn") == 1, F.col("first"))))
    return met.filter((F.col("turn") != 1) & (F.col("n") > 0)).select("rule_id", "n", F.col("least").alias("first"))


def _by_range(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """A range holds the messages from its low end's place in the line to its high end's; their least is that of the few blocks of 1, 16,
    256, ... places that make it up."""
    mine = [*_KEY, "page", "at", "rule_id"]
    ends = [entries.select(*mine, F.col(c).alias("x"), F.lit(turn).alias("turn"), F.col("rule_id").cast("long").alias("tie")) for c, turn in (("x", 0), ("y", 2))]
    placed = written(running(_line(asked, *ends), _KEY, ["x", "turn", "tie"], n=("count", F.when(F.col("turn") == 1, 1))), "rule-places")
    one = placed.filter(F.col("turn") == 1)
    most, top = one.agg(F.max("n")).first()[0] or 1, 0
    while 16 ** (top + 1) <= most:
        top += 1
    levels = F.explode(F.sequence(F.lit(0), F.lit(top)))
    wide = F.expr("shiftleft(1L, 4 * level)")
    blocks = one.select(*_KEY, "n", "first", levels.alias("level")).withColumn("w", wide).groupBy(*_KEY, "level", F.expr("(n - 1) div w").alias("block")).agg(F.min("first").alias("first"))
    spans = placed.filter(F.col("turn") != 1).groupBy(*mine).agg(F.max(F.when(F.col("turn") == 0, F.col("n"))).alias("a"), F.max(F.when(F.col("turn") == 2, F.col("n"))).alias("b"))
    pieces = spans.filter("b > a").withColumn("level", levels).withColumn("w", wide).selectExpr(*mine, "a", "b", "level", "(a + w - 1) div w AS p", "b div w AS q").filter("p < q")
    pieces = pieces.withColumn("l", F.expr(f"if(level = {top}, q, least(q, (p + 15) div 16 * 16))")).withColumn("r", F.expr(f"if(level = {top}, q, greatest(l, q div 16 * 16))"))
    some = [F.when(F.col(x) < F.col(y), F.sequence(F.col(x), F.col(y) - 1)).otherwise(F.array().cast("array<bigint>")) for x, y in (("p", "l"), ("r", "q"))]
    return pieces.withColumn("block", F.explode(F.concat(*some))).join(blocks, [*_KEY, "level", "block"]).groupBy(*mine, "a", "b").agg(F.min("first").alias("first")).select(
        "rule_id", (F.col("b") - F.col("a")).alias("n"), "first")


def scene_actions(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per (message, rule, action)."""
    acts = rules.select("rule_id", F.explode("actions").alias("a")).select("rule_id", F.col("a.kind").alias("kind"), F.col("a.target").alias("target"))
    return matches.join(acts, "rule_id")


def alert_records(events: DataFrame, keys, time: str, tie: str, opens: Column, recovers: Column) -> DataFrame:
    """One record per opening event, closed by the first recovery after it (null while open)."""
    back = events.withColumn("__rt", -F.col(time)).withColumn("__ri", -F.col(tie))
    seen = running(back, keys, ["__rt", "__ri"], recovered_at=("min", F.when(recovers, F.col(time))))
    return seen.filter(opens).drop("__rt", "__ri").withColumn("status", F.when(F.col("recovered_at").isNull(), "open").otherwise("recovered"))


def offline_devices(devices: DataFrame, last_report: DataFrame, key: str, now: Column, keep_alive_seconds: int, factor: float = 1.5) -> DataFrame:
    """Online devices whose newest report is older than keep-alive x factor."""
    limit = now - F.make_dt_interval(secs=F.lit(float(keep_alive_seconds * factor)))
    old = last_report.groupBy(key).agg(F.max("report_time").alias("report_time")).filter(F.col("report_time") < limit)
    return devices.filter("online").join(old, key, "inner")
