"""Row predicates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.operators.features import let

_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v,
    "lt": lambda c, v: c < v, "le": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)), "like": lambda c, v: c.contains(v),
}


def where_if_present(df: DataFrame, spec: Sequence[tuple[str, str, Any]]) -> DataFrame:
    """Conditions ``(column, operation, argument)``; those with an empty argument are skipped."""
    for name, op, arg in spec:
        if op == "between":
            low, high = arg if arg is not None else (None, None)
            if low is not None:
                df = df.filter(F.col(name) >= low)
            if high is not None:
                df = df.filter(F.col(name) <= high)
        elif arg is not None and arg != "" and arg != []:
            df = df.filter(_COMPARE[op](F.col(name), arg))
    return df


def find_in_set(value: Column, cell: Column) -> Column:
    return F.array_contains(F.split(cell, ","), value.cast("string"))


RULE_OPS = ("=", "!=", ">", ">=", "<", "<=", "in", "not in", "between", "not between", "like", "not null")


def _operands(source: Column, param: Column) -> Column:
    """Both sides as text, items and numbers, worked out once per comparison."""
    src, one = source.cast("string"), param.cast("string")
    items = F.transform(F.split(one, ","), lambda x: F.trim(x))
    return let(
        F.struct(src.alias("src"), one.alias("one"), items.alias("items"), F.transform(items, lambda x: x.try_cast("double")).alias("nums"),
                 src.try_cast("double").alias("num"), one.try_cast("double").alias("value")),
        lambda b: F.struct(b["src"], b["one"], b["items"], b["nums"], b["num"], b["value"],
                           (b["num"].isNotNull() & F.forall(b["nums"], lambda x: x.isNotNull())).alias("numeric")))


def _decide(op: str, b: Column) -> Column:
    def ordered(compare: Callable[[Column, Column], Column]) -> Column:
        return F.when(b["numeric"], compare(b["num"], b["value"])).otherwise(compare(b["src"], b["one"]))

    def within(x: Column, bounds: Column) -> Column:
        return (x >= F.get(bounds, F.lit(0))) & (x <= F.get(bounds, F.lit(1)))

    inside = lambda: F.when(b["numeric"], within(b["num"], b["nums"])).otherwise(within(b["src"], b["items"]))
    return {
        "=": lambda: b["src"] == b["one"], "!=": lambda: b["src"] != b["one"],
        ">": lambda: ordered(lambda x, y: x > y), ">=": lambda: ordered(lambda x, y: x >= y),
        "<": lambda: ordered(lambda x, y: x < y), "<=": lambda: ordered(lambda x, y: x <= y),
        "in": lambda: F.array_contains(b["items"], b["src"]), "not in": lambda: ~F.array_contains(b["items"], b["src"]),
        "between": inside, "not between": lambda: ~inside(),
        "like": lambda: b["src"].contains(b["one"]), "not null": lambda: b["src"].isNotNull(),
    }[op]()


def rule_op(op: str, source: Column, param: Column) -> Column:
    """Scene-rule comparison of text values; order comparisons are numeric when all sides are numbers."""
    return F.coalesce(let(_operands(source, param), lambda b: _decide(op, b)), F.lit(False))


def rule_op_by(op: Column, source: Column, param: Column, ops: Sequence[str] = RULE_OPS) -> Column:
    """``rule_op`` with the operation in a column that holds some of ``ops``."""
    def choose(b: Column) -> Column:
        return reduce(lambda acc, o: acc.when(op == o, _decide(o, b)), ops, F.when(F.lit(False), F.lit(False))).otherwise(False)

    return F.coalesce(let(_operands(source, param), choose), F.lit(False))


def time_op(op: str, now: Column, param: str) -> Column:
    """``date_time_*`` compares epoch seconds, ``time_*`` the time of day (HH:mm or HH:mm:ss)."""
    parts = [p.strip() for p in param.split(",")]
    if op.startswith("date_time"):
        value, bounds = F.unix_timestamp(now), [F.lit(int(p)) for p in parts]
    else:
        value = F.date_format(now, "HH:mm:ss")
        bounds = [F.lit(p if p.count(":") == 2 else p + ":00") for p in parts]
    kind = op.rsplit("_", 1)[1]
    if kind == "between":
        return (value >= bounds[0]) & (value <= bounds[1])
    return value > bounds[0] if kind == ">" else value < bounds[0]


def match_static(groups: Sequence[Sequence[Column]]) -> Column:
    """Groups of conditions known when the plan is built: OR of ANDs; no groups match, empty groups are skipped."""
    filled = [reduce(lambda a, b: a & b, g) for g in groups if g]
    if not groups:
        return F.lit(True)
    return reduce(lambda a, b: a | b, filled, F.lit(False))


def match_dnf(groups: Column, test: Callable[[Column], Column]) -> Column:
    """The same for groups held in a column of arrays of condition structs."""
    some = F.exists(groups, lambda g: (F.size(g) > 0) & F.forall(g, test))
    return groups.isNull() | (F.size(groups) == 0) | some


def tenant_filter(df: DataFrame, tenant: Any, ignore: bool = False, column: str = "tenant_id") -> DataFrame:
    return df if ignore or column not in df.columns else df.filter(F.col(column) == tenant)


def data_scope_filter(
    df: DataFrame, scope: Mapping[str, Any] | None, dept: str = "dept_id", user: str = "user_id",
) -> DataFrame:
    """Row permission: ``all`` keeps everything, no scope nothing, else own departments or own rows."""
    if scope is None:
        return df.filter(F.lit(False))
    if scope.get("all"):
        return df
    tests = []
    if scope.get("depts"):
        tests.append(F.col(dept).isin(list(scope["depts"])))
    if scope.get("self") is not None:
        tests.append(F.col(user) == scope["self"])
    return df.filter(reduce(lambda a, b: a | b, tests, F.lit(False)))


def not_deleted(df: DataFrame, column: str = "deleted") -> DataFrame:
    return df.filter(~F.col(column))


def contact_backlog(df: DataFrame, kind: str, today: str, due: str = "contact_next_time", done: str = "contact_last_time") -> DataFrame:
    """Customers to contact today, overdue, or contacted today."""
    start = F.lit(today).cast("timestamp_ntz")
    end = start + F.expr("interval 1 day")
    c, last = F.col(due), F.col(done)
    if kind == "today":
        return df.filter((c >= start) & (c < end))
    if kind == "overdue":
        return df.filter((c < start) & (last.isNull() | (last < c)))
    return df.filter((last >= start) & (last < end))


def select_prefixed(df: DataFrame, prefix: str, **renamed: str) -> DataFrame:
    """All columns with a prefix, or under the names given as ``new=old``."""
    back = {old: new for new, old in renamed.items()}
    return df.select(*[F.col(c).alias(back.get(c, prefix + c)) for c in df.columns])


def dispatch_shard(df: DataFrame, sequence: str, shards: int) -> DataFrame:
    """Shard number per row and the dispatch fields that go with it."""
    return df.withColumn("partition_id", F.pmod(F.col(sequence), F.lit(shards)).cast("int")).withColumn("num_partitions", F.lit(shards))
