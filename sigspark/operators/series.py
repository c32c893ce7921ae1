"""Keyed, ordered series of any length.

A series is written once, range-partitioned by key and order. Each range is a slice: rows next to each other, about
as many in every slice, so a key that holds a third of all rows goes on from slice to slice while a slice may
hold many short keys. A slice holds about ``sigspark.sliceBytes`` (64 MB); a table that fits one is one slice and is not
written, as it has no edges. Operators work inside slices. What crosses an edge comes from tables with a few rows per slice:
the rows beside the edge for row frames, running totals of the key that goes on, composed states (``scan``) and
window starts (``restart``). There is one plan for every size.

A frame that already has the column ``SLICE`` is used as it stands and keeps it; else the operator writes the
slices and drops the column at its end. So operators in a row share one layout: slice first, drop last.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sigspark.session import written

SLICE, HALO = "__slice", "__halo"

Frame = Callable[[WindowSpec], dict[str, Column]]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` that also matches null keys and keeps the left key columns."""
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"__r_{k}"), keys, right)
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def slices_for(df: DataFrame) -> int:
    """Slices of about ``sigspark.sliceBytes``, at most as many as a shuffle has partitions.

    The planner's estimate is that of compressed files, so unless it is far below a slice, rows are counted."""
    conf = df.sparkSession.conf
    size, most = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), int(conf.get("sigspark.sliceBytes", str(64 << 20)))
    if size * 256 > most:
        size = df.count() * (16 + df._jdf.schema().defaultSize())
    return max(1, min(-(-size // most), int(conf.get("spark.sql.shuffle.partitions"))))


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with the number of each row's slice; later slices hold later (keys, order)."""
    if SLICE in df.columns:
        return df
    n = slices_for(df)
    if n == 1:
        return df.withColumn(SLICE, F.lit(0)).withMetadata(SLICE, {"slices": 1})
    ranged = df.repartitionByRange(n, *[F.col(c) for c in [*keys, *order]])
    return written(ranged.withColumn(SLICE, F.spark_partition_id()), "series")


def on_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The sliced series, and what hides the slices again if the caller had none."""
    own = SLICE in df.columns
    return sliced(df, keys, order), (lambda out: out if own else out.drop(SLICE))


def edgeless(cut: DataFrame) -> bool:
    """Whether the whole series is one slice."""
    return cut.schema[SLICE].metadata.get("slices") == 1


def settled(cut: DataFrame) -> DataFrame:
    """The series as a stored table, for operators that read it more than once: what made it runs once, not once a reading.

    One slice, a frame without slices and columns taken or filtered from a stored table stay as they are."""
    if SLICE not in cut.columns or edgeless(cut):
        return cut
    plan = cut._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return written(cut, "series") if plan.children().nonEmpty() else cut


def key_struct(keys: Sequence[str]) -> Column:
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def within(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(SLICE, *keys).orderBy(*order)


def stretches(cut: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """A row for each slice of each key: how many rows, how many before (``__pos0``), the key's next slice (``__next``), its
    number among the key's slices (``__nth``, from 0), and the given totals."""
    sums = cut.groupBy(SLICE, *keys).agg(F.count(F.lit(1)).alias("__n"), *[c.alias(n) for n, c in totals.items()])
    chain = Window.partitionBy(*keys).orderBy(SLICE)
    before = F.sum("__n").over(chain.rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(
        "*", F.coalesce(before, F.lit(0)).alias("__pos0"), F.lead(SLICE).over(chain).alias("__next"),
        (F.row_number().over(chain) - 1).alias("__nth"),
    )


def resumed(cut: DataFrame, starts: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    """``cut`` with columns of ``starts``, which has at most one row per slice: for its key ``__k``; null for other keys.

    There are at most as many slices as a shuffle has partitions, so these rows are broadcast and the series is not dealt anew."""
    small = starts.select(SLICE, "__k", *[F.col(c).alias(f"__r_{n}") for n, c in columns.items()])
    mine = F.col("__k").isNotNull() & F.col("__k").eqNullSafe(key_struct(keys))
    out = cut.join(F.broadcast(small), SLICE, "left")
    return out.select(*[F.col(f"`{c}`") for c in cut.columns], *[F.when(mine, F.col(f"__r_{n}")).alias(n) for n in columns])


def _neighbours(cut: DataFrame, order: Sequence[Column], n: int, ahead: bool) -> DataFrame:
    """The last ``n`` rows of each slice (``ahead``: the first), relabelled to the later (earlier) slices that they reach."""
    near = cut.withColumn("__e", F.row_number().over(Window.partitionBy(SLICE).orderBy(*order))).filter(F.col("__e") <= n)
    sizes = cut.groupBy(SLICE).agg(F.count(F.lit(1)).alias("__n"))             # a row per slice
    line = Window.orderBy(F.col(SLICE).desc() if ahead else F.col(SLICE))
    upto = sizes.withColumn("__end", F.sum("__n").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    later = F.collect_list(F.struct(F.col(SLICE).alias("to"), (F.col("__end") - F.col("__n")).alias("at"))).over(line.rowsBetween(1, n))
    reach = upto.withColumn("__later", later).select(F.col(SLICE).alias("__from"), "__end", F.explode("__later").alias("__l")).select(
        "__from", F.col("__l.to").alias("__to"), (F.col("__l.at") - F.col("__end")).alias("__gap")).filter(F.col("__gap") < n)
    lent = near.join(reach, F.col(SLICE) == F.col("__from")).filter(F.col("__gap") + F.col("__e") <= n)
    return lent.withColumn(SLICE, F.col("__to")).withColumn(HALO, F.lit(True)).select(*[F.col(f"`{c}`") for c in cut.columns], HALO)


def with_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], frame: Frame, before: int = 0, after: int = 0) -> DataFrame:
    """Add window columns whose frames reach ``before`` rows back and ``after`` rows ahead.

    ``frame`` gets the window (partitioned and ordered) and returns the new columns.
    """
    cut, done = on_slices(df, keys, order)
    if edgeless(cut):
        return done(cut.select("*", *[c.alias(n) for n, c in frame(within(keys, order)).items()]))
    cut = settled(cut)
    full = cut.withColumn(HALO, F.lit(False))
    line = [*keys, *order]
    if before:
        full = full.unionByName(_neighbours(cut, [F.col(c).desc() for c in line], before, False))
    if after:
        full = full.unionByName(_neighbours(cut, [F.col(c).asc() for c in line], after, True))
    added = frame(within(keys, order))
    return done(full.select("*", *[c.alias(n) for n, c in added.items()]).filter(~F.col(HALO)).drop(HALO))


_TOTAL = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_ROLL = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
_BOTH = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}
_BOTH["count"] = _BOTH["sum"]


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], **aggs: tuple[str, Column | str]) -> DataFrame:
    """Running aggregates from the start of the series: ``name=("sum" | "count" | "max" | "min", column)``."""
    exprs = {n: (f, c if isinstance(c, Column) else F.col(c)) for n, (f, c) in aggs.items()}
    cut, done = on_slices(df, keys, order)
    upto = within(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    if edgeless(cut):
        return done(cut.select("*", *[_TOTAL[f](c).over(upto).alias(n) for n, (f, c) in exprs.items()]))
    cut = settled(cut)
    totals = stretches(cut, keys, **{f"__t_{n}": _TOTAL[f](c) for n, (f, c) in exprs.items()})
    past = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    rolled = totals.select(
        SLICE, key_struct(keys).alias("__k"), "__pos0", *[_ROLL[f](f"__t_{n}").over(past).alias(f"__c_{n}") for n, (f, _) in exprs.items()],
    )
    held = resumed(cut, rolled.filter(F.col("__pos0") > 0), keys, **{f"__c_{n}": f"__c_{n}" for n in exprs})
    return done(held.select(
        *[F.col(f"`{c}`") for c in cut.columns], *[_BOTH[f](F.col(f"__c_{n}"), _TOTAL[f](c).over(upto)).alias(n) for n, (f, c) in exprs.items()],
    ))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """0-based exact position of every row in its series."""
    return running(df, keys, order, **{name: ("count", F.lit(1))}).withColumn(name, F.col(name) - 1)
