"""Window operators over keyed series; every frame works on long keys (see ``series``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.operators.restart import restart_windows
from sigspark.operators.series import null_safe_join, on_slices, positions, running, settled, with_rows


def trailing_totals(df: DataFrame, keys, order: str, width: int, **values: Column) -> DataFrame:
    """``df`` with ``<name>_sum`` (null if there is no value) and ``<name>_n`` of each value over ``[t - width, t]``.

    Time is tiled by ``width``: a frame is the part of its own tile up to t and the part of the tile before from t - width on. Every
    row is dealt twice, to its own tile and, at the time t + width when it leaves the frames, to the next one. So both parts
    are running sums, forwards over own and backwards over lent rows, each in its own order: one shuffle, a cost that does
    not depend on the width, and nothing is subtracted. ``order`` is an integer column; rows of equal
    time are peers; rows without a time make up a frame of their own.
    """
    t, size = F.col(order).cast("long"), max(int(width), 1)
    staged = df.select("*", (t - F.pmod(t, F.lit(size))).alias("__tile"), t.alias("__at"), *[c.alias(f"__v_{n}") for n, c in values.items()])
    place = lambda own, row, at: F.struct(F.lit(own).alias("own"), row.alias("tile"), at.alias("at"))
    own, lent = place(True, F.col("__tile"), F.col("__at")), place(False, F.col("__tile") + size, F.col("__at") + int(width))
    both = staged.withColumn("__p", F.explode(F.when(t.isNull(), F.array(own)).otherwise(F.array(own, lent))))
    keep = [c for c in df.columns if c not in keys]
    dealt = both.select(
        *keys, F.col("__p.tile").alias("__tile"), F.col("__p.at").alias("__at"), F.col("__p.own").alias("__own"),
        *[F.when(F.col("__p.own"), F.col(f"`{c}`")).alias(c) for c in keep], *[f"__v_{n}" for n in values],
    )
    upto = Window.partitionBy(*keys, "__tile").orderBy("__at")
    ahead = Window.partitionBy(*keys, "__tile").orderBy(F.col("__at").desc())      # from the far end: a frame that only shrinks is summed anew for every row
    mine = lambda n, own: F.when(F.col("__own") if own else ~F.col("__own"), F.col(f"__v_{n}"))
    met = dealt.select(
        "*", *[f(mine(n, True)).over(upto).alias(f"__{a}_{n}_own") for n in values for a, f in (("s", F.sum), ("c", F.count))],
        *[f(mine(n, False)).over(ahead).alias(f"__{a}_{n}_old") for n in values for a, f in (("s", F.sum), ("c", F.count))],
    ).filter("__own")
    added = lambda n: F.coalesce(F.col(f"{n}_old") + F.col(f"{n}_own"), f"{n}_own", f"{n}_old")
    return met.select(
        *df.columns, *[added(f"__s_{n}").alias(f"{n}_sum") for n in values], *[added(f"__c_{n}").alias(f"{n}_n") for n in values],
    )


def trailing_power(df: DataFrame, keys, order: str, width: int, raw="value", filtered="filtered") -> DataFrame:
    """Mean power of raw, filtered and residual over ``[t - width, t]`` plus the row count."""
    sq = lambda c: (c * c).cast("double")
    parts = {"raw": F.col(raw), "filtered": F.col(filtered), "residual": F.col(raw) - F.col(filtered)}
    totals = trailing_totals(df, keys, order, width, **{f"__{n}": sq(c) for n, c in parts.items()}, __rows=F.lit(1))
    mean = lambda n: F.when(F.col(f"__{n}_n") > 0, F.col(f"__{n}_sum") / F.col(f"__{n}_n"))
    return totals.select(*df.columns, *[mean(n).alias(f"{n}_power") for n in parts], F.col("__rows_n").alias("n"))


def successive_difference(df: DataFrame, keys, order, value="value") -> DataFrame:
    return with_rows(df, keys, order, lambda w: {"diff": F.col(value) - F.lag(value).over(w)}, before=1)


def last_n(df: DataFrame, keys, order, n: int, **aggs: Column) -> DataFrame:
    """Aggregates over the newest n rows."""
    return with_rows(df, keys, order, lambda w: {k: c.over(w.rowsBetween(1 - n, 0)) for k, c in aggs.items()}, before=n - 1)


def resetting_energy(df: DataFrame, keys, order, width: int, value="residual") -> DataFrame:
    """Energy accumulated since the window opened; the window restarts when it is older than ``width``."""
    cut, done = on_slices(df, keys, order)
    marked = restart_windows(cut, keys, order, width)
    return done(running(marked, [*keys, "window_start"], order, energy=("sum", F.col(value) * F.col(value))))


def running_counters(df: DataFrame, keys, order, flag: Column) -> DataFrame:
    return running(df, keys, order, processed=("count", F.lit(1)), anomalies=("sum", F.when(flag, 1).otherwise(0)))


def streak(df: DataFrame, keys, order, flag: Column) -> DataFrame:
    """Length of the run of flagged rows ending at each row (0 when not flagged)."""
    cut, done = on_slices(df, keys, order)
    placed = positions(cut.withColumn("__flag", flag), keys, order, "__pos")
    held = running(placed, keys, order, __gap=("max", F.when(~F.col("__flag"), F.col("__pos"))))
    return done(held.withColumn("streak", F.col("__pos") - F.coalesce("__gap", F.lit(-1))).drop("__flag", "__pos", "__gap"))


def runs(df: DataFrame, keys, day: str) -> DataFrame:
    """Runs of consecutive days: first day, last day and length (gaps and islands)."""
    days = df.select(*keys, F.datediff(F.col(day), F.lit("1970-01-01")).alias("__d")).distinct()
    placed = positions(days, keys, ["__d"], "__pos")
    to_day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), c)
    return (
        placed.groupBy(*keys, (F.col("__d") - F.col("__pos")).alias("__run"))
        .agg(to_day(F.min("__d")).alias("first_day"), to_day(F.max("__d")).alias("last_day"), F.count(F.lit(1)).alias("days"))
        .drop("__run")
    )


def local_spread(df: DataFrame, keys, order, value="residual", points: int | None = None) -> DataFrame:
    """Standard deviation of ``[i - w, i + w)`` with w = min(10, n / 10); with ``points`` for that many first rows only."""
    sizes = df.groupBy(*keys).agg(F.least(F.lit(10), F.floor(F.count(F.lit(1)) / 10)).cast("int").alias("__w"))
    cut, done = on_slices(df, keys, order)
    placed = positions(null_safe_join(cut, sizes, keys, "left"), keys, order, "i")
    if points is not None:
        placed = placed.filter(F.col("i") < points + 9)        # nine rows ahead are in reach

    def frame(w):
        by_width = F.when(F.col("__w") < 2, F.lit(None))
        for k in range(2, 11):
            by_width = by_width.when(F.col("__w") == k, F.stddev_pop(value).over(w.rowsBetween(-k, k - 1)))
        return {"spread": by_width}

    spread = done(with_rows(placed, keys, order, frame, 10, 9).drop("__w"))
    return spread if points is None else spread.filter(F.col("i") < points)


def rank_by(df: DataFrame, metric: str, tie: Sequence[str], name: str = "rank", method: str = "row_number") -> DataFrame:
    """Global descending rank without gathering the table in one task."""
    flipped = df.withColumn("__neg", -F.col(metric))
    placed = positions(flipped, [], ["__neg", *tie], name).withColumn(name, F.col(name) + 1)
    if method == "rank":
        firsts = placed.groupBy(metric).agg(F.min(name).alias("__first"))
        placed = null_safe_join(placed, firsts, [metric], "left").withColumn(name, F.col("__first")).drop("__first")
    return placed.drop("__neg")


def latest(df: DataFrame, keys, order: Sequence[str]) -> DataFrame:
    """Newest row per key by a map-side-combined maximum."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return top.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def decimate(df: DataFrame, keys, order, max_points: int, keep: Column | None = None) -> DataFrame:
    """Every k-th row with k = max(1, n / max_points), plus all rows where ``keep`` holds."""
    df = settled(df)
    stride = df.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / max_points)).alias("__k"))
    placed = null_safe_join(positions(df, keys, order, "__pos"), stride, keys, "left")
    wanted = F.col("__pos") % F.col("__k") == 0
    return placed.filter(wanted if keep is None else wanted | keep).drop("__pos", "__k")


def rolling_stats(df: DataFrame, keys, order, value: str, size: int = 50, least: int = 20) -> DataFrame:
    """Rolling mean and spread of |value| and its z-score, once ``least`` rows are present."""
    mag = F.abs(F.col(value))

    def frame(w):
        f = w.rowsBetween(1 - size, 0)
        enough = F.count(F.lit(1)).over(f) >= least
        mu, sd = F.avg(mag).over(f), F.stddev_pop(mag).over(f)
        return {"roll_mean": F.when(enough, mu), "roll_std": F.when(enough, sd), "z": F.when(enough, (mag - mu) / (sd + 1e-10))}

    return with_rows(df, keys, order, frame, before=size - 1)


def average_jump(df: DataFrame, keys, order, value: str, size: int = 50) -> DataFrame:
    """Mean absolute step between neighbours inside the newest ``size`` rows (1 for a single row)."""
    cut, done = on_slices(df, keys, order)
    stepped = with_rows(cut, keys, order, lambda w: {"jump": F.abs(F.col(value) - F.lag(value).over(w))}, before=1)
    return done(with_rows(
        stepped, keys, order,
        lambda w: {"avg_jump": F.coalesce(F.avg("jump").over(w.rowsBetween(2 - size, 0)), F.lit(1.0))}, before=size - 2,
    ))


def sequence_report(df: DataFrame, keys, arrival, seq: str) -> DataFrame:
    """Per key: repeats, late arrivals and missing sequence numbers."""
    cut, _ = on_slices(df, keys, arrival)
    seen = running(cut, keys, arrival, __top=("max", F.col(seq)))
    late = with_rows(seen, keys, arrival, lambda w: {"__before": F.lag("__top").over(w)}, before=1)
    return late.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"),
        F.sum(F.when(F.col(seq) < F.col("__before"), 1).otherwise(0)).alias("out_of_order"),
        (F.count(F.lit(1)) - F.countDistinct(seq)).alias("repeats"),
        (F.max(seq) - F.min(seq) + 1 - F.countDistinct(seq)).alias("missing"),
    )
