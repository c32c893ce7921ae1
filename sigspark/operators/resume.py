"""Filters whose state outlives a batch run.

A state table has one row per key: how many rows it has seen, the order of the last one, the filter's state and, for filters
that look at the newest samples, those samples. Versions are folders named by batch id: a run reads the newest version
below its own id and writes its own, so a batch that is run again gives the same rows and the same table. Keys that a
batch does not hold are carried over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.operators.filters import REGISTRY, FrameFilter, with_taps
from sigspark.operators.scan import run_scan
from sigspark.operators.series import null_safe_join, on_slices, positions
from sigspark.session import written


def versions(spark: SparkSession, path: str) -> list[int]:
    """Batch ids that have left a complete state table."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName()[6:]) for p in names if files.exists(sc._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_state(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The newest state table (of a batch id under ``below``)."""
    known = [v for v in versions(spark, path) if below is None or v < below]
    return spark.read.parquet(f"{path}/batch={known[-1]}") if known else None


def resume_filter(
    df: DataFrame, name: str, keys: Sequence[str], order: Sequence[str], path: str, batch_id: int, value: str = "value", **params,
) -> DataFrame:
    """Run the named filter on a batch, going on from the state table at ``path``, and write the next one.

    Rows at or before the last order that their key has seen are left out; ``late`` of the state table counts them. Null orders come
    before all others. Filters over neighbouring rows (window frames) keep no state.
    """
    chosen = REGISTRY[name.upper()](**params)
    if isinstance(chosen, FrameFilter):
        raise ValueError(f"{name} looks at neighbouring rows and has no state to keep")
    spark, at = df.sparkSession, F.struct(*order)
    taps = params.get("order", 8) if "taps" in chosen.inputs else 0
    saved = read_state(spark, path, batch_id)
    cut, done = on_slices(df, keys, order)
    named = cut if value == "value" else cut.withColumn("value", F.col(value))
    if saved is None:
        fresh = named
        late = named.groupBy(*keys).agg(F.lit(0).cast("long").alias("late"))
    else:
        known = null_safe_join(named, saved.select(*keys, F.col("last").alias("__last")), keys, "left")
        old = F.col("__last").isNotNull() & (at <= F.col("__last"))
        fresh = known.filter(~old).drop("__last")
        late = known.groupBy(*keys).agg(F.count(F.when(old, 1)).alias("late"))
    if taps:
        fresh = positions(with_taps(fresh, keys, order, "value", taps), keys, order, "__i")
        if saved is not None:
            fresh = null_safe_join(fresh, saved.select(*keys, F.col("recent").alias("__recent")), keys, "left")
            past = lambda j: F.coalesce(F.get("__recent", (j - F.col("__i") - 1).cast("int")), F.lit(0.0))
            lead = F.transform(F.sequence(F.lit(0), F.lit(taps - 1)), lambda j: F.when(j <= F.col("__i"), F.get("taps", j)).otherwise(past(j)))
            fresh = fresh.withColumn("taps", F.when(F.col("__i") < taps - 1, lead).otherwise(F.col("taps"))).drop("__recent")
        fresh = fresh.drop("__i")
    out = written(run_scan(fresh, chosen, keys, order, saved, True), "resumed")
    _write_state(out, late, saved, keys, order, f"{path}/batch={batch_id}", taps)
    hidden = ["__state", *(["taps"] if taps else []), *(["value"] if value != "value" else [])]
    return done(out.withColumn("residual", F.col("value") - F.col("filtered")).drop(*hidden))


def _write_state(
    out: DataFrame, late: DataFrame, saved: DataFrame | None, keys: Sequence[str], order: Sequence[str], path: str, taps: int,
) -> None:
    line = F.struct(*order)
    recent = F.slice("taps", 1, max(taps - 1, 1)) if taps else F.array().cast("array<double>")
    now = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"), F.max(line).alias("__end"))
    ends = out.filter(F.col("__state").isNotNull()).select(*keys, F.col("__state").alias("__new"), recent.alias("__recent"))
    state = null_safe_join(null_safe_join(late, now, keys, "left"), ends, keys, "left")
    if saved is None:
        state = state.select(*keys, F.coalesce("seen", F.lit(0)).alias("pos"), F.col("__end").alias("last"), F.col("__new").alias("state"), F.col("__recent").alias("recent"), "late")
    else:
        before = saved.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in ("pos", "last", "state", "recent", "late")], F.lit(True).alias("__b"))
        wide = null_safe_join(state, before, keys, "left")
        state = wide.select(
            *keys, (F.coalesce("__b_pos", F.lit(0)) + F.coalesce("seen", F.lit(0))).alias("pos"), F.coalesce("__end", "__b_last").alias("last"),
            F.coalesce("__new", "__b_state").alias("state"), F.coalesce("__recent", "__b_recent").alias("recent"),
            (F.col("late") + F.coalesce("__b_late", F.lit(0))).alias("late"))
        state = state.unionByName(null_safe_join(saved, late.select(*keys), keys, "left_anti"))
    state.write.mode("overwrite").parquet(path)
