"""Signal features and quality metrics: on fragments (one array per row) and on long series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.operators.series import null_safe_join, with_rows


# ---- array expressions ----------------------------------------------------------------------

def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def moments(arr: Column) -> Column:
    """The array with its size, mean and population spread, for use with ``let``."""
    return let(arr, lambda a: F.struct(a.alias("a"), F.size(a).alias("n"), array_mean(a).alias("mean"), array_std(a).alias("std")))


def total(arr: Column, of=lambda x: x) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + of(x))


def array_mean(arr: Column, of=lambda x: x) -> Column:
    return total(arr, of) / F.size(arr)


def array_std(arr: Column) -> Column:
    """Population standard deviation around the mean."""
    return F.aggregate(
        arr,
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")),
        lambda a, x: F.struct(
            (a["n"] + 1).alias("n"),
            (a["mean"] + (x - a["mean"]) / (a["n"] + 1)).alias("mean"),
            (a["m2"] + (x - a["mean"]) * (x - a["mean"]) * a["n"] / (a["n"] + 1)).alias("m2"),
        ),
        lambda a: F.sqrt(a["m2"] / F.greatest(a["n"], F.lit(1.0))),
    )


def rms(arr: Column) -> Column:
    return F.sqrt(array_mean(arr, lambda x: x * x))


def sigmoid_energy(energy: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-energy / 50.0 + 2.0))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def diffs(arr: Column) -> Column:
    """Successive differences of an array."""
    head = F.slice(arr, 1, F.greatest(F.size(arr) - 1, F.lit(0)))
    return F.when(F.size(arr) > 1, minus(F.slice(arr, 2, F.greatest(F.size(arr) - 1, F.lit(0))), head)).otherwise(F.slice(arr, 1, 0))


def to_db(signal: Column, noise: Column) -> Column:
    """Power ratio in dB; no noise gives +inf, no signal the smallest double."""
    return (
        F.when(noise <= 0, F.lit(float("inf")))
        .when(signal <= 0, F.lit(-1.7976931348623157e308))
        .otherwise(10 * F.log10(signal / noise))
    )


def clipped_db(signal: Column, noise: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), 10 * F.log10(signal / noise)))


# ---- burst features -------------------------------------------------------------------------

_EPS = 1e-15


def _burst_columns(n, amp, peak, s1, s2, sabs, cubed, first, last, counts, dt: float) -> dict[str, Column]:
    sigma = F.sqrt(F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0)))
    rise = F.when(peak >= first, (peak - first) * dt).otherwise(0.0)
    duration = (last - first) * dt
    return {
        "amplitude": amp, "energy": s2, "area": sabs * dt,
        "skewness": F.when(sigma > _EPS, cubed / n / (sigma * sigma * sigma)).otherwise(0.0),
        "rise_time": rise, "hit_duration": duration, "counts": counts,
        "ra": F.when(amp > _EPS, rise / amp).otherwise(0.0),
        "af": F.when(duration > _EPS, counts / duration).otherwise(0.0),
    }


def burst_features_array(df: DataFrame, samples: str = "samples", rate: float = 2e6, ratio: float = 0.25) -> DataFrame:
    """Acoustic-emission features of one fragment per row; no shuffle."""
    v = F.col(samples)
    names = list(_burst_columns(*[F.lit(0)] * 10, 1.0))

    def measured(a: Column) -> Column:
        mags = F.transform(a, F.abs)
        return F.struct(a.alias("v"), F.size(a).alias("n"), mags.alias("abs"), F.array_max(mags).alias("amp"), array_mean(a).alias("mean"))

    def marked(m: Column) -> Column:
        return F.struct(m.alias("m"), F.transform(m["abs"], lambda x: x >= m["amp"] * ratio).alias("above"))

    def described(t: Column) -> Column:
        m, above = t["m"], t["above"]
        edges = F.filter(above, lambda x, i: x & ((i == 0) | ~F.get(above, i - 1)))
        cols = _burst_columns(
            m["n"], m["amp"], F.array_position(m["abs"], m["amp"]) - 1,
            total(m["v"]), total(m["v"], lambda x: x * x), total(m["abs"]), total(m["v"], lambda x: F.pow(x - m["mean"], 3)),
            F.array_position(above, F.lit(True)) - 1, m["n"] - F.array_position(F.reverse(above), F.lit(True)), F.size(edges), 1.0 / rate,
        )
        return F.struct(*[c.alias(k) for k, c in cols.items()])

    out = let(let(let(v, measured), marked), described)
    return df.filter(F.size(v) > 0).select("*", out.alias("__b")).select(*df.columns, *[F.col(f"__b.{k}").alias(k) for k in names])


def burst_features(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], index: str, value: str = "value",
    rate: float = 2e6, ratio: float = 0.25,
) -> DataFrame:
    """The same features for series of any length: two aggregations and one edge window.

    ``index`` is the 0-based sample number (see ``series.positions``).
    """
    v, mag = F.col(value), F.abs(F.col(value))
    base = df.groupBy(*keys).agg(
        F.max(mag).alias("__amp"), F.avg(v).alias("__mean"), F.min_by(F.col(index), F.struct(-mag, F.col(index))).alias("__peak"),
    )
    joined = null_safe_join(df, base, keys, "left").withColumn("__above", mag >= F.col("__amp") * ratio)
    marked = with_rows(
        joined, keys, order,
        lambda w: {"__edge": F.col("__above") & ~F.coalesce(F.lag("__above").over(w), F.lit(False))}, before=1,
    )
    sums = marked.groupBy(*keys).agg(
        F.count(v).alias("__n"), F.first("__amp").alias("__amp"), F.first("__peak").alias("__peak"),
        F.sum(v).alias("__s1"), F.sum(v * v).alias("__s2"), F.sum(mag).alias("__sabs"),
        F.sum(F.pow(v - F.col("__mean"), 3)).alias("__cubed"),
        F.min(F.when(F.col("__above"), F.col(index))).alias("__first"),
        F.max(F.when(F.col("__above"), F.col(index))).alias("__last"),
        F.sum(F.col("__edge").cast("int")).alias("__counts"),
    )
    cols = _burst_columns(*[F.col(c) for c in (
        "__n", "__amp", "__peak", "__s1", "__s2", "__sabs", "__cubed", "__first", "__last", "__counts")], 1.0 / rate)
    return sums.select(*keys, *[c.alias(k) for k, c in cols.items()])


def burst_alarm(df: DataFrame, amplitude: float = 0.009, energy: float = 0.005, counts: float = 72) -> DataFrame:
    """First threshold reached in the order amplitude, energy, counts, with a level from the overshoot."""
    tests = [("amplitude", amplitude), ("energy", energy), ("counts", counts)]
    kind, level = F.lit(""), F.lit(0)
    for name, limit in reversed(tests):
        c = F.col(name)
        steps = F.when(c >= limit * 1.67, 3).when(c >= limit * 1.33, 2).otherwise(1)
        kind, level = F.when(c >= limit, F.lit(name)).otherwise(kind), F.when(c >= limit, steps).otherwise(level)
    return df.withColumn("error_type", kind).withColumn("alert_level", level).withColumn("is_error", (F.col("alert_level") > 0).cast("int"))


# ---- signal to noise ------------------------------------------------------------------------

def snr_after(df: DataFrame, keys, raw="value", filtered="filtered", quiet: float | None = 60.0, low=-20.0, high=60.0) -> DataFrame:
    """Filtered power against residual power; under 1e-10 noise it is ``quiet``, or floored when None."""
    noise = F.avg((F.col(raw) - F.col(filtered)) * (F.col(raw) - F.col(filtered)))
    powers = df.groupBy(*keys).agg(F.avg(F.col(filtered) * F.col(filtered)).alias("__s"), noise.alias("__n"))
    floored = clipped_db(F.col("__s"), F.greatest("__n", F.lit(1e-10)), low, high)
    out = floored if quiet is None else F.when(F.col("__n") < 1e-10, F.lit(quiet)).otherwise(clipped_db(F.col("__s"), F.col("__n"), low, high))
    return powers.select(*keys, out.alias("snr_after"))


def snr_before(
    df: DataFrame, keys, order, value="value", quiet: float | None = 30.0, low=0.0, high=40.0, least: int = 100,
) -> DataFrame:
    """Noise estimated against a centred mean of min(50, n / 10) samples; short series give 10 dB."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    sizes = sizes.withColumn("__w", F.least(F.lit(50), F.floor(F.col("__rows") / 10)).cast("int"))
    back, ahead = F.floor(F.col("__w") / 2), F.floor((F.col("__w") - 1) / 2)

    def frame(w):
        held = F.collect_list(value).over(w.rowsBetween(-25, 24))
        seen = F.count(F.lit(1)).over(w.rowsBetween(-25, -1))
        start = F.greatest(seen - back, F.lit(0))
        part = F.slice(held, (start + 1).cast("int"), (seen + ahead + 1 - start).cast("int"))
        return {"__smooth": F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.col("__w")}

    usable = (F.col("__rows") >= least) & (F.col("__w") >= 3)
    smooth = with_rows(null_safe_join(df, sizes.filter(usable), keys, "inner"), keys, order, frame, before=25, after=24)
    gap = F.col(value) - F.col("__smooth")
    powers = smooth.groupBy(*keys).agg(F.avg(F.col("__smooth") * F.col("__smooth")).alias("__s"), F.avg(gap * gap).alias("__n"))
    if quiet is None:
        db = clipped_db(F.col("__s"), F.greatest("__n", F.lit(1e-10)), low, high)
    else:
        db = F.when(F.col("__n") < 1e-10, F.lit(quiet)).otherwise(clipped_db(F.col("__s"), F.col("__n"), low, high))
    known = powers.select(*keys, db.alias("__db"))
    return null_safe_join(sizes, known, keys, "left").select(*keys, F.coalesce("__db", F.lit(10.0)).alias("snr_before"))


def windowed_snr(df: DataFrame) -> DataFrame:
    """dB columns from the powers of ``windows.trailing_power``."""
    before, after = to_db(F.col("raw_power"), F.col("residual_power")), to_db(F.col("filtered_power"), F.col("residual_power"))
    return df.withColumn("snr_before", before).withColumn("snr_after", after).withColumn("snr_delta", F.col("snr_after") - F.col("snr_before"))


def power_ratio(df: DataFrame, keys, raw="value", filtered="filtered", direction: str = "filtered/raw") -> DataFrame:
    """Power ratio in dB; ``direction`` picks which signal is on top."""
    sq = lambda c: F.avg(F.col(c) * F.col(c))
    top, bottom = (sq(filtered), sq(raw)) if direction == "filtered/raw" else (sq(raw), sq(filtered))
    powers = df.groupBy(*keys).agg(top.alias("__t"), bottom.alias("__b"))
    return powers.select(*keys, F.when(F.col("__b") == 0, 0.0).otherwise(10 * F.log10(F.col("__t") / F.col("__b"))).alias("ratio_db"))


def quality_label(ratio: Column) -> Column:
    return (
        F.when(ratio > 10, "excellent").when(ratio > 5, "good").when(ratio > 0, "fair")
        .when(ratio > -5, "poor").otherwise("bad")
    )


# ---- spectrum -------------------------------------------------------------------------------

def spectrum(df: DataFrame, samples: str = "samples") -> DataFrame:
    """Magnitudes of the first half of the transform, zero-padded to a power of two."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list = [None] * len(pdf)
            by_len: dict[int, list[int]] = {}
            for i, a in enumerate(pdf[samples]):
                by_len.setdefault(0 if a is None else len(a), []).append(i)
            for n, rows in by_len.items():
                size = 1 << (n - 1).bit_length() if n else 0
                if n == 0:
                    mags = np.zeros((len(rows), 0))
                else:
                    block = np.array([np.asarray(pdf[samples].iloc[i], dtype=float) for i in rows])
                    mags = np.abs(np.fft.rfft(block, size, axis=1))[:, : size // 2]
                for i, m in zip(rows, mags):
                    out[i] = m.tolist()
            yield pdf.assign(magnitudes=out)

    schema = T.StructType([*df.schema.fields, T.StructField("magnitudes", T.ArrayType(T.DoubleType()))])
    return df.mapInPandas(run, schema)


def high_share(magnitudes: str = "magnitudes") -> Column:
    """Share of the upper half of the spectrum."""
    m = F.col(magnitudes)
    half = F.floor(F.size(m) / 2).cast("int")
    whole = total(m)
    upper = total(F.slice(m, half + 1, F.greatest(F.size(m) - half, F.lit(0))))
    return F.when((F.size(m) == 0) | (whole == 0), 0.0).otherwise(F.least(upper / whole, F.lit(1.0)))


def crossing_frequency(df: DataFrame, keys, order, value="value", rate: float = 100_000.0) -> DataFrame:
    """Zero crossings / 2 / duration with the summary of the signal."""
    marked = with_rows(df, keys, order, lambda w: {"__x": (F.signum(value) != F.lag(F.signum(value)).over(w)).cast("int")}, before=1)
    return marked.groupBy(*keys).agg(
        (F.coalesce(F.sum("__x"), F.lit(0)) / 2 / (F.count(F.lit(1)) / rate)).alias("frequency"),
        F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
    )


def reference_metrics(df: DataFrame, keys, clean: str, noisy: str, filtered: str) -> DataFrame:
    """Error against a clean channel before and after filtering, gain in percent and correlations."""
    mse = lambda c: F.avg((F.col(c) - F.col(clean)) * (F.col(c) - F.col(clean)))
    out = df.groupBy(*keys).agg(
        mse(noisy).alias("mse_before"), mse(filtered).alias("mse_after"),
        F.corr(clean, noisy).alias("corr_before"), F.corr(clean, filtered).alias("corr_after"),
    )
    return out.withColumn("improvement", (F.col("mse_before") - F.col("mse_after")) / F.col("mse_before") * 100)


def channel_summary(df: DataFrame, keys, value="value", time="us") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        (F.max(time) - F.min(time)).alias("length_us"),
    )


def throughput(df: DataFrame, keys, time="us", now_us: int | None = None, sample_bytes: int = 16) -> DataFrame:
    """Samples per second, MB per second and, with ``now_us``, the delay of the newest sample."""
    span = F.greatest((F.max(time) - F.min(time)) / 1e6, F.lit(0.001))
    cols = [F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / span).alias("per_second"),
            (F.count(F.lit(1)) / span * sample_bytes / 1048576.0).alias("mb_per_second")]
    if now_us is not None:
        cols.append(((F.lit(now_us) - F.max(time)) / 1000.0).alias("delay_ms"))
    return df.groupBy(*keys).agg(*cols)


def fragment_report(df: DataFrame, samples: str = "samples", filtered: str = "filtered", points: int | None = None, gaps: int | None = None) -> DataFrame:
    """Arrays, statistics and error of a filtered fragment; ``points`` and ``gaps`` trim signals and residuals."""
    o, f = F.col(samples), F.col(filtered)
    trim = lambda arr, n: arr if n is None else F.slice(arr, 1, n)
    gap = minus(o, f)
    noise, power = array_mean(gap, lambda x: x * x), array_mean(f, lambda x: x * x)
    after = F.when(noise < 1e-10, 60.0).otherwise(clipped_db(power, noise, -20.0, 60.0))
    return df.filter(F.size(o) > 0).select(
        *[c for c in df.columns if c not in (samples, filtered)],
        trim(o, points).alias("original"), trim(f, points).alias("filtered"), trim(gap, gaps).alias("residuals"),
        F.struct(
            F.array_min(o).alias("min"), F.array_max(o).alias("max"), array_mean(o).alias("avg"),
            rms(o).alias("rms"), rms(f).alias("filtered_rms"), F.size(o).alias("samples"),
        ).alias("statistics"),
        F.round(after, 2).alias("snr_after"), array_mean(gap, F.abs).alias("current_error"),
    )
