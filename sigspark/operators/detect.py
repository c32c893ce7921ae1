"""Anomaly detectors: per fragment (array expressions), per series (two aggregations), per sample (windows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.operators import features as fx
from sigspark.operators import filters, windows
from sigspark.operators.aggregates import exact_percentile
from sigspark.operators.series import null_safe_join, on_slices, positions, running, settled, sliced, with_rows

# Severity weights used by the overall score.
SEVERITY = {"CRITICAL": 1.0, "ERROR": 0.8, "WARNING": 0.5, "INFO": 0.2}


# ---- fragments ------------------------------------------------------------------------------

def _finding(kind: Column, level: Column, score: Column, count: Column) -> Column:
    return F.struct(kind.alias("type"), level.alias("level"), score.alias("score"), count.alias("points"))


def residual_finding(raw: str, filtered: str, sigmas: float = 2.0) -> Column:
    """Share of residuals outside sigmas x std; null when at most 0.2 % of the points are."""
    def judge(m: Column) -> Column:
        points = F.size(F.filter(m["a"], lambda x: F.abs(x - m["mean"]) > m["std"] * sigmas))

        def rate(k: Column) -> Column:
            share = k / m["n"]
            level = F.when(share < 0.01, "WARN").otherwise("ERROR")
            return F.when(
                (m["n"] > 0) & (m["std"] >= 1e-10) & (share > 0.002),
                _finding(F.lit("RESIDUAL_ANOMALY"), level, F.least(F.lit(1.0), share * 50), k),
            )

        return fx.let(points, rate)

    return fx.let(fx.moments(fx.minus(F.col(raw), F.col(filtered))), judge)


def sudden_finding(samples: str, sigmas: float = 3.5) -> Column:
    """Steps outside sigmas x std of all steps."""
    def judge(m: Column) -> Column:
        limit = m["std"] * sigmas
        out = F.filter(m["a"], lambda x: F.abs(x - m["mean"]) > limit)
        return fx.let(out, lambda o: F.when(
            (m["n"] >= 9) & (m["std"] >= 1e-10) & (F.size(o) > 0),
            _finding(
                F.lit("SUDDEN_CHANGE"), F.when(F.size(o) < 3, "WARN").otherwise("ERROR"),
                F.least(F.lit(1.0), F.array_max(F.transform(o, F.abs)) / (limit * 2)), F.size(o),
            ),
        ))

    return fx.let(fx.moments(fx.diffs(F.col(samples))), judge)


def extreme_finding(samples: str, sigmas: float = 3.0) -> Column:
    """A minimum or maximum more than 1.5 x sigmas away from the mean."""
    def judge(m: Column) -> Column:
        z = F.greatest((F.array_max(m["a"]) - m["mean"]) / m["std"], (m["mean"] - F.array_min(m["a"])) / m["std"])
        return F.when(
            (m["n"] >= 10) & (m["std"] > 1e-10) & (z > sigmas * 1.5),
            _finding(F.lit("EXTREME_VALUE"), F.lit("WARN"), F.least(F.lit(1.0), z / (sigmas * 3)), F.lit(1)),
        )

    return fx.let(fx.moments(F.col(samples)), judge)


def fragment_findings(df: DataFrame, raw: str = "samples", filtered: str = "filtered") -> DataFrame:
    """All stateless findings of a fragment as one array column; no shuffle."""
    found = F.array(residual_finding(raw, filtered), sudden_finding(raw), extreme_finding(raw))
    return df.withColumn("findings", F.filter(found, lambda x: x.isNotNull()))


def drift_findings(df: DataFrame, keys, order, samples: str = "samples", alpha: float = 0.01, sigmas: float = 3.0) -> DataFrame:
    """Mean and spread of each fragment against their slow history (which already includes it)."""
    std = fx.array_std(F.col(samples))
    stats = df.filter(F.size(samples) > 0).select(
        *dict.fromkeys([*keys, *order]), F.size(samples).alias("__size"), fx.array_mean(F.col(samples)).alias("current_mean"), std.alias("current_std"),
        F.when(std < 1e-10, 1.0).otherwise(std).alias("__hist_std"),
    )
    one = filters.apply_filter(sliced(stats, keys, order), "IIR", keys, order, "current_mean", alpha=alpha).withColumnRenamed("filtered", "history_mean").drop("residual")
    two = filters.apply_filter(one, "IIR", keys, order, "__hist_std", alpha=alpha).withColumnRenamed("filtered", "history_std").drop("residual")
    seen = positions(two, keys, order, "__i")
    mean_dev = F.abs(F.col("current_mean") - F.col("history_mean")) / F.col("history_std")
    std_dev = F.abs(F.col("current_std") - F.col("history_std")) / F.col("history_std")
    ready = (F.col("__i") + 1 > 10) & (F.col("__size") >= 10)
    label = lambda d: F.when(ready & (d > sigmas), F.when(d < 6, "WARN").otherwise("ERROR"))
    return seen.select(
        *dict.fromkeys([*keys, *order]), "current_mean", "current_std", "history_mean", "history_std",
        mean_dev.alias("mean_deviation"), std_dev.alias("std_deviation"),
        label(mean_dev).alias("mean_level"), label(std_dev).alias("std_level"),
    )


def energy_frequency(df: DataFrame, samples: str = "samples", rate: float = 1e6) -> DataFrame:
    """Band filter, RMS through a sigmoid, upper-half spectrum share; the mean of both is the score."""
    clean = filters.filter_fragments(df, "BIQUAD_REPEATED", samples, rate=rate)
    scored = fx.spectrum(clean, "filtered").withColumn("energy_level", fx.sigmoid_energy(fx.rms(F.col("filtered"))))
    scored = scored.withColumn("frequency_score", fx.high_share())
    failed = F.col("status") == "error"
    for c in ("energy_level", "frequency_score"):
        scored = scored.withColumn(c, F.when(failed, 0.0).otherwise(F.col(c)))
    scored = scored.withColumn("anomaly_score", (F.col("energy_level") + F.col("frequency_score")) / 2)
    kind = (
        F.when(failed, "ERROR").when(F.col("anomaly_score") <= 0.75, "NORMAL").when(F.col("energy_level") > 0.8, "HIGH_ENERGY")
        .when(F.col("frequency_score") > 0.8, "FREQUENCY_ANOMALY").otherwise("MIXED_ANOMALY")
    )
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > 0.75).withColumn("anomaly_type", kind).drop("magnitudes", "filtered", "status")


# ---- series ---------------------------------------------------------------------------------

def three_sigma(df: DataFrame, keys, value="value", sigmas: float = 3.0) -> DataFrame:
    """Samples outside mean +- sigmas x std, with the bounds."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    joined = null_safe_join(df, stats, keys, "left")
    low, high = F.col("__m") - sigmas * F.col("__s"), F.col("__m") + sigmas * F.col("__s")
    return joined.withColumn("low", low).withColumn("high", high).filter((F.col(value) > F.col("high")) | (F.col(value) < F.col("low"))).drop("__m", "__s")


def amplitude_findings(df: DataFrame, keys, value="value") -> DataFrame:
    stats = df.groupBy(*keys).agg(F.count(value).alias("__n"))
    out = three_sigma(df, keys, value).groupBy(*keys).agg(F.count(F.lit(1)).alias("points"))
    level = F.when(F.col("points") > F.col("__n") * 0.1, "ERROR").otherwise("WARNING")
    return null_safe_join(out, stats, keys, "inner").select(*keys, F.lit("AMPLITUDE").alias("type"), level.alias("severity"), "points")


def trend_breaks(df: DataFrame, keys, order, value="value") -> DataFrame:
    """Jumps of the moving average (min(10, n / 4) samples) above mean + 2 std of all its jumps."""
    sizes = df.groupBy(*keys).agg(F.count(value).alias("__n"))
    sizes = sizes.withColumn("__w", F.least(F.lit(10), F.floor(F.col("__n") / 4)).cast("int")).filter(F.col("__n") >= 10)
    cut, done = on_slices(df, keys, order)
    placed = positions(null_safe_join(cut, sizes, keys, "inner"), keys, order, "i")

    def frame(w):
        avg = F.lit(None).cast("double")
        for k in range(2, 11):
            avg = F.when(F.col("__w") == k, F.avg(value).over(w.rowsBetween(1 - k, 0))).otherwise(avg)
        return {"__ma": F.when(F.col("i") >= F.col("__w") - 1, avg)}

    averaged = with_rows(placed, keys, order, frame, before=9)
    moved = with_rows(averaged, keys, order, lambda w: {"change": F.abs(F.col("__ma") - F.lag("__ma").over(w))}, before=1)
    limits = moved.groupBy(*keys).agg((F.avg("change") + 2 * F.stddev_pop("change")).alias("threshold"))
    hit = null_safe_join(moved, limits, keys, "inner").filter(F.col("change") > F.col("threshold"))
    at = F.col("i") - F.col("__w") + 1 + F.floor(F.col("__w") / 2)
    return done(hit.withColumn("at", at.cast("long")).drop("__n", "__w", "__ma", "i"))


def trend_findings(df: DataFrame, keys, order, value="value") -> DataFrame:
    out = trend_breaks(df, keys, order, value).groupBy(*keys).agg(F.count(F.lit(1)).alias("points"))
    level = F.when(F.col("points") > 3, "WARNING").otherwise("INFO")
    return out.select(*keys, F.lit("TREND").alias("type"), level.alias("severity"), "points")


def crossing_rate(df: DataFrame, keys, order, value="value") -> DataFrame:
    marked = with_rows(df, keys, order, lambda w: {"__x": ((F.col(value) >= 0) != (F.lag(value).over(w) >= 0)).cast("int")}, before=1)
    return marked.groupBy(*keys).agg((F.coalesce(F.sum("__x"), F.lit(0)) / F.count(F.lit(1))).alias("crossing_rate"))


def frequency_findings(df: DataFrame, keys, order, value="value", low: float = 0.01, high: float = 0.5) -> DataFrame:
    out = crossing_rate(df, keys, order, value).filter((F.col("crossing_rate") > high) | (F.col("crossing_rate") < low))
    return out.select(*keys, F.lit("FREQUENCY").alias("type"), F.lit("INFO").alias("severity"), F.lit(1).cast("long").alias("points"))


def quality_findings(df: DataFrame, keys, raw="value", filtered="filtered") -> DataFrame:
    out = fx.power_ratio(df, keys, raw, filtered).filter(F.col("ratio_db") < -10)
    return out.select(*keys, F.lit("SIGNAL_QUALITY").alias("type"), F.lit("WARNING").alias("severity"), F.lit(1).cast("long").alias("points"))


def overall(findings: DataFrame, keys) -> DataFrame:
    """Mean severity weight (at most 1) and the heaviest severity of each series."""
    weight = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])[F.col("severity")]
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("findings"), F.least(F.avg(weight), F.lit(1.0)).alias("score"),
        F.max_by("severity", weight).alias("level"),
    )


def health_check(df: DataFrame, keys, order, raw="value", filtered="filtered") -> DataFrame:
    """All series-level findings with their overall score."""
    cut = sliced(df, keys, order)
    found = amplitude_findings(cut, keys, raw)
    for part in (trend_findings(cut, keys, order, raw), frequency_findings(cut, keys, order, raw), quality_findings(cut, keys, raw, filtered)):
        found = found.unionByName(part)
    return overall(found, keys)


# ---- samples --------------------------------------------------------------------------------

def energy_threshold(
    df: DataFrame, keys, order: Sequence[str], width: int, threshold: float, mode: str = "residual",
) -> DataFrame:
    """Trailing-window energy against a threshold with a running anomaly count.

    ``residual`` and ``raw`` sum the squares in the window, ``raw_mean`` averages them.
    """
    cut, done = on_slices(df, keys, order)
    powers = windows.trailing_power(cut, keys, order[0], width)
    energy = {
        "residual": F.col("residual_power") * F.col("n"), "raw": F.col("raw_power") * F.col("n"), "raw_mean": F.col("raw_power"),
    }[mode]
    flagged = powers.withColumn("energy", energy).withColumn("anomaly", F.col("energy") > threshold)
    return done(running(flagged, keys, order, anomaly_count=("sum", F.col("anomaly").cast("int"))))


def automatic_threshold(df: DataFrame, keys, value="value", factor: float = 5.0) -> DataFrame:
    return df.groupBy(*keys).agg((F.avg(F.col(value) * F.col(value)) * factor).alias("threshold"))


def history_analysis(
    df: DataFrame, keys, order: Sequence[str], width: int, factor: float = 1.5, percent: float = 95.0,
    max_points: int | None = None, filter_name: str = "KALMAN_MEAN",
) -> DataFrame:
    """Filter, energy in restarting windows, percentile threshold; with ``max_points`` thinned but for the anomalies."""
    cut, done = on_slices(df, keys, order)
    smooth = filters.apply_filter(cut, filter_name, keys, order)
    energy = settled(windows.resetting_energy(smooth, keys, order, width))
    limits = exact_percentile(energy, keys, "energy", percent, order).withColumn("threshold", F.col("percentile") * factor).drop("percentile")
    starts = df.groupBy(*keys).agg(F.min(order[0]).alias("__t0"))
    judged = null_safe_join(null_safe_join(energy, limits, keys, "left"), starts, keys, "left")
    judged = judged.withColumn("anomaly", F.col("energy") > F.col("threshold"))
    judged = judged.withColumn("seconds", (F.col(order[0]) - F.col("__t0")) / 1e6)
    judged = judged.withColumn("anomaly_type", F.when(F.col("anomaly"), "energy_spike"))
    if max_points is not None:
        judged = windows.decimate(judged, keys, order, max_points, F.col("anomaly"))
    return done(judged.drop("__t0", "window_start"))


def residual_zscore(df: DataFrame, keys, order, size: int = 50, least: int = 20, sigmas: float = 3.0, reset: bool = False) -> DataFrame:
    """Alarms on a velocity-Kalman track: innovation z-score, then jump, then uncertainty.

    ``consecutive`` counts alarms since the start of the series; with ``reset`` it counts since the
    last quiet sample and the uncertainty test is reachable.
    """
    cut, done = on_slices(df, keys, order)
    track = filters.apply_filter(cut, "KALMAN_VELOCITY", keys, order, predict=False)
    mag = F.abs(F.col("innovation"))
    track = with_rows(track, keys, order, lambda w: {"jump": F.abs(F.col("filtered") - F.lag("filtered").over(w))}, before=1)

    def frame(w):
        f = w.rowsBetween(1 - size, 0)
        return {
            "__n": F.count(F.lit(1)).over(f), "__m": F.avg(mag).over(f), "__s": F.stddev_pop(mag).over(f),
            "__j": F.avg("jump").over(w.rowsBetween(2 - size, 0)),
        }

    rolled = with_rows(track, keys, order, frame, before=size - 1)
    z = (mag - F.col("__m")) / (F.col("__s") + 1e-10)
    high, leap, vague = z > sigmas, F.col("jump") > F.col("__j") * 4, F.col("uncertainty") > F.col("__m") * 2
    kind = F.when(high, "RESIDUAL_ANOMALY").when(leap, "SUDDEN_CHANGE")
    score = F.when(high, F.least(z / sigmas, F.lit(1.0))).when(leap, F.least(F.col("jump") / (F.col("__j") * 4), F.lit(1.0)))
    if reset:
        kind = kind.when(vague, "UNCERTAINTY_HIGH")
        score = score.when(vague, F.least(F.col("uncertainty") / (F.col("__m") * 2), F.lit(1.0)))
    enough = F.col("__n") >= least
    judged = rolled.withColumn("z", z).withColumn("type", F.when(enough, kind)).withColumn("score", F.when(enough, score))
    if reset:
        judged = windows.streak(judged, keys, order, F.col("type").isNotNull()).withColumnRenamed("streak", "consecutive")
    else:
        judged = running(judged, keys, order, consecutive=("count", F.col("type")))
    level = F.when(F.col("consecutive") >= 3, "ERROR").when(F.col("score") > 0.7, "WARN").otherwise("INFO")
    return done(judged.filter(F.col("type").isNotNull()).withColumn("level", level).drop("__n", "__m", "__s", "__j"))


def capped(df: DataFrame, keys, order: Sequence[Column], cap: int) -> DataFrame:
    """At most ``cap`` findings per run (newest rule of ``order`` first), with the full count of the run."""
    top = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn("__k", F.row_number().over(top)).filter(F.col("__k") <= cap).drop("__k")
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return null_safe_join(kept, totals, keys, "inner")
