"""Signal filters: one registry, three shapes (window frames, prefix scans, ordered folds).

``apply_filter`` adds ``filtered`` and ``residual`` to a series; ``filter_fragments`` runs the
same filters on one array per row, restarting the state in every fragment.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.operators import design
from sigspark.operators.scan import AffineMaps, ClipMaps, Fold, Scan, run_block, run_scan
from sigspark.operators.series import on_slices, running, with_rows

# Filter taps and biquad coefficients.
FIR_TAPS = (0.05, 0.1, 0.2, 0.3, 0.2, 0.1, 0.05)
SMOOTH_TAPS = (-3.0, 12.0, 17.0, 12.0, -3.0)
BUTTERWORTH_B = (0.020083365564211225, 0.04016673112842245, 0.020083365564211225)
BUTTERWORTH_A = (-1.5610180758007182, 0.6413515380575631)
CHEBYSHEV_B = (0.0183, 0.0366, 0.0183)
CHEBYSHEV_A = (-1.500, 0.580)


@dataclass(frozen=True)
class FrameFilter:
    """A filter that is a function of nearby rows."""

    before: int
    after: int
    column: Callable[[str, WindowSpec], Column]


# ---- window filters -------------------------------------------------------------------------

def _trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def _full(v: str, w: WindowSpec, n: int, smooth: Column) -> Column:
    """``smooth`` once n samples have been seen, the sample itself before."""
    return F.when(F.count(F.lit(1)).over(_trailing(w, n)) < n, F.col(v)).otherwise(smooth)


def mean(size: int = 10) -> FrameFilter:
    return FrameFilter(size - 1, 0, lambda v, w: F.avg(v).over(_trailing(w, size)))


def median(size: int = 10) -> FrameFilter:
    def column(v: str, w: WindowSpec) -> Column:
        held = F.array_sort(F.collect_list(v).over(_trailing(w, size)))
        return F.element_at(held, (F.floor(F.size(held) / 2) + 1).cast("int"))

    return FrameFilter(size - 1, 0, column)


def gaussian(size: int = 10, sigma: float = 2.0) -> FrameFilter:
    kernel = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    taps = [k / sum(kernel) for k in kernel]
    return FrameFilter(size - 1, 0, lambda v, w: _full(v, w, size, _taps(v, w, taps[::-1])))


def _taps(v: str, w: WindowSpec, taps: Sequence[float], missing: float = 0.0) -> Column:
    """Weighted sum of the newest samples, newest first."""
    total = F.lit(0.0)
    for i, t in enumerate(taps):
        total = total + F.lit(t) * F.coalesce(F.lag(v, i).over(w) if i else F.col(v), F.lit(missing))
    return total


def fir(taps: Sequence[float] = FIR_TAPS) -> FrameFilter:
    return FrameFilter(len(taps) - 1, 0, lambda v, w: _taps(v, w, taps))


def morphology(size: int = 5) -> FrameFilter:
    def column(v: str, w: WindowSpec) -> Column:
        frame = _trailing(w, size)
        return (F.min(v).over(frame) + F.max(v).over(frame)) / 2

    return FrameFilter(size - 1, 0, column)


def bilateral(size: int = 10, sigma_space: float = 2.0, sigma_range: float = 0.5) -> FrameFilter:
    def column(v: str, w: WindowSpec) -> Column:
        top, bottom = F.lit(0.0), F.lit(0.0)
        for i in range(size):
            past = F.lag(v, i).over(w) if i else F.col(v)
            gap = past - F.col(v)
            weight = F.exp(F.lit(-(i * i) / (2 * sigma_space ** 2)) - gap * gap / (2 * sigma_range ** 2))
            top = top + F.coalesce(weight * past, F.lit(0.0))
            bottom = bottom + F.coalesce(weight, F.lit(0.0))
        return top / bottom

    return FrameFilter(size - 1, 0, column)


def smooth_polynomial() -> FrameFilter:
    taps = [t / 35.0 for t in SMOOTH_TAPS]
    return FrameFilter(4, 0, lambda v, w: _full(v, w, 5, _taps(v, w, taps[::-1])))


def wiener(size: int = 10, noise: float = 0.1) -> FrameFilter:
    def column(v: str, w: WindowSpec) -> Column:
        frame = _trailing(w, size)
        mu, spread = F.avg(v).over(frame), F.greatest(F.var_pop(v).over(frame), F.lit(noise))
        return _full(v, w, size, mu + (spread - noise) / spread * (F.col(v) - mu))

    return FrameFilter(size - 1, 0, column)


def moving_average(size: int = 20) -> FrameFilter:
    """Centred mean that divides by ``size`` at the edges too."""
    back, ahead = size // 2, (size - 1) // 2
    return FrameFilter(back, ahead, lambda v, w: F.sum(v).over(w.rowsBetween(-back, ahead)) / size)


# ---- gain filters: y += k(position) * (x - y) -----------------------------------------------

Gains = Callable[[np.ndarray], np.ndarray]                    # positions from 0 to gains


def _kalman_gains(q: float, r: float, p0: float) -> Gains:
    """Gain at any position in closed form. Without noise the precision grows by 1 / r a step; with noise the variance
    p -> r (p + q) / (p + q + r) nears its positive fixed point by a constant factor of (p - high) / (p - low)."""
    root = np.sqrt(q * q + 4 * q * r)
    high, low = (root - q) / 2, (-root - q) / 2

    def at(n: np.ndarray) -> np.ndarray:
        n = n.astype(float)
        if q == 0:
            return p0 / (p0 * (n + 1) + r)
        near = (p0 - high) / (p0 - low) * ((r - high) / (r - low)) ** n
        ahead = (high - near * low) / (1 - near) + q
        return ahead / (ahead + r)

    return at


def _forgetting_gains(forget: float, p0: float) -> Gains:
    """Gain of scalar least squares: the inverse of the covariance is a geometric sum."""

    def at(n: np.ndarray) -> np.ndarray:
        n = n.astype(float)
        kept = forget ** n
        total = n if forget == 1 else -np.expm1(n * np.log(forget)) / (1 - forget)
        return 1 / (forget * (kept / p0 + total) + 1)

    return at


def _after(first: Sequence[float], then: Gains) -> Gains:
    """Given gains at the first positions, then those of ``then`` from its start."""
    head = np.asarray(first, dtype=float)

    def at(n: np.ndarray) -> np.ndarray:
        late = then(np.maximum(n - len(head), 0))
        return np.where(n < len(head), head[np.minimum(n, len(head) - 1)], late)

    return at


def gain_scan(gains: Gains) -> Scan:
    def at(cols):
        return gains(np.asarray(cols["pos"]))

    def step(cols):
        k = at(cols)
        return (1 - k)[:, None, None], (k * cols["value"])[:, None]

    return Scan(
        AffineMaps(1), step, lambda cols: (at(cols) * cols["value"])[:, None],
        lambda prev, cur, cols: {"filtered": cur[:, 0]},
    )


def iir(alpha: float = 0.1) -> Scan:
    return gain_scan(_after([1.0], lambda n: np.full(n.shape, alpha)))


def kalman(q: float = 1e-5, r: float = 0.1, p0: float = 1.0) -> Scan:
    return gain_scan(_after([1.0], _kalman_gains(q, r, p0)))


def kalman_zero_start(q: float = 0.001, r: float = 0.1, p0: float = 1.0) -> Scan:
    return gain_scan(_kalman_gains(q, r, p0))


def kalman_mean_start(q: float = 1e-5, r: float = 0.1, p0: float = 1.0, warmup: int = 10) -> Scan:
    return gain_scan(_after([1.0 / (i + 1) for i in range(max(1, warmup))], _kalman_gains(q, r, p0)))


def kalman_level(q: float = 1e-3, r: float = 1e-2) -> Scan:
    """Level model of the gateway contract: first output is the first sample, unit start variance."""
    return gain_scan(_after([1.0], _kalman_gains(q, r, 1.0)))


def rls_scalar(forget: float = 0.99, p0: float = 100.0) -> Scan:
    return gain_scan(_forgetting_gains(forget, p0))


# ---- matrix scans ---------------------------------------------------------------------------

def kalman_velocity(q: float = 0.01, r: float = 0.1, predict: bool = True) -> Scan:
    """Level and velocity; adds velocity, innovation, uncertainty and gain."""
    move = np.array([[1.0, 1.0], [0.0, 1.0]]) if predict else np.eye(2)
    noise = np.eye(2) * (q if predict else 0.0)
    p, gains, spread = [np.eye(2)], [np.array([1.0, 0.0])], [1.0]

    def at(cols) -> tuple[np.ndarray, np.ndarray]:
        """Gains and level variance by position: closed form without prediction, else the recursion until it settles."""
        n = np.asarray(cols["pos"])
        if not predict:
            before = r / (r + np.maximum(n - 1, 0))
            k = np.where(n > 0, before / (before + r), 1.0)
            return np.stack([k, 0 * k], axis=1), np.where(n > 0, r / (r + n), 1.0)
        while len(gains) <= n.max(initial=0) and not (len(gains) > 2 and np.array_equal(gains[-1], gains[-2])):
            ahead = move @ p[0] @ move.T + noise
            k = ahead[:, 0] / (ahead[0, 0] + r)
            p[0] = ahead - np.outer(k, ahead[0])
            gains.append(k)
            spread.append(p[0][0, 0])
        n = np.minimum(n, len(gains) - 1)
        return np.array(gains)[n], np.array(spread)[n]

    def step(cols):
        k, _ = at(cols)
        keep = np.eye(2) - np.stack([k, np.zeros_like(k)], axis=2)
        return keep @ move, k * cols["value"][:, None]

    def emit(prev, cur, cols):
        ahead = prev @ move.T
        first = cols["pos"] == 0
        k, variance = at(cols)
        return {
            "filtered": cur[:, 0], "velocity": cur[:, 1],
            "innovation": np.where(first, 0.0, cols["value"] - ahead[:, 0]),
            "uncertainty": np.sqrt(variance),
            "gain": np.where(first, np.nan, k[:, 0]),
        }

    return Scan(
        AffineMaps(2), step, lambda cols: np.stack([cols["value"], 0 * cols["value"]], axis=1), emit,
        outputs=("filtered", "velocity", "innovation", "uncertainty", "gain"),
    )


def rls_trend(forget: float = 0.99, delta: float = 1000.0) -> Scan:
    """Recursive least squares on (1, position); the covariance is a function of the position.

    With age sums ``Sk = sum(age**k * forget**age)`` the normal matrix needs no data. The sums of long series are put
    together from blocks of positions: those of an older block are shifted and damped, all terms are positive.
    """
    block, rows, (a, b, c) = 4096, [(0.0, 0.0, 0.0)], (0.0, 0.0, 0.0)
    for _ in range(block):
        a, b, c = 1 + forget * a, forget * (b + a), forget * (c + 2 * b + a)
        rows.append((a, b, c))
    near, whole = np.array(rows), [np.zeros(3)]

    def older(s: np.ndarray, age: np.ndarray) -> np.ndarray:
        s0, s1, s2 = np.moveaxis(s, -1, 0)
        damped = forget ** age
        return np.stack([damped * s0, damped * (s1 + age * s0), damped * (s2 + 2 * age * s1 + age * age * s0)], axis=-1)

    def sums(n: np.ndarray) -> np.ndarray:
        blocks, rest = np.divmod(n, block)
        while len(whole) <= blocks.max(initial=0):
            whole.append(whole[-1] + older(near[block], np.float64(block * (len(whole) - 1))))
        return np.array(whole)[blocks] + older(near[rest], (blocks * block).astype(float))

    def gains(cols):
        t = cols["pos"].astype(float)
        lam = forget
        z = lam ** (t + 1)
        s0, s1, s2 = sums(np.asarray(cols["pos"]).astype(np.int64) + 1).T
        rho = z / delta
        det = s0 * s2 - s1 * s1 + rho * (s0 + t * t * s0 - 2 * t * s1 + s2) + rho * rho
        k = np.stack([(s2 - t * s1 + rho) / det, (s1 + t * rho) / det], axis=1)
        return k, np.stack([np.ones_like(t), t], axis=1), (t * t * s0 - 2 * t * s1 + s2 + rho) / det, (s0 + rho) / det

    def step(cols):
        k, phi, _, _ = gains(cols)
        return np.eye(2) - k[:, :, None] * phi[:, None, :], k * cols["value"][:, None]

    def emit(prev, cur, cols):
        _, phi, p00, p11 = gains(cols)
        return {"filtered": (cur * phi).sum(axis=1), "level": cur[:, 0], "trend": cur[:, 1], "p00": p00, "p11": p11}

    return Scan(
        AffineMaps(2), step, lambda cols: gains(cols)[0] * cols["value"][:, None], emit,
        outputs=("filtered", "level", "trend", "p00", "p11"),
    )


def linear(space: design.StateSpace, steady_start: bool = False) -> Scan:
    """Time-invariant filter from a state space; starts at rest or settled on the first sample."""
    settled = space.steady() if steady_start else np.zeros(len(space.b))

    def step(cols):
        n = len(cols["value"])
        return np.broadcast_to(space.a, (n, *space.a.shape)), cols["value"][:, None] * space.b

    def before(cols):
        return cols["value"][:, None] * settled

    return Scan(
        AffineMaps(len(space.b)), step, lambda cols: before(cols) @ space.a.T + cols["value"][:, None] * space.b,
        lambda prev, cur, cols: {"filtered": prev @ space.c + space.d * cols["value"]},
        before_first=before,
    )


def _fixed_biquad(b: Sequence[float], a: Sequence[float]) -> Scan:
    return linear(design.cascade([(np.array(b), np.array([1.0, *a]))]))


def butterworth_fixed() -> Scan:
    return _fixed_biquad(BUTTERWORTH_B, BUTTERWORTH_A)


def chebyshev_fixed() -> Scan:
    return _fixed_biquad(CHEBYSHEV_B, CHEBYSHEV_A)


def bandpass_sections(rate: float = 2e6, low: float = 1e5, high: float = 9e5) -> Scan:
    """High-pass section, then low-pass section."""
    return linear(design.cascade([design.rbj_section("high", rate, low), design.rbj_section("low", rate, high)]))


def biquad_repeated(rate: float = 1e6, low: float = 1e4, high: float = 5e5, order: int = 4) -> Scan:
    """The same centre section order/2 times."""
    return linear(design.cascade([design.centre_section(rate, low, high)] * (order // 2)))


def lowpass(cutoff: float = 1000.0, rate: float = 50000.0, order: int = 4) -> Scan:
    return linear(design.cascade(design.butterworth(order, min(cutoff / (rate / 2), 0.99))), steady_start=True)


def bandpass(low: float = 100.0, high: float = 5000.0, rate: float = 50000.0, order: int = 4) -> Scan:
    band = (max(low / (rate / 2), 0.01), min(high / (rate / 2), 0.99))
    return linear(design.cascade(design.butterworth(order, band)), steady_start=True)


def lowpass_sos(cutoff: float = 10000.0, rate: float = 100000.0, order: int = 6) -> Scan:
    return linear(design.cascade(design.butterworth(order, cutoff / (rate / 2))))


def notch(freq: float = 50.0, mu: float = 0.01) -> Scan:
    """Adaptive notch on ``ts_ms``; the output is what the two reference waves do not explain."""
    def refs(cols):
        angle = 2 * math.pi * freq * (cols["ts_ms"] / 1000.0)
        return np.stack([np.sin(angle), np.cos(angle)], axis=1)

    def step(cols):
        r = refs(cols)
        return np.eye(2) - 2 * mu * r[:, :, None] * r[:, None, :], 2 * mu * cols["value"][:, None] * r

    return Scan(
        AffineMaps(2), step, lambda cols: step(cols)[1],
        lambda prev, cur, cols: {"filtered": cols["value"] - (prev * refs(cols)).sum(axis=1)},
        inputs=("value", "ts_ms"),
    )


def lms(order: int = 8, mu: float = 0.01, normalised: bool = False, eps: float = 1e-6) -> Scan:
    """Least mean squares on the newest ``order`` samples (``taps``), predicting the newest one.

    The weights move by an affine map of themselves, so this too is a scan.
    """
    def rate(x):
        return mu / ((x * x).sum(axis=1) + eps) if normalised else np.full(len(x), mu)

    def step(cols):
        x = cols["taps"]
        g = 2 * rate(x)[:, None] * x
        return np.eye(order) - g[:, :, None] * x[:, None, :], g * x[:, :1]

    return Scan(
        AffineMaps(order), step, lambda cols: step(cols)[1],
        lambda prev, cur, cols: {"filtered": (prev * cols["taps"]).sum(axis=1)},
        inputs=("taps",),
    )


def nlms(order: int = 8, mu: float = 0.1, eps: float = 1e-6) -> Scan:
    return lms(order, mu, True, eps)


def wavelet(threshold: float = 0.5) -> Scan:
    """Soft threshold on the step from the previous output, i.e. a clip around the sample."""
    return Scan(
        ClipMaps(), lambda cols: ((cols["value"] - threshold)[:, None], (cols["value"] + threshold)[:, None]),
        lambda cols: cols["value"][:, None],
        lambda prev, cur, cols: {"filtered": cur[:, 0]},
    )


# ---- folds ----------------------------------------------------------------------------------

def sign_lms(order: int = 8, mu: float = 0.01) -> Fold:
    """Sign-error update towards ``desired``; adds the error and the norm of the weights."""
    def step(w, row, pos):
        x, want = row
        y = sum(a * b for a, b in zip(w, x))
        err = want - y
        move = mu if err > 0 else -mu
        w = [a + move * b for a, b in zip(w, x)]
        return w, (y, err, math.sqrt(sum(a * a for a in w)))

    return Fold(lambda key: [0.0] * order, step, ("taps", "desired"), ("filtered", "error", "weight_norm"))


def log_nlms(order: int = 8, mu: float = 0.001, eps: float = 0.01) -> Fold:
    """Normalised update with a step that grows with the log of the squared error."""
    def step(w, row, pos):
        x, want = row
        y = sum(a * b for a, b in zip(w, x))
        err = want - y
        power = 10 * err * err
        rate = mu * math.log10(power) / (eps + math.sqrt(sum(b * b for b in x))) if power > 0 else 0.0
        w = [a + rate * err * b for a, b in zip(w, x)]
        return w, (y, err, math.sqrt(sum(a * a for a in w)))

    return Fold(lambda key: [0.0] * order, step, ("taps", "desired"), ("filtered", "error", "weight_norm"))


def particle(count: int = 50, process: float = 0.1, measure_noise: float = 0.5, seed: int = 7) -> Fold:
    """Bootstrap filter with systematic resampling; draws depend on the key and position only."""
    def initial(key):
        text = ":".join(str(int(k)) if isinstance(k, float) and k.is_integer() else str(k) for k in key)
        return [float(zlib.crc32(text.encode()))]

    def step(state, row, pos):
        value = row[0]
        rng = np.random.default_rng([seed, int(state[0]), pos])
        cloud = np.array(state[1:]) if len(state) > 1 else value + rng.standard_normal(count) * measure_noise
        cloud = cloud + rng.standard_normal(count) * process
        weight = np.exp(-((value - cloud) ** 2) / (2 * measure_noise ** 2))
        weight = weight / weight.sum() if weight.sum() > 0 else np.full(count, 1 / count)
        estimate = float((cloud * weight).sum())
        at = np.searchsorted(np.cumsum(weight), (rng.random() + np.arange(count)) / count)
        return [state[0], *cloud[np.minimum(at, count - 1)].tolist()], (estimate,)

    return Fold(initial, step)


# ---- registry -------------------------------------------------------------------------------

Filter = FrameFilter | Scan | Fold

REGISTRY: dict[str, Callable[..., Filter]] = {
    "MEAN": mean, "MEDIAN": median, "GAUSSIAN": gaussian, "FIR": fir, "IIR": iir,
    "MORPHOLOGY": morphology, "BILATERAL": bilateral, "SG_SMOOTH": smooth_polynomial, "WIENER": wiener,
    "WAVELET": wavelet, "KALMAN": kalman, "EKF": kalman, "UKF": kalman,
    "KALMAN_ZERO": kalman_zero_start, "KALMAN_MEAN": kalman_mean_start, "KALMAN_LEVEL": kalman_level,
    "KALMAN_VELOCITY": kalman_velocity, "LMS": lms, "NLMS": nlms, "SIGN_LMS": sign_lms, "LOG_NLMS": log_nlms,
    "RLS": rls_scalar, "RLS_TREND": rls_trend, "BUTTERWORTH": butterworth_fixed, "CHEBYSHEV": chebyshev_fixed,
    "BANDPASS_SECTIONS": bandpass_sections, "BIQUAD_REPEATED": biquad_repeated, "LOWPASS": lowpass,
    "BANDPASS": bandpass, "LOWPASS_SOS": lowpass_sos, "MOVING_AVERAGE": moving_average,
    "ADAPTIVE_NOTCH": notch, "PARTICLE": particle,
}
_TAPPED = {"LMS", "NLMS", "SIGN_LMS", "LOG_NLMS"}


def register_filter(name: str, build: Callable[..., Filter]) -> None:
    """Add a filter to the registry (plug-in point)."""
    REGISTRY[name.upper()] = build


def rising(df: DataFrame, keys: Sequence[str], order: Sequence[str], sequence: str) -> DataFrame:
    """Rows whose sequence number is above all earlier ones of their key, with ``dropped``, how many were left out so far.

    A null number does not rise."""
    cut, done = on_slices(df, keys, order)
    seen = running(cut, keys, order, __top=("max", sequence))
    before = with_rows(seen, keys, order, lambda w: {"__before": F.lag("__top").over(w)}, before=1)
    up = F.col(sequence).isNotNull() & (F.col("__before").isNull() | (F.col(sequence) > F.col("__before")))
    counted = running(before.withColumn("__up", up), keys, order, dropped=("sum", F.when(F.col("__up"), 0).otherwise(1)))
    return done(counted.filter("__up").drop("__top", "__before", "__up"))


def repeated_single(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value", stages: int = 2, **band: float,
) -> DataFrame:
    """``BIQUAD_REPEATED`` in single precision: each stage is a scan of its own whose output is rounded."""
    cut, done = on_slices(df, keys, order)
    out = cut.withColumn("__raw", F.col(value)).withColumn("value", F.col(value))
    for _ in range(stages):
        out = run_scan(out, biquad_repeated(order=2, **band), keys, order)
        out = out.withColumn("filtered", F.col("filtered").cast("float").cast("double")).withColumn("value", F.col("filtered"))
    kept = out.withColumn("residual", F.col("__raw") - F.col("filtered")).withColumn("value", F.col("__raw")).drop("__raw")
    return done(kept if value == "value" else kept.drop("value"))


def with_taps(df: DataFrame, keys, order, value: str, count: int) -> DataFrame:
    """Add ``taps``: the newest ``count`` samples, newest first, zeros before the start."""
    def frame(w):
        past = [F.coalesce(F.lag(value, i).over(w), F.lit(0.0)) for i in range(1, count)]
        return {"taps": F.array(F.col(value), *past)}

    return with_rows(df, keys, order, frame, before=count - 1)


def with_delayed(df: DataFrame, keys, order, value: str, k: int) -> DataFrame:
    """Add ``desired``: the signal k samples ago, zeros before the start."""
    return with_rows(df, keys, order, lambda w: {"desired": F.coalesce(F.lag(value, k).over(w), F.lit(0.0))}, before=k)


def apply_filter(
    df: DataFrame, name: str, keys: Sequence[str], order: Sequence[str], value: str = "value",
    unknown: str = "pass", **params,
) -> DataFrame:
    """Run the named filter along every series; unknown names pass through or use ``unknown``."""
    name = name.upper()
    if name not in REGISTRY:
        if unknown == "pass":
            return df.withColumn("filtered", F.col(value)).withColumn("residual", F.lit(0.0))
        name = unknown.upper()
    chosen = REGISTRY[name](**params)
    cut, done = on_slices(df, keys, order)
    if isinstance(chosen, FrameFilter):
        out = with_rows(cut, keys, order, lambda w: {"filtered": chosen.column(value, w)}, chosen.before, chosen.after)
        return done(out.withColumn("residual", F.col(value) - F.col("filtered")))
    renamed = value != "value"
    ready = cut.withColumn("value", F.col(value)) if renamed else cut
    if name in _TAPPED:
        ready = with_taps(ready, keys, order, "value", params.get("order", 8))
    out = run_scan(ready, chosen, keys, order).withColumn("residual", F.col("value") - F.col("filtered"))
    drop = (["taps"] if name in _TAPPED else []) + (["value"] if renamed else [])
    return done(out.drop(*drop))


# ---- fragments ------------------------------------------------------------------------------

def _fragment_runner(scan: Scan, samples: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            arrays = [np.asarray(a, dtype=float) if a is not None else np.zeros(0) for a in pdf[samples]]
            good = [len(a) > 0 and bool(np.isfinite(a).all()) for a in arrays]
            used = [a for a, g in zip(arrays, good) if g]
            outs: list = []
            if used:
                sizes = [len(a) for a in used]
                pos = np.concatenate([np.arange(n) for n in sizes])
                cols = {"value": np.concatenate(used), "pos": pos}
                if "taps" in scan.inputs:
                    d = scan.maps.dim
                    cols["taps"] = np.concatenate([
                        np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(d - 1), a]), d)[:, ::-1]
                        for a in used
                    ])
                prev, cur, _ = run_block(scan, cols, pos == 0, np.zeros(scan.maps.dim))
                flat = scan.emit(prev, cur, cols)["filtered"]
                outs = np.split(flat, np.cumsum(sizes)[:-1])
            done, results = iter(outs), []
            for a, g in zip(pdf[samples], good):
                results.append(next(done).tolist() if g else a)
            yield pdf.assign(filtered=results, status=["ok" if g else "error" for g in good])

    return run


def filter_fragments(df: DataFrame, name: str, samples: str = "samples", **params) -> DataFrame:
    """Filter one array per row; state restarts per row, so there is no shuffle.

    A fragment that cannot be filtered (missing or non-finite samples) keeps its raw signal and
    gets ``status = 'error'``; callers may route those rows to a dead-letter table instead.
    """
    chosen = REGISTRY[name.upper()](**params)
    if not isinstance(chosen, Scan):
        raise ValueError(f"{name} has no fragment form")
    schema = T.StructType([*df.schema.fields, T.StructField("filtered", T.ArrayType(T.DoubleType())), T.StructField("status", T.StringType())])
    return df.mapInPandas(_fragment_runner(chosen, samples), schema)


def zero_phase_fragments(df: DataFrame, samples: str = "samples", order: int = 4, cutoff: float = 0.1) -> DataFrame:
    """Forward-backward low-pass per fragment; 15 samples or fewer run forward only."""
    space = design.cascade(design.butterworth(order, cutoff))
    pad = 3 * (order + 1)

    @F.pandas_udf("array<double>")
    def smooth(col: pd.Series) -> pd.Series:
        out: list = [None] * len(col)
        by_len: dict[int, list[int]] = {}
        for i, a in enumerate(col):
            by_len.setdefault(0 if a is None else len(a), []).append(i)
        for n, rows in by_len.items():
            if n == 0:
                continue
            x = np.array([np.asarray(col.iloc[i], dtype=float) for i in rows])
            y = design.zero_phase(space, x, pad) if n > 15 else design.run(space, x, np.zeros((len(x), len(space.b))))
            for i, row in zip(rows, y):
                out[i] = row.tolist()
        return pd.Series(out, dtype=object)

    return df.withColumn("filtered", smooth(F.col(samples).cast("array<double>")))


def fit_line(df: DataFrame, keys: Sequence[str], index: str, value: str, model: str = "trend", ridge: float = 0.0) -> DataFrame:
    """Least squares level or trend per fragment in closed form: one aggregation."""
    t, y = F.col(index).cast("double"), F.col(value)
    sums = df.groupBy(*keys).agg(
        F.count(y).alias("n"), F.sum(t).alias("st"), F.sum(t * t).alias("stt"),
        F.sum(y).alias("sy"), F.sum(t * y).alias("sty"),
    )
    if model == "level":
        return sums.select(*keys, (F.col("sy") / (F.col("n") + ridge)).alias("level"), F.lit(0.0).alias("trend"))
    a, d = F.col("n") + F.lit(float(ridge)), F.col("stt") + F.lit(float(ridge))
    det = a * d - F.col("st") * F.col("st")
    return sums.select(
        *keys,
        ((F.col("sy") * d - F.col("sty") * F.col("st")) / det).alias("level"),
        ((F.col("sty") * a - F.col("st") * F.col("sy")) / det).alias("trend"),
    )


def melt_channels(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Wide channels to one row per (sample, channel), ready for the same filter with channel in the key."""
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in channels])
    return df.withColumn("__c", F.explode(pairs)).select(*[c for c in df.columns if c not in channels], "__c.*")
