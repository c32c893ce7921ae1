"""The nine burst features as a grouped aggregate with partial states, callable from SQL.

``burst_partial(index, value)`` turns a stretch of a series into a state, ``burst_merge(state)`` joins the states of a
series in any order, ``burst_final(state, rate)`` reads the features:

    SELECT dev, burst_final(burst_merge(part), 2e6D) AS b
    FROM (SELECT dev, burst_partial(i, value) AS part FROM samples GROUP BY dev, i DIV 65536) GROUP BY dev

The feature threshold is a share of the final peak, which no stretch knows: a state keeps the places and magnitudes of the
samples at or over that share of its own peak, and a merge drops those under the share of the higher peak. Means and third
powers are central moments, merged without subtraction of large sums. ``index`` numbers the samples of a series
without gaps; null values count as no sample.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

RATIO = 0.25
FEATURES = ("amplitude", "energy", "area", "skewness", "rise_time", "hit_duration", "counts", "ra", "af")
_EPS = 1e-15
_HEAD = struct.Struct("<q5d")


def state_of(index: np.ndarray, value: np.ndarray) -> bytes:
    """State of some samples: n, mean, second and third central sums, sums of squares and magnitudes, high samples."""
    real = ~np.isnan(value)
    index, value = index[real].astype(np.int64), value[real].astype(float)
    mean = float(value.mean()) if len(value) else 0.0
    gap = value - mean
    return _pack(len(value), mean, float((gap ** 2).sum()), float((gap ** 3).sum()), float((value ** 2).sum()), float(np.abs(value).sum()), index, np.abs(value))


def _pack(n: int, mean: float, m2: float, m3: float, squares: float, sizes: float, at: np.ndarray, mags: np.ndarray) -> bytes:
    high = mags >= mags.max() * RATIO if len(mags) else np.zeros(0, bool)
    return _HEAD.pack(n, mean, m2, m3, squares, sizes) + at[high].astype("<i8").tobytes() + mags[high].astype("<f8").tobytes()


def _unpack(state: bytes) -> tuple:
    half = (len(state) - _HEAD.size) // 2
    at = np.frombuffer(state, "<i8", half // 8, _HEAD.size)
    return *_HEAD.unpack_from(state), at, np.frombuffer(state, "<f8", half // 8, _HEAD.size + half)


def merged(states: list[bytes]) -> bytes:
    n, mean, m2, m3, squares, sizes = 0, 0.0, 0.0, 0.0, 0.0, 0.0
    places, mags = [np.zeros(0, np.int64)], [np.zeros(0)]
    for k, mu, b2, b3, sq, size, at, mag in map(_unpack, states):
        if k:
            total, gap = n + k, mu - mean
            m3 += b3 + gap ** 3 * n * k * (n - k) / total ** 2 + 3 * gap * (n * b2 - k * m2) / total
            m2 += b2 + gap * gap * n * k / total
            mean, n = mean + gap * k / total, total
        squares, sizes = squares + sq, sizes + size
        places.append(at)
        mags.append(mag)
    return _pack(n, mean, m2, m3, squares, sizes, np.concatenate(places), np.concatenate(mags))


def features(state: bytes, rate: float) -> tuple:
    """Values of ``FEATURES``; nulls without samples."""
    n, _, m2, m3, squares, sizes, at, mags = _unpack(state)
    if not n:
        return (None,) * len(FEATURES)
    order = np.argsort(at, kind="stable")
    at, mags, dt = at[order], mags[order], 1.0 / rate
    peak, sigma = float(mags.max()), float(np.sqrt(m2 / n))
    rise, duration = float(at[int(np.argmax(mags))] - at[0]) * dt, float(at[-1] - at[0]) * dt
    counts = 1 + int((np.diff(at) > 1).sum())
    return (
        peak, squares, sizes * dt, m3 / n / sigma ** 3 if sigma > _EPS else 0.0, rise, duration, counts,
        rise / peak if peak > _EPS else 0.0, counts / duration if duration > _EPS else 0.0,
    )


def register(spark: SparkSession) -> None:
    """Make ``burst_partial``, ``burst_merge`` and ``burst_final`` callable from SQL."""
    @F.pandas_udf("binary")
    def burst_partial(index: pd.Series, value: pd.Series) -> bytes:
        return state_of(index.to_numpy(), value.to_numpy(dtype=float))

    @F.pandas_udf("binary")
    def burst_merge(state: pd.Series) -> bytes:
        return merged(list(state))

    @F.pandas_udf(", ".join(f"{c} {'long' if c == 'counts' else 'double'}" for c in FEATURES))
    def burst_final(state: pd.Series, rate: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([features(s, r) for s, r in zip(state, rate)], columns=FEATURES)
        return out.astype({"counts": "Int64"})

    for name, fn in (("burst_partial", burst_partial), ("burst_merge", burst_merge), ("burst_final", burst_final)):
        spark.udf.register(name, fn)
