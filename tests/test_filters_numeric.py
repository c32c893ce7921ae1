"""Designed filters and folds against direct numpy recursions."""

import numpy as np
import pandas as pd
import pytest

from sigspark.operators import design, filters

KEYS, ORDER = ["dev"], ["t"]


@pytest.fixture(scope="module")
def wave(spark):
    rng = np.random.default_rng(5)
    x = np.sin(np.arange(300) / 9) + 0.3 * rng.normal(size=300)
    return x, spark.createDataFrame(pd.DataFrame({"dev": 1, "t": np.arange(300), "value": x}))


def transfer(order, cutoff):
    """Polynomials of the same design, from its sections."""
    b, a = np.array([1.0]), np.array([1.0])
    for num, den in design.butterworth(order, cutoff):
        b, a = np.polymul(b, num), np.polymul(a, den)
    return b, a


def direct(b, a, x, settled=False):
    y, n = np.zeros(len(x)), len(b)
    past_x = np.full(n, x[0] if settled else 0.0)
    gain = b.sum() / a.sum()
    past_y = np.full(n, gain * x[0] if settled else 0.0)
    for i, v in enumerate(x):
        past_x = np.concatenate([[v], past_x[:-1]])
        y[i] = b @ past_x - a[1:] @ past_y[: n - 1]
        past_y = np.concatenate([[y[i]], past_y[:-1]])
    return y


@pytest.mark.parametrize("name,order,cutoff,settled", [
    ("LOWPASS", 4, 0.04, True), ("BANDPASS", 4, (0.01, 0.2), True), ("LOWPASS_SOS", 6, 0.2, False)])
def test_designed_filters(wave, name, order, cutoff, settled):
    x, df = wave
    got = filters.apply_filter(df, name, KEYS, ORDER).orderBy("t").toPandas()["filtered"].to_numpy()
    b, a = transfer(order, cutoff)
    assert np.allclose(got, direct(b, a, x, settled), atol=1e-5)


def test_design_magnitude():
    """Half power at the cut-off, flat at zero, and at both band edges."""
    def gain(sections, w):
        z = np.exp(1j * np.pi * w)
        return abs(np.prod([np.polyval(n[::-1], 1 / z) / np.polyval(d[::-1], 1 / z) for n, d in sections]))

    low = design.butterworth(4, 0.1)
    assert abs(gain(low, 1e-9) - 1) < 1e-6 and abs(gain(low, 0.1) - 2 ** -0.5) < 1e-9
    band = design.butterworth(4, (0.1, 0.3))
    assert abs(gain(band, 0.1) - 2 ** -0.5) < 1e-9 and abs(gain(band, 0.3) - 2 ** -0.5) < 1e-9


def test_zero_phase(spark, wave):
    x, _ = wave
    df = spark.createDataFrame([(1, x.tolist()), (2, x[:12].tolist())], "id int, samples array<double>")
    out = {r.id: np.array(r.filtered) for r in filters.zero_phase_fragments(df).collect()}
    b, a = transfer(4, 0.1)
    pad = 15
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]])
    ahead = direct(b, a, ext, True)
    want = direct(b, a, ahead[::-1], True)[::-1][pad:-pad]
    assert np.allclose(out[1], want, atol=1e-6)
    assert np.allclose(out[2], direct(b, a, x[:12]), atol=1e-8)


def test_particle_follows_the_signal(wave):
    x, df = wave
    one = filters.apply_filter(df, "PARTICLE", KEYS, ORDER).orderBy("t").toPandas()["filtered"].to_numpy()
    two = filters.apply_filter(df.repartition(7), "PARTICLE", KEYS, ORDER).orderBy("t").toPandas()["filtered"].to_numpy()
    assert np.array_equal(one, two)
    assert np.abs(one - x).mean() < 0.5 and np.isfinite(one).all()


def test_sine_with_spikes_scenario(spark):
    """Injected spikes are the only three-sigma findings."""
    from sigspark.operators import detect

    t = np.linspace(0, 2, 100)
    v = np.sin(2 * np.pi * 5 * t)
    v[20:25], v[50:55] = 9.0, -9.0
    df = spark.createDataFrame(pd.DataFrame({"dev": 1, "t": np.arange(100), "value": v}))
    rows = {r.t for r in detect.three_sigma(df, KEYS, sigmas=2.0).collect()}
    assert rows == set(range(20, 25)) | set(range(50, 55))


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_butterworth_response(order):
    """Unit gain at rest, half the power at the cutoff, nothing at the Nyquist frequency."""
    def gain(w: float) -> float:
        z = np.exp(-1j * np.pi * w) ** np.arange(3)
        return abs(np.prod([(b @ z) / (a @ z) for b, a in design.butterworth(order, 0.2)]))

    assert np.allclose([gain(0.0), gain(0.2), gain(1.0)], [1.0, np.sqrt(0.5), 0.0], atol=1e-9)
