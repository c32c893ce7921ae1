"""Gains at any length of a series against the plain recursion."""

import numpy as np
import pytest

from sigspark.operators import filters as f

N = np.arange(100_000)


@pytest.mark.parametrize("q, r, p", [(0, 0.1, 1.0), (1e-4, 0.5, 1.0), (0.01, 0.1, 1.0), (1e-9, 0.3, 2.0)])
def test_kalman_gains(q, r, p):
    got = f._kalman_gains(q, r, p)(N)
    for i in N:
        k = (p + q) / (p + q + r)
        assert got[i] == pytest.approx(k, rel=1e-9)
        p = (1 - k) * (p + q)


@pytest.mark.parametrize("forget", [1.0, 0.9999, 0.99])
def test_forgetting_gains(forget):
    got, p = f._forgetting_gains(forget, 100.0)(N), 100.0
    for i in N:
        k = p / (forget + p)
        assert got[i] == pytest.approx(k, rel=1e-9)
        p = (p - k * p) / forget


@pytest.mark.parametrize("predict, q", [(False, 0.01), (True, 0.0)])
def test_velocity_on_a_long_series(predict, q):
    n = 30_000
    x = np.where(np.arange(n) < n // 2, 0.0, 10.0)
    maps, state, p, move = f.kalman_velocity(q, 0.1, predict), np.zeros(2), np.eye(2), np.array([[1.0, 1.0], [0.0, 1.0]])
    move, noise = (move, np.eye(2) * q) if predict else (np.eye(2), np.zeros((2, 2)))
    a, b = maps.step({"pos": np.arange(n), "value": x})
    got = np.array([x[0], 0.0])
    state = got.copy()
    for i in range(1, n):
        got = a[i] @ got + b[i]
        p, state = move @ p @ move.T + noise, move @ state
        k = p[:, 0] / (p[0, 0] + 0.1)
        state = state + k * (x[i] - state[0])
        p = p - np.outer(k, p[0])
    assert got == pytest.approx(state, rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("forget", [1.0, 0.9999, 0.99])
def test_trend_sums_on_a_long_series(forget):
    n = 50_000
    scan = f.rls_trend(forget)
    cols = {"pos": np.arange(n), "value": np.linspace(0, 1, n)}
    a, _ = scan.step(cols)
    s = np.zeros(3)
    for i in range(n):
        s = np.array([1 + forget * s[0], forget * (s[1] + s[0]), forget * (s[2] + 2 * s[1] + s[0])])
    t, rho = n - 1.0, forget ** n / 1000.0
    det = s[0] * s[2] - s[1] ** 2 + rho * (s[0] + t * t * s[0] - 2 * t * s[1] + s[2]) + rho * rho
    k = np.array([(s[2] - t * s[1] + rho) / det, (s[1] + t * rho) / det])
    assert a[-1] == pytest.approx(np.eye(2) - np.outer(k, [1.0, t]), rel=1e-6, abs=1e-9)
