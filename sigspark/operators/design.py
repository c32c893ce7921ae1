"""Digital filter design: Butterworth prototypes by the bilinear transform, as state-space cascades."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Section = tuple[np.ndarray, np.ndarray]      # (b0 b1 b2), (1 a1 a2)


@dataclass(frozen=True)
class StateSpace:
    """``s' = A s + B x``, ``y = C s + D x``."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float

    def steady(self) -> np.ndarray:
        """State reached under a constant unit input."""
        return np.linalg.solve(np.eye(len(self.b)) - self.a, self.b)


def rbj_section(kind: str, rate: float, cutoff: float) -> Section:
    """Second-order Butterworth low- or high-pass section (Q = 1/sqrt 2)."""
    w = 2.0 * np.pi * cutoff / rate
    cos, alpha = np.cos(w), np.sin(w) / np.sqrt(2.0)
    edge = 1.0 - cos if kind == "low" else 1.0 + cos
    middle = edge if kind == "low" else -edge
    num = np.array([edge / 2, middle, edge / 2]) / (1 + alpha)
    return num, np.array([1.0, -2 * cos / (1 + alpha), (1 - alpha) / (1 + alpha)])


def centre_section(rate: float, low: float, high: float) -> Section:
    """Low-pass section at the geometric centre of a band, with the band's quality factor."""
    w_low, w_high = 2 * np.pi * low / rate, 2 * np.pi * high / rate
    centre = np.sqrt(w_low * w_high)
    alpha = np.sin(centre) * (w_high - w_low) / (2 * centre)
    gain = 1 - np.cos(centre)
    num = np.array([gain / 2, gain, gain / 2]) / (1 + alpha)
    return num, np.array([1.0, -2 * np.cos(centre) / (1 + alpha), (1 - alpha) / (1 + alpha)])


def butterworth(order: int, cutoff: float | tuple[float, float]) -> list[Section]:
    """Butterworth sections; ``cutoff`` is a fraction of Nyquist, a pair means band-pass."""
    m = np.arange(-order + 1, order, 2)
    proto = -np.exp(1j * np.pi * m / (2 * order))
    fs = 2.0
    warp = lambda w: 2 * fs * np.tan(np.pi * w / fs)
    if np.ndim(cutoff) == 0:
        poles, gain, n_zero = proto * warp(cutoff), warp(cutoff) ** order, 0
    else:
        lo, hi = warp(cutoff[0]), warp(cutoff[1])
        width, mid = hi - lo, np.sqrt(lo * hi)
        half = proto * width / 2
        root = np.sqrt(half ** 2 - mid ** 2)
        poles, gain, n_zero = np.concatenate([half + root, half - root]), width ** order, order
    z_poles = (2 * fs + poles) / (2 * fs - poles)
    gain = np.real(gain * (2 * fs) ** n_zero / np.prod(2 * fs - poles))
    upper = sorted(z_poles[z_poles.imag > 1e-12], key=abs)
    real = sorted(z_poles[abs(z_poles.imag) <= 1e-12].real)
    dens = [np.array([1.0, -2 * p.real, abs(p) ** 2]) for p in upper]
    dens += [np.array([1.0, -(a + b), a * b]) for a, b in zip(real[::2], real[1::2])]
    nums = [np.array([1.0, 2.0, 1.0]) if n_zero == 0 else np.array([1.0, 0.0, -1.0])] * len(dens)
    if len(real) % 2:                                          # odd low-pass: one section of first order
        dens, nums = [*dens, np.array([1.0, -real[-1], 0.0])], [*nums, np.array([1.0, 1.0, 0.0])]
    each = abs(gain) ** (1 / len(dens))
    sections = [(num * each, den) for num, den in zip(nums, dens)]
    if gain < 0:
        sections[0] = (-sections[0][0], sections[0][1])
    return sections


def cascade(sections: list[Section]) -> StateSpace:
    """Series connection of sections as one state space."""
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for num, den in sections:
        sa = np.array([[-den[1], 1.0], [-den[2], 0.0]])
        sb = np.array([num[1] - den[1] * num[0], num[2] - den[2] * num[0]])
        sc, sd = np.array([1.0, 0.0]), num[0]
        n = len(b)
        grown = np.zeros((n + 2, n + 2))
        grown[:n, :n], grown[n:, n:], grown[n:, :n] = a, sa, np.outer(sb, c)
        a, b = grown, np.concatenate([b, sb * d])
        c, d = np.concatenate([sd * c, sc]), sd * d
    return StateSpace(a, b, c, d)


def run(space: StateSpace, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Filter rows of ``x`` (fragments by samples) from per-fragment start states."""
    y, s = np.empty_like(x), start
    for i in range(x.shape[1]):
        y[:, i] = s @ space.c + space.d * x[:, i]
        s = s @ space.a.T + np.outer(x[:, i], space.b)
    return y


def zero_phase(space: StateSpace, x: np.ndarray, pad: int) -> np.ndarray:
    """Forward and backward pass with odd reflection at both ends."""
    left = 2 * x[:, :1] - x[:, pad:0:-1]
    right = 2 * x[:, -1:] - x[:, -2:-pad - 2:-1]
    ext = np.concatenate([left, x, right], axis=1)
    zi = space.steady()
    ahead = run(space, ext, np.outer(ext[:, 0], zi))[:, ::-1]
    back = run(space, ahead, np.outer(ahead[:, 0], zi))[:, ::-1]
    return back[:, pad:-pad]
