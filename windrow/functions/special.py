"""Special functions in numpy: normal distribution, incomplete beta, t distribution, hypergeometric test."""

from __future__ import annotations

import math

import numpy as np

#: Lanczos coefficients (g = 7, n = 9).
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)

_erfc = np.frompyfunc(math.erfc, 1, 1)


def normal_cdf(x):
    """Standard normal distribution function."""
    return 0.5 * np.asarray(_erfc(-np.asarray(x, float) / math.sqrt(2)), float)


def log_gamma(x):
    """Logarithm of the gamma function for positive arguments."""
    x = np.asarray(x, float) - 1
    a = np.full_like(x, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        a = a + c / (x + i)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(a)


def _fraction(a, b, x, steps=400):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def beta_inc(a, b, x):
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
        low = front * _fraction(a, b, x) / a
        high = 1 - front * _fraction(b, a, 1 - x) / b
    out = np.where(x < (a + 1) / (a + b + 2), low, high)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_cdf(t, df):
    """Student t distribution function."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return np.where(t > 0, 1 - tail, tail)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: all tables with the same margins that are not more likely."""
    n, r, k = a + b + c + d, a + b, a + c
    if n == 0:
        return 1.0

    def log_p(x):
        return -(math.lgamma(x + 1) + math.lgamma(r - x + 1) + math.lgamma(k - x + 1) + math.lgamma(n - r - k + x + 1))

    lo, hi = max(0, r + k - n), min(r, k)
    logs = np.array([log_p(x) for x in range(lo, hi + 1)])
    p = np.exp(logs - logs.max())
    return float(p[logs <= log_p(a) + 1e-7].sum() / p.sum())


def crossing_point(m1, v1, m2, v2, k):
    """(square, function of its root): where two weighted Gaussian densities, m1 <= m2, cross; ``k`` is twice the log of their ratio of heights.

    (x - m1)^2 / v1 - (x - m2)^2 / v2 = k is a quadratic in x - m1.  Of its
    two solutions one always lies outside the means on the narrower side; the
    other one counts and is written without a difference of large numbers.
    They do not cross where ``square`` is negative.  Takes numbers and columns.
    """
    gap = m2 - m1
    return v1 * v2 * (gap * gap + k * (v2 - v1)), lambda root: m1 + v1 * (gap * gap + k * v2) / (root + v1 * gap)


def gaussian_overlap(m1: float, v1: float, w1: float, m2: float, v2: float, w2: float, reach: float = 5.0) -> tuple[float, float]:
    """Shares of two weighted Gaussians beyond their crossing, each in its own weight; (1, 1) where the densities do not cross.

    The tails are cut to [m1 - reach * s1, m2 + reach * s2] of the ordered
    pair, and the weights are those of the pair alone.
    """
    swap = m1 > m2
    if swap:
        m1, v1, w1, m2, v2, w2 = m2, v2, w2, m1, v1, w1
    w1, w2 = w1 / (w1 + w2), w2 / (w1 + w2)
    s1, s2 = math.sqrt(v1), math.sqrt(v2)
    if s1 == s2:
        x = (m1 + m2) / 2
    else:
        square, x_of = crossing_point(m1, v1, m2, v2, 2 * math.log(w1 * s2 / (w2 * s1)))
        if square < 0:
            return 1.0, 1.0
        x = x_of(math.sqrt(square))
    lo, hi = m1 - reach * s1, m2 + reach * s2
    right = max(0.0, float(normal_cdf((hi - m1) / s1) - normal_cdf((x - m1) / s1)))
    left = max(0.0, float(normal_cdf((x - m2) / s2) - normal_cdf((lo - m2) / s2)))
    both = float(w1 * right + w2 * left)
    out = (both / w1, both / w2)
    return (out[1], out[0]) if swap else out
