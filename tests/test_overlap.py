"""Overlaps of mixtures: closed forms, fine grids, awkward components."""

import math

import numpy as np
import pytest

from tests.oracle import assert_same
from windrow.operators import overlap
from windrow.plans import registry


def test_two_crossings_in_closed_form():
    """The narrow component is the lesser outside its two crossings with the wide one, which is the lesser between them."""
    m, s, w = (2.9674, 3.5564), (0.19997, 0.01101), (0.98736, 0.01264)
    a = 1 / (2 * s[1] ** 2) - 1 / (2 * s[0] ** 2)
    b = m[0] / s[0] ** 2 - m[1] / s[1] ** 2
    c = m[1] ** 2 / (2 * s[1] ** 2) - m[0] ** 2 / (2 * s[0] ** 2) + math.log(w[0] * s[1] / (w[1] * s[0]))
    lo, hi = ((-b + sign * math.sqrt(b * b - 4 * a * c)) / (2 * a) for sign in (-1, 1))
    cdf = lambda x, k: 0.5 * math.erfc(-(x - m[k]) / s[k] / math.sqrt(2))
    want = w[1] * (cdf(lo, 1) + 1 - cdf(hi, 1)) + w[0] * (cdf(hi, 0) - cdf(lo, 0))
    f = overlap.densities(*map(np.array, (m, s, w)))
    assert m[0] < lo < m[1] < hi and np.allclose(*f(np.array([lo, hi])))
    assert overlap.least_mass(m, s, w) == pytest.approx(want, abs=1e-9)


def test_equal_deviations_follow_the_error_function():
    for gap in (0.0, 0.5, 2.0, 6.0):
        want = 0.5 * math.erfc(gap / 2 / math.sqrt(2))
        assert overlap.least_mass([1.0, 1.0 + gap * 0.1], [0.1, 0.1], [0.5, 0.5]) == pytest.approx(want, abs=1e-9)
        assert overlap.lost_mass([1.0, 1.0 + gap * 0.1], [0.1, 0.1], [0.5, 0.5]) == pytest.approx(want, abs=1e-9)


def test_fine_grid_for_several_components():
    draw = np.random.default_rng(3)
    for _ in range(20):
        k = draw.integers(1, 6)
        m, s, w = draw.uniform(0, 4, k), 10 ** draw.uniform(-2, 0, k), draw.dirichlet(np.ones(k))
        lo, hi = (m - 10 * s).min(), (m + 10 * s).max()
        n = 2_000_000
        x = lo + (np.arange(n) + 0.5) * (hi - lo) / n
        d = np.stack([overlap.densities(m[i : i + 1], s[i : i + 1], w[i : i + 1])(x)[0] for i in range(k)])
        step = (hi - lo) / n
        assert overlap.least_mass(m, s, w) == pytest.approx(d.min(0).sum() * step, abs=2e-7)
        assert overlap.lost_mass(m, s, w) == pytest.approx((d.sum(0) - d.max(0)).sum() * step, abs=2e-7)


def test_narrow_component_inside_a_wide_one_is_not_missed():
    assert overlap.least_mass([0.0, 0.3], [1.0, 1e-6], [0.5, 0.5]) == pytest.approx(0, abs=1e-4)
    assert overlap.least_mass([0.0, 0.3], [1.0, 1e-6], [1 - 1e-9, 1e-9]) == pytest.approx(1e-9, rel=1e-3)


def test_unknown_deviations_ties_and_single_components(spark):
    rows = [(1, 0, 1.0, None, 5), (1, 1, 1.0, 0.0, 5), (2, 7, 3.0, 0.1, 9), (3, 0, None, 0.1, 4), (3, 1, 2.0, 0.2, 0)]
    near, whole = overlap.mixture_overlaps(spark.createDataFrame(rows, "locus long, label int, mean double, sd double, n long"), 0.05)
    (r,) = near.collect()
    assert (r["locus"], r["label"], r["next_label"]) == (1, 0, 1)
    assert (r["overlap"], r["of_own"], r["of_next"]) == pytest.approx((0.5, 1.0, 1.0))
    assert {(x["locus"], x["n_components"], round(x["lost"], 6)) for x in whole.collect()} == {(1, 2, 0.5), (2, 1, 0.0)}


@pytest.mark.parametrize("name", ["mixture_overlap", "mixture_lost"])
def test_queries(spark, name):
    d = "/root/testdata/sf0.01"
    assert_same(registry.queries()[name](spark, d), registry.oracle_sql()[name], d)
