"""Scales by transforms equal sums of products, whatever the tiles and the track's length."""

import numpy as np
import pytest

from tests.oracle import assert_same
from windrow.operators import scales, tracks
from windrow.plans import registry


@pytest.mark.parametrize("tile", [32, 8_192])
def test_equal_to_one_scale_at_a_time(spark, tile):
    r = np.random.default_rng(5)
    rows = [(k, w, float(x)) for k, n in (("long", 300), ("short", 9), ("one", 1)) for w, x in enumerate(r.normal(2, 1, n))]
    df = spark.createDataFrame(rows, "k string, w long, cp double")
    got = {(x["k"], x["sigma"], x["w"]): (x["g0"], x["g1"], x["g2"]) for x in scales.scale_space(df, ["k"], [1.0, 2.5, 8.0], tile).collect()}
    for sigma in (1.0, 2.5, 8.0):
        want = {(x["k"], sigma, x["w"]): (x["g0"], x["g1"], x["g2"]) for x in tracks.gaussian_derivatives(df, ["k"], sigma).collect()}
        assert len(want) == len(rows)
        for at, g in want.items():
            assert got[at] == pytest.approx(g, abs=1e-11)
    assert len(got) == 3 * len(rows)


def test_rounding_stays_within_the_bound():
    r = np.random.default_rng(6)
    for scale in (1e-3, 1.0, 1e6):
        x = r.normal(0, scale, 12_000)
        for sigma in (1.0, 10.0, 50.0):
            kernels = [np.array(c, float) for c in zip(*tracks.gaussian_kernel(sigma), strict=True)][1:]
            for k, fast in zip(kernels, scales.correlations(x, kernels), strict=True):
                assert np.abs(fast - np.correlate(x, k, "valid")).max() <= scales.ERROR * np.abs(x).max() * np.abs(k).sum() * np.log2(len(x))


def test_wide_scales_cost_no_more_than_narrow_ones():
    """The transform's length, and so the work for a scale, depends on the tile and the widest kernel, not on each scale."""
    seen = []
    inner = np.fft.irfft
    try:
        np.fft.irfft = lambda a, n: seen.append(n) or inner(a, n)
        scales.correlations(np.zeros(9_000), [np.zeros(9), np.zeros(401)])
    finally:
        np.fft.irfft = inner
    assert len(set(seen)) == 1


def test_query(spark, tiny):
    for name in ("scale_space", "gaussian_derivative", "edge_detect"):
        assert_same(registry.queries()[name](spark, tiny), registry.oracle_sql()[name], tiny)
