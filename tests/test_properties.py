"""Properties of the iterative algorithms."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from windrow.operators import mixture as mx
from windrow.operators import segmentation as sg

signals = st.lists(st.floats(0, 6, allow_nan=False), min_size=4, max_size=60)
spans = st.lists(st.tuples(st.integers(0, 50), st.integers(1, 30)), min_size=1, max_size=14)


@given(signals, st.floats(0.05, 2))
@settings(max_examples=60, deadline=None)
def test_segments_tile_the_signal(x, limit):
    x = np.array(x)
    s = sg.merged_segments(x, np.arange(len(x) + 1), limit)
    assert s[0][0] == 0
    assert s[-1][1] == len(x)
    assert all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False))
    assert all(abs(a[2] - b[2]) >= limit for a, b in zip(s, s[1:], strict=False))


@given(signals)
@settings(max_examples=40, deadline=None)
def test_contours_end_within_the_track(x):
    n = len(x)
    found = sg.contours(sg.scale_space(np.array(x), 6), n)
    assert all(0 <= p < n and 2 <= top < 5 for p, top in found)
    assert len({p for p, _ in found}) == len(found)


@given(spans, st.floats(0.1, 0.9))
@settings(max_examples=60, deadline=None)
def test_linkage_diameter_is_below_the_cut(rows, cut):
    start = np.array([s for s, _ in rows])
    end = start + np.array([n for _, n in rows])
    d = mx.reciprocal_distance(start, end)
    assert np.allclose(d, d.T)
    assert ((d >= 0) & (d <= 1)).all()
    g = mx.complete_linkage(d, cut)
    for k in np.unique(g):
        part = d[np.ix_(g == k, g == k)]
        assert part[~np.eye(len(part), dtype=bool)].max(initial=0) <= cut + 1e-12


@given(st.lists(st.floats(0, 5, allow_nan=False), min_size=3, max_size=40))
@settings(max_examples=60, deadline=None)
def test_mixture_labels_and_weights(x):
    x = np.array(x)
    g = mx.genotype(x)
    assert len(g["labels"]) == len(x)
    assert np.isclose(g["weight"].sum(), 1)
    assert (g["var"] >= mx.MIN_COVAR * 0.999).all()


def test_em_does_not_lower_the_likelihood(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(2, 0.3, 60), rng.normal(3, 0.3, 30)])
    start = (np.array([1.5, 3.5]), np.array([0.5, 0.5]), np.array([0.5, 0.5]))
    lls = []
    for steps in (1, 2, 4, 8, 16):
        monkeypatch.setattr(mx, "MAX_STEPS", steps)
        monkeypatch.setattr(mx, "TOLERANCE", 0.0)
        lls.append(mx.fit(x, *start)["ll"])
    assert all(b >= a - 1e-6 for a, b in zip(lls, lls[1:], strict=False))


def test_two_groups_are_told_apart():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(2, 0.08, 40), rng.normal(3, 0.08, 20)])
    labels = mx.genotype(x)["labels"]
    assert len(set(labels[:40])) == 1
    assert len(set(labels)) == 2


def test_partitions_are_distinct_and_nested():
    x = np.array([0, 0.1, 1, 1.1, 3, 3.05, 3.9])
    parts = mx.centroid_partitions(x)
    sizes = [len(np.unique(p)) for p in parts]
    assert sizes == sorted(sizes, reverse=True)
    assert len(set(sizes)) == len(sizes)
