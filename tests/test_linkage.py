"""Linkage on neighbour lists equals linkage on the matrix."""

import random

import numpy as np
import pytest

from windrow.operators import mixture as mx


def drawn(seed, n, span, sizes):
    r = random.Random(seed)
    return np.array(sorted({(s := r.randrange(span), s + r.choice(sizes)) for _ in range(n)}), np.int64)


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("more", [{}, {"max_frac_uniq": 0.6}, {"max_dif": 25}])
def test_equal_to_the_matrix(seed, more):
    p = drawn(seed, 160, 400, (0, 5, 20, 20, 40, 300))
    for cut in (0.3, 0.85):
        want = mx.complete_linkage(mx.reciprocal_distance(p[:, 0], p[:, 1], **more), cut)
        i, j, d = mx.neighbour_pairs(p[:, 0], p[:, 1], cut, **more)
        assert (mx.sparse_linkage(len(p), i, j, d, cut) == want).all()


def test_pairs_in_pieces_are_the_same(monkeypatch):
    p = drawn(1, 300, 200, (10, 50))
    whole = mx.neighbour_pairs(p[:, 0], p[:, 1], 0.85)
    monkeypatch.setattr(mx, "PAIRS_AT_ONCE", 50)
    assert all((a == b).all() for a, b in zip(whole, mx.neighbour_pairs(p[:, 0], p[:, 1], 0.85), strict=True))


def test_many_distinct_intervals_in_one_cluster(spark):
    """20,000 distinct intervals, each overlapping a few dozen: a matrix would hold 400 million distances."""
    r = random.Random(2)
    p = sorted({(s := i * 10 + r.randrange(10), s + r.randrange(100, 260)) for i in range(20_000)})
    rows = [(1, "c", 7, f"c{k}", a, b) for k, (a, b) in enumerate(p)]
    df = spark.createDataFrame(rows, "g int, chr string, cluster_no long, call_id string, start long, end long")
    got = {x["call_id"]: x["sub"] for x in mx.linkage_clusters(df, ["chr"], 0.5).collect()}
    a = np.array(p, np.int64)
    i, j, d = mx.neighbour_pairs(a[:, 0], a[:, 1], 0.5)
    assert len(i) < 40 * len(p)
    # every pair within a sub-cluster is near, and a stretch of it equals the matrix' answer where the stretch is cut off
    members = {}
    for k in range(len(p)):
        members.setdefault(got[f"c{k}"], []).append(k)
    for m in members.values():
        for x in m:
            for y in m:
                o = min(p[x][1], p[y][1]) - max(p[x][0], p[y][0])
                assert min(o / (p[x][1] - p[x][0]), o / (p[y][1] - p[y][0])) >= 0.5
    assert max(map(len, members.values())) > 3


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("more", [{}, {"max_frac_uniq": 0.6}, {"max_dif": 25}])
def test_sweep_equal_to_the_matrix(seed, more):
    """Many equal distances, blocks shorter than an interval."""
    p = drawn(seed, 200, 600, (0, 5, 20, 20, 40, 120))
    for cut in (0.3, 0.5, 0.85, 0.99):
        want = mx.complete_linkage(mx.reciprocal_distance(p[:, 0], p[:, 1], **more), cut)
        for block in (1, 7, 64, 1_000):
            assert (mx.swept_linkage(p[:, 0], p[:, 1], cut, block=block, **more) == want).all()


def test_dense_cluster_keeps_no_pairs():
    """12,000 intervals, some 600 near ones each: lists of pairs would take over a GB, the sweep holds a few squares of those at one place."""
    import tracemalloc

    r = random.Random(5)
    p = np.array(sorted({(s := r.randrange(12_000_000), s + r.choice((300_000, 600_000, 900_000, 1_200_000))) for _ in range(12_000)}), np.int64)
    tracemalloc.start()
    got = mx.interval_linkage(p[:, 0], p[:, 1], 0.85)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert len(got) == len(p) and got[0] == 0
