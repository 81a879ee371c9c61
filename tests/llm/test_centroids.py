"""Centroid clustering against its SQL and against plain Python integers."""

import hashlib
import math
import random

import numpy as np

from tests.oracle import assert_same
from windrow.llm import centroids

SCHEMA = "vec_id long, embedding array<double>"


def plain_clusters(rows):
    kept = [(i, [math.floor(64 * x) if abs(x) < 2**53 else 64 * int(x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    first = sorted(kept, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())[:16]
    c = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), k) for k, w in enumerate(c)) for _, v in kept]

    for _ in range(3):
        at = assign()
        for k in range(len(c)):
            own = [v for (_, v), (_, j) in zip(kept, at, strict=True) if j == k]
            if own:
                c[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    fits = lambda x: x if x < 2**63 else None
    per = {k: sum(d for d, j in at if j == k) if all(d < 2**63 for d, j in at if j == k) else 2**63 for k in range(len(c))}
    total = sum(d for d, _ in at)
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted((i, k, fits(d), fits(per[k]), fits(total), sha[k]) for (i, _), (d, k) in zip(kept, at, strict=True))


def got(spark, rows):
    return sorted(tuple(r) for r in centroids.clustered(spark.createDataFrame(rows, SCHEMA)).collect())


def test_whole_table_equals_sql(spark, tiny):
    assert_same(centroids.op12_centroids(spark, tiny), centroids.OP12_SQL, tiny)


def test_unusable_rows_ties_and_repeated_vectors(spark):
    draw = random.Random(3)
    grid = [[draw.choice((-0.5, 0.0, 0.5)) if j < 3 else 0.0 for j in range(64)] for _ in range(120)]
    rows = list(enumerate(grid)) + [(500, grid[0]), (501, grid[0])]
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [math.nan] + [1.0] * 63), (906, [math.inf] + [1.0] * 63)]
    assert got(spark, rows + bad) == plain_clusters(rows)
    assert got(spark, bad) == [] == got(spark, [])
    assert got(spark, rows[:5]) == plain_clusters(rows[:5])


def test_components_of_any_size_are_exact(spark):
    draw = random.Random(5)
    rows = [(i, [draw.uniform(-1, 1) * 10 ** draw.choice((0, 3, 6)) for _ in range(64)]) for i in range(60)]
    rows += [(100 + i, [draw.uniform(-1, 1) * 10.0 ** draw.choice((8, 20, 300)) for _ in range(64)]) for i in range(6)]
    assert got(spark, rows) == plain_clusters(rows)


def test_bounds_never_exceed_the_distance_and_skip_work():
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(16, 64)) * 40
    x = np.floor(centres[draw.integers(0, 16, 2_000)] + draw.normal(size=(2_000, 64)) * 4).astype(np.int64)
    c = np.floor(centres).astype(np.int64)
    axes = centroids.spanned_axes(x[:16].tolist())
    small, large = centroids.compressed(x, axes), centroids.compressed(c, axes)
    bound = (small**2).sum(1)[:, None] + (large**2).sum(1) - 2 * small @ large.T
    true = ((x[:, None].astype(float) - c) ** 2).sum(2)
    assert (bound <= true * (1 + 1e-9) + 1e-6).all()
    cluster, distance, work = centroids.nearest(x, small, c.tolist(), axes)
    assert (cluster == true.argmin(1)).all() and (distance == true.min(1)).all()
    assert work < 8 * len(x)


def test_clashing_columns(spark):
    rows = [(i, [float(i == j) for j in range(64)]) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as cluster", "2 as x", "3 as bounds", "4 as distance", "5 as inertia", "6 as h")
    assert sorted(tuple(r) for r in centroids.clustered(df).collect()) == plain_clusters(rows)
