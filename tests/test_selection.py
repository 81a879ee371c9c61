"""Exact medians by counts of buckets against sorted lists."""

import math
import random
import statistics

import pytest

from windrow.operators import selection, tracks
from windrow.plans import views as v

INF = float("inf")


def plain(rows):
    groups = {}
    for k, x in rows:
        groups.setdefault(k, [])
        if x is not None and not math.isnan(x):
            groups[k].append(x)
    out = {}
    for k, xs in groups.items():
        xs.sort()
        a, b = (xs[(len(xs) - 1) // 2], xs[len(xs) // 2]) if xs else (None, None)
        out[k] = None if a is None else a if a == b else (a + b) / 2
    return out


def drawn(seed):
    r = random.Random(seed)
    rows = [("uniform", r.random()) for _ in range(401)] + [("few values", float(r.choice((1, 2, 2, 3)))) for _ in range(400)]
    rows += [("one value", 7.0)] * 300 + [("two halves", float(i % 2)) for i in range(300)] + [("wide", r.choice((-1, 1)) * 10.0 ** r.uniform(300, 308)) for _ in range(350)]
    rows += [("outlier", x) for x in [1e300] + [r.gauss(0, 1) for _ in range(300)]] + [("small", 3.0), ("small", 1.0), ("none", None), ("none", float("nan"))]
    rows += [("infinite", x) for x in [INF] * 60 + [-INF] * 61 + [1.0, 2.0]] + [("mostly infinite", x) for x in [INF] * 90 + [float(i) for i in range(90)]] + [(None, x) for x in (1.0, 5.0)]
    rows += [("zeros", x) for x in [0.0, -0.0] * 120]
    r.shuffle(rows)
    return [x for x in rows if x[0] is not None]


@pytest.mark.parametrize("buckets,few", [(64, 50), (4_096, 100_000)])
def test_equal_to_sorted_lists(spark, buckets, few):
    rows = drawn(buckets)
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    got = {r["k"]: r["median"] for r in selection.exact_medians(df, ["k"], "x", buckets=buckets, list_rows=few).collect()}
    assert got == plain(rows)


def test_two_keys_integers_and_no_rows(spark):
    df = spark.range(1_000).selectExpr("id % 3 as a", "cast(id % 2 as string) as b", "cast(id as int) as x")
    got = {(r["a"], r["b"]): r["m"] for r in selection.exact_medians(df, ["a", "b"], "x", "m", buckets=8, list_rows=20).collect()}
    assert got == {(a, b): statistics.median(i for i in range(1_000) if i % 3 == a and str(i % 2) == b) for a in range(3) for b in "01"}
    assert selection.exact_medians(df.limit(0), ["a"], "x").count() == 0


def test_recentred_tracks_are_the_same(spark, tiny):
    t = v.track(spark, tiny).select("contig", "w", "cp")
    one = {(r["contig"], r["w"]): r["cp"] for r in tracks.recentred(t, ["contig"]).collect()}
    many = {(r["contig"], r["w"]): r["cp"] for r in tracks.recentred(t, ["contig"], large=True).collect()}
    assert one.keys() == many.keys()
    assert all(many[k] == pytest.approx(x, abs=1e-12) for k, x in one.items())
