"""Scans by tiles and buckets: the answer does not depend on where tiles are cut."""

import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same
from windrow.operators import complex_loci, nullmodel, scan, tracks
from windrow.plans import registry


@pytest.mark.parametrize("tile", [1, 2, 3, 1_000])
def test_lag_of_null_values(spark, tile):
    values = [1, 1, None, 1, None, None, 2, 2]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(values)] + [("b", 5, None), ("b", 9, 3)], "k string, w long, v int")
    got = {(r["k"], r["w"]): r["before"] for r in scan.lagged(df, ["k"], ["w"], "w", "v", "before", tile).collect()}
    assert got == {("a", i): values[i - 1] if i else None for i in range(len(values))} | {("b", 5): None, ("b", 9): None}


def test_ranks_within_keys(spark):
    r = random.Random(1)
    rows = [(r.choice("abc"), r.randrange(6), i) for i in range(200)]
    got = {x["i"]: x["at"] for x in scan.key_rank(spark.createDataFrame(rows, "k string, v long, i long"), ["k"], ["v", "i"], "at").collect()}
    for k in "abc":
        own = sorted((v, i) for c, v, i in rows if c == k)
        assert [got[i] for _, i in own] == list(range(len(own)))


def plain_edges(g1, g2):
    n, sign = len(g1), [(x > 0) - (x < 0) for x in g2]
    cut = [i for i in range(n) if i in (0, n - 1) or sign[i] != sign[i - 1]]
    keep = n if len(cut) == n else min(len(cut), n - len(cut))
    return {(i, sign[i]) for i in sorted(cut, key=lambda i: (-abs(g1[i]), i))[:keep] if sign[i]}


@pytest.mark.parametrize("tile", [4, 1_000])
def test_edges_by_tiles(spark, tile):
    r = random.Random(2)
    tracks_ = {k: ([round(r.gauss(0, 1), 1) for _ in range(n)], [r.choice((-1.0, -1.0, 0.0, 1.0, 1.0, 1.0)) for _ in range(n)]) for k, n in (("a", 60), ("b", 7), ("c", 1))}
    rows = [(k, w, a, b) for k, (g1, g2) in tracks_.items() for w, (a, b) in enumerate(zip(g1, g2, strict=True))]
    df = spark.createDataFrame(rows, "k string, w long, g1 double, g2 double")
    got = {}
    for x in tracks.edges(df, ["k"], collapsed=False, tile=tile).collect():
        got.setdefault(x["k"], set()).add((x["w"], x["sign"]))
    assert got == {k: e for k, v in tracks_.items() if (e := plain_edges(*v))}


def test_rank_sum_with_ties_over_several_keys(spark):
    r = random.Random(3)
    rows = [(k, r.random() < 0.4, float(r.randrange(8))) for k in "ab" for _ in range(80)] + [("a", True, None)]
    got = {x["k"]: (x["s"], x["n1"], x["n2"]) for x in nullmodel.rank_sum(spark.createDataFrame(rows, "k string, g boolean, v double"), "g", "v", ["k"]).collect()}
    for k in "ab":
        own = sorted((v, g) for c, g, v in rows if c == k and v is not None)
        values = [v for v, _ in own]
        rank = {v: sum(i + 1 for i, x in enumerate(values) if x == v) / values.count(v) for v in set(values)}
        assert got[k] == pytest.approx((sum(rank[v] for v, g in own if g), sum(g for _, g in own), sum(not g for _, g in own)))


@pytest.mark.parametrize("name", ["edge_detect", "rank_sum_z", "bucket_medians", "rle_bands"])
def test_queries(spark, tiny, name):
    assert_same(registry.queries()[name](spark, tiny), registry.oracle_sql()[name], tiny)


def test_likelihoods_read_the_track_once(spark):
    """All windows lie beyond the bins, so their logs are equal and have no spread; the plan has stored tables, not the track's own steps."""
    rows = [(c, w, 2.0 + (w * 7 + len(c)) % 5 * 0.1) for c in ("a", "bb") for w in range(60)]
    t = spark.createDataFrame(rows, "contig string, w long, cp double").groupBy("contig", "w").agg(F.avg("cp").alias("cp"))
    cells = t.withColumn("call_id", F.struct("contig", F.floor(F.col("w") / 4).alias("seg")))
    p = nullmodel.likelihood_p(cells.select("call_id").distinct(), cells.select("call_id", "cp"), t, ["contig"], 4)
    # calls and their cells read the frame that they were given
    assert p._jdf.queryExecution().optimizedPlan().toString().count("avg(cp") <= 2
    got = p.collect()
    assert len(got) == 30 and {(r["ll"], r["p"]) for r in got} == {(0.0, 0.0)}


@pytest.mark.parametrize("spread", [0.0, 1e-17])
def test_histogram_of_equal_values(spark, spread):
    m = spark.createDataFrame([(0.1 + 0 * i,) for i in range(9)] + [(0.1 + spread,)], "moving double")
    h = nullmodel.value_histogram(m)
    assert h.agg(F.sum("n")).first()[0] == 10
    got = nullmodel.empirical_p(spark.createDataFrame([(-1.0,), (0.1,), (1e9,)], "mu double"), h, "mu", 1).collect()
    assert [r["p"] for r in got] == [0.0, 0.0, 0.0]


def test_rounds_of_sample_clusters_do_not_grow_the_plan(spark):
    """A chain of samples takes many rounds; the final plan stays that of stored tables."""
    n = 24
    rows = [("c", f"s{i:02}", i * 10 + a, i * 10 + a + 1) for i in range(n) for a in range(12)]
    s = spark.createDataFrame(rows, "chr string, sample string, start long, end long")
    got = complex_loci.sample_clusters(s, s, cutoff=0.95, max_frac_uniq=0.9)
    assert len(got._jdf.queryExecution().analyzed().toString()) < 20_000
    assert {r["sample"] for r in got.collect()} == {f"s{i:02}" for i in range(n)}
