"""Hand-checked fixtures of single rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.functions import special
from windrow.operators import calls as cl
from windrow.operators import genotype as gt
from windrow.operators import intervals as iv
from windrow.operators import segmentation as sg
from windrow.operators import tracks as tr
from windrow.operators import vcf


def intervals(spark, rows):
    return spark.createDataFrame([(i, "c", s, e) for i, (s, e) in enumerate(rows)], "call_id long, chr string, start long, end long")


def clusters(spark, rows, **k):
    out = iv.overlap_clusters(intervals(spark, rows), ["chr"], ["start", "end", "call_id"], **k)
    return [r["cluster_no"] for r in out.orderBy("call_id").collect()]


def test_sweep_touching_intervals_part(spark):
    assert clusters(spark, [(1, 5), (5, 8), (7, 9)]) == [1, 2, 2]


def test_sweep_closed_joins_touching(spark):
    assert clusters(spark, [(1, 5), (5, 8), (7, 9)], closed=True) == [1, 1, 1]


def test_sweep_nested(spark):
    assert clusters(spark, [(1, 100), (2, 3), (50, 60)]) == [1, 1, 1]


def test_sweep_over_many_tiles(spark):
    from windrow.operators.scan import exclusive_max

    rows = [(i * 10, i * 10 + (95 if i % 7 == 0 else 8)) for i in range(60)]
    got = exclusive_max(intervals(spark, rows), ["chr"], ["start", "end", "call_id"], "start", "end", "m", tile=37)
    want, top = {}, None
    for i, (_, e) in enumerate(rows):
        want[i], top = top, e if top is None else max(top, e)
    assert {r["call_id"]: r["m"] for r in got.collect()} == want


@pytest.mark.parametrize(("dif", "want"), [(None, 1 / 3), (6, 0.0)])
def test_reciprocal(spark, dif, want):
    p = spark.createDataFrame([(0, 10, 5, 20)], "start long, end long, b_start long, b_end long")
    assert iv.reciprocal(p, dif).first()["recip"] == pytest.approx(want)


def test_overlap_predicates(spark):
    p = spark.createDataFrame([(0, 5, 5, 9)], "s long, e long, t long, u long")
    r = p.select(iv.overlaps("s", "e", "t", "u").alias("a"), iv.overlaps_closed("s", "e", "t", "u").alias("b"), iv.overlaps_unless_abutting("s", "e", "t", "u").alias("c")).first()
    assert tuple(r) == (False, True, False)


def axis(spark):
    return spark.createDataFrame([("c", i, 10 * i, 10 * i + 10) for i in range(4)], "contig string, w long, start long, end long")


@pytest.mark.parametrize(("locus", "want"), [((5, 35), (2, 3)), ((12, 13), (2, 3))])
def test_genotyper_slice(spark, locus, want):
    r = spark.createDataFrame([("c", *locus)], "contig string, start long, end long")
    s = iv.slices(r, axis(spark), "genotyper").first()
    assert (s["w0"], s["w1"]) == want


def test_asof_beyond_and_between(spark):
    p = spark.createDataFrame([("c", x) for x in (-5, 0, 1, 29, 30, 31)] + [("absent", 3)], "contig string, x long")
    got = iv.asof_index(p, axis(spark), "x", "start", "i", width=7)
    assert sorted((r["contig"], r["x"], r["i"]) for r in got.collect()) == [("absent", 3, 0), ("c", -5, 0), ("c", 0, 0), ("c", 1, 1), ("c", 29, 3), ("c", 30, 3), ("c", 31, 4)]


def test_runs(spark):
    d = spark.createDataFrame([("c", w) for w in (3, 4, 5, 9, 10)], "contig string, w long")
    assert sorted((r["first"], r["last"]) for r in iv.runs(d, ["contig"]).collect()) == [(3, 6), (9, 11)]


@pytest.mark.parametrize(("strict", "want"), [(True, 0), (False, 1)])
def test_bh_without_discovery(spark, strict, want):
    d = spark.createDataFrame([(0, 0.9), (1, 0.8)], "id long, p double")
    assert cl.bh_fdr(d, 0.05, ["p", "id"], strict).where("significant").count() == want


def test_bh_step_up(spark):
    d = spark.createDataFrame(list(enumerate([0.01, 0.04, 0.03, 0.5])), "id long, p double")
    assert {r["id"] for r in cl.bh_fdr(d, 0.1, ["p", "id"]).where("significant").collect()} == {0, 1, 2}


def test_recentre(spark):
    d = spark.createDataFrame([("c", i, x) for i, x in enumerate([0.0, 1.0, 3.0, 5.0])], "contig string, w long, cp double")
    assert [r["cp"] for r in tr.recentred(d, ["contig"]).orderBy("w").collect()] == [0, 0, 2, 4]


@pytest.mark.parametrize(
    ("values", "want"),
    [([1, None, None, 3, 5], [1, 2, 2, 3, 5]), ([1, None, None, 3], [1, 1, 1, 3]), ([None, 4, 6], [4, 4, 6]), ([4, 6, None], [4, 6, 6]), ([None, None], [None, None])],
)
def test_repair(spark, values, want):
    d = spark.createDataFrame([("c", i, None if x is None else float(x)) for i, x in enumerate(values)], "contig string, w long, value double")
    assert [r["value"] for r in tr.repaired(d, ["contig"]).orderBy("w").collect()] == want


def label_rows(spark, rows):
    return spark.createDataFrame([(0, i, m, 0.1, n) for i, (m, n) in enumerate(rows)], "locus long, label int, mean double, sd double, n long")


@pytest.mark.parametrize(("means", "want"), [([0.95, 1.9, 3.1], [1, 2, 3]), ([1.1, 1.4, 1.6, 2.1], [0, 1, 2, 3])])
def test_copy_numbers(spark, means, want):
    s = label_rows(spark, [(m, 1) for m in means])
    assert [r["cn"] for r in gt.labels_to_cn(s, odd_major=False).orderBy("label").collect()] == want


def test_odd_major_moves_all(spark):
    s = label_rows(spark, [(2.0, 2), (3.1, 10)])
    assert [r["cn"] for r in gt.labels_to_cn(s).orderBy("label").collect()] == [3, 4]
    s = label_rows(spark, [(2.0, 2), (2.9, 10)])
    assert [r["cn"] for r in gt.labels_to_cn(s).orderBy("label").collect()] == [1, 2]


@pytest.mark.parametrize(("cns", "kind"), [([1, 2], "DEL"), ([2, 3], "DUP"), ([1, 2, 3], "CNV")])
def test_sv_type(spark, cns, kind):
    lls = {c: -1.0 for c in cns}
    g = spark.createDataFrame([("x", f"s{i}", c, lls) for i, c in enumerate(cns)], "locus string, sample string, cn int, lls map<int,double>")
    assert {r["svtype"] for r in vcf.encoded(g).collect()} == {kind}


def test_folded_frequency(spark):
    g = spark.createDataFrame([("x", 0, 10, f"s{i}", c) for i, c in enumerate([0, 1, 2, 2])], "locus string, start long, end long, sample string, cn int")
    assert [r["af"] for r in gt.allele_spectrum(g).collect()] == [0.375]


def test_upper_median(spark):
    c = spark.createDataFrame([("c", 1, s, s + 9, 0.1) for s in (1, 2, 3, 4)], "chr string, cluster_no long, start long, end long, p double")
    r = cl.cluster_stats(c, ["chr"]).first()
    assert (r["upper_start"], r["med_start"]) == (3, 2.5)


def test_gauss_pair():
    a, b = special.gaussian_overlap(2.9674184163362765, 0.19997407419512075**2, 0.98735838860058134, 3.5563537847950277, 0.011010508240214663**2, 1 - 0.98735838860058134)
    assert a == pytest.approx(0.001909, abs=2e-6)
    assert b == pytest.approx(0.149082, abs=2e-5)


def test_special_functions():
    assert special.normal_cdf(1.959963985) == pytest.approx(0.975, abs=1e-9)
    # one and two degrees of freedom have closed forms
    t = np.array([-3.0, -0.4, 0.0, 0.7, 5.0])
    assert special.t_cdf(t, np.ones(5)) == pytest.approx(0.5 + np.arctan(t) / math.pi, abs=1e-10)
    assert special.t_cdf(t, np.full(5, 2.0)) == pytest.approx(0.5 + t / (2 * np.sqrt(2 + t * t)), abs=1e-10)
    assert special.fisher_exact(8, 2, 1, 5) == pytest.approx(0.03496503, abs=1e-7)
    assert special.fisher_exact(0, 0, 0, 0) == 1.0


def test_subtracted(spark):
    calls = intervals(spark, [(0, 100), (10, 20), (200, 300)])
    ex = spark.createDataFrame([("c", 5, 25), ("c", 20, 40), ("c", 90, 95)], "chr string, start long, end long")
    got = sorted((r["call_id"], r["start"], r["end"]) for r in iv.subtracted(calls, ex, 1, 16).collect())
    assert got == [(0, 0, 4), (0, 41, 89), (0, 96, 100), (2, 200, 300)]


def test_derivative_kernels_mirror():
    x = np.arange(7.0)
    assert sg.mirrored(x, 3).tolist() == [2, 1, 0, 0, 1, 2, 3, 4, 5, 6, 6, 5, 4]
    g1, g2 = sg.derivatives(np.arange(100.0), 2.0)
    assert g1[50] == pytest.approx(1.0, abs=1e-2)
    assert g2[50] == pytest.approx(0.0, abs=1e-2)  # the sampled kernel does not quite sum to 0


def test_planted_steps_are_found():
    rng = np.random.default_rng(3)
    x = np.concatenate([np.full(150, 2.0), np.full(60, 4.0), np.full(150, 2.0)]) + rng.normal(0, 0.15, 360)
    s = sg.segment_signal(x, n_scales=21, cutoff_scale=4, max_merge=0.7)
    assert [round(v) for *_, v in s if _[1] - _[0] > 5] == [2, 4, 2]
    starts = [a for a, b, v in s if round(v) == 4]
    assert abs(starts[0] - 150) <= 3


def test_histogram_and_empirical_p(spark):
    from windrow.operators import nullmodel as nm

    rng = np.random.default_rng(0)
    t = spark.createDataFrame([("c", i, float(x)) for i, x in enumerate(rng.normal(0, 1, 400))], "contig string, w long, cp double")
    h = nm.histogram(t, ["contig"], 3)
    assert h.agg(F.sum("n")).first()[0] == 397
    assert h.agg(F.max("cumulative")).first()[0] == pytest.approx(1)
    c = spark.createDataFrame([(-9.0,), (0.0,), (9.0,)], "mean double")
    p = [r["p"] for r in nm.empirical_p(c, h, "mean", 3).orderBy("mean").collect()]
    assert p[0] < 0.02
    assert p[1] == 0.5
    assert p[2] < 0.02
