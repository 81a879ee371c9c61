"""Segments as calls outside exclusions, and the info table beside genotypes."""

import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from windrow import cli
from windrow.operators import complex_loci as cx
from windrow.plans import queries_search, registry
from windrow.plans import views as v
from windrow.sources import writers as wr


def outside(start, end, excluded):
    """Pieces of [start, end) outside the intervals."""
    pieces = [(start, end)]
    for a, b in excluded:
        pieces = [q for s, e in pieces for q in ((s, min(e, a)), (max(s, b), e)) if q[0] < q[1]]
    return pieces


def test_called_segments_of_the_table(spark, tiny):
    got = sorted(tuple(r) for r in registry.queries()["called_segments"](spark, tiny).collect())
    excluded, cells = defaultdict(list), defaultdict(list)
    for r in queries_search.low_stretches(spark, tiny).collect():
        if r["end"] - r["start"] > v.WIDTH:
            excluded[r["contig"]].append((r["start"], r["end"]))
    for r in v.panel(spark, tiny).collect():
        cells[r["contig"], r["sample"]].append((r["w"], r["start"], r["end"], r["cp"]))
    want = []
    for c in registry.queries()["reported_calls"](spark, tiny).collect():
        for s, e in outside(c["start"], c["call_end"], excluded[c["contig"]]):
            own = sorted(x for x in cells[c["contig"], c["sample"]] if s <= x[1] and x[2] <= e)
            if own:
                want.append((c["contig"], c["sample"], own[0][1], own[-1][2], own[0][0], own[-1][0] + 1, statistics.fmean(x[3] for x in own), len(own)))
    want.sort()
    assert len(got) == len(want) > 50 and sum(map(len, excluded.values())) > 5
    for a, b in zip(got, want, strict=True):
        assert a[:6] == b[:6] and a[7] == b[7] and a[6] == pytest.approx(b[6], abs=2e-6)


def test_exclusions_that_cover_touch_or_are_short(spark):
    track = spark.createDataFrame([("c", "s", w, w * 10, w * 10 + 10, float(w)) for w in range(20)], "contig string, sample string, w long, start long, end long, cp double")
    segs = spark.createDataFrame([("c", "s", 0, 5, 0), ("c", "s", 5, 12, 50), ("c", "s", 12, 20, 120)], "contig string, sample string, w0 long, w1 long, start long")
    cut = lambda rows: sorted(tuple(r) for r in cx.called_segments(segs, track, ["contig", "sample"], spark.createDataFrame(rows, "contig string, start long, end long"), 40, 5).select("start", "end", "w0", "w1", "mean", "n").collect())
    # the last segment is not reported; a call ends with the window after its last one
    assert cut([]) == [(0, 60, 0, 6, 2.5, 6), (50, 130, 5, 13, 8.5, 8)]
    assert cut([("c", 0, 60), ("c", 70, 75), ("x", 0, 900)]) == [(60, 130, 6, 13, 9.0, 7)]
    assert cut([("c", 15, 31)]) == [(0, 10, 0, 1, 0.0, 1), (40, 60, 4, 6, 4.5, 2), (50, 130, 5, 13, 8.5, 8)]
    assert cut([("c", -5, 900)]) == []


def test_info_table_target_loci_and_subsets(spark, tiny, tmp_path):
    path = str(tmp_path / "panel")
    wr.write_panel(v.panel(spark, tiny).withColumn("kind", F.lit("wssd")), path)
    (tmp_path / "r.bed").write_text("A 500 2500\nN\t0\t9000\nR 10000 20000\n")
    (tmp_path / "t.bed").write_text("A 2400 2600\nR 0 10000\nN 8999 9001\n")
    names = sorted(r["sample"] for r in v.panel(spark, tiny).select("sample").distinct().collect())[:6]
    more = ["--target-loci", str(tmp_path / "t.bed"), "--subset-samples", ":".join(names), "--info", str(tmp_path / "info"), "--min-max-mu-d", "0.0", "--max-mu", "9", "--bin", "700"]
    cli.run(spark, cli.parser().parse_args(["genotype-loci", "--panel", path, "--regions", str(tmp_path / "r.bed"), "--out", str(tmp_path / "out"), *more]))
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).columns == ["contig", "start", "end", *names]
    lines = [r["value"].split("\t") for r in spark.read.text(str(tmp_path / "info")).collect()]
    assert lines[0][:3] == ["contig", "start", "end"] and {"wnd_size", "n_clusts", "Lscore", "bic_delta", "singleton_cp_z"} <= set(lines[0])
    assert [x[:3] for x in lines[1:]] == [["A", "500", "2500"], ["N", "0", "9000"]]
    assert all(len(x) == len(lines[0]) for x in lines)
    assert all(x[lines[0].index("GC")] == "None" for x in lines[1:])
