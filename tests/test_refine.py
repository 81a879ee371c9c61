"""Call refinement from clusters to final calls: a plain version over the whole table, and planted samples by the command."""

import gzip
import math
import statistics
from bisect import bisect_left
from collections import defaultdict

import pytest

from windrow import cli
from windrow.operators import refine
from windrow.plans import queries_search, registry
from windrow.plans import views as v
from windrow.sources import writers as wr


def sweep(rows):
    """Lists of (start, end, ...) that overlap strictly, in order."""
    out, reach = [], None
    for r in sorted(rows):
        if reach is None or r[0] >= reach:
            out.append([])
            reach = r[1]
        reach = max(reach, r[1])
        out[-1].append(r)
    return out


def linkage(points, cut):
    """Naive complete linkage of intervals; of equal distances the first pair by least members."""
    def apart(a, b):
        o = min(a[1], b[1]) - max(a[0], b[0])
        return 1 - (min(o / (a[1] - a[0]), o / (b[1] - b[0])) if o > 0 else 0.0)

    groups = [[p] for p in points]
    while len(groups) > 1:
        best = min((max(apart(x, y) for x in a for y in b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best[0] > cut:
            break
        groups[best[1]] += groups.pop(best[2])
    return groups


def plain(calls, panel, accept):
    by, cells, axis = defaultdict(list), {}, defaultdict(list)
    for c in calls:
        by[c["indiv_test"], c["chr"]].append((c["start"], c["end"], c["call_id"], c["indiv_ref"], c["p"]))
    for r in panel:
        cells[r["contig"], r["sample"], r["w"]] = r["cp"]
        axis[r["contig"]].append((r["w"], r["start"], r["end"]))
    axis = {k: sorted(set(x)) for k, x in axis.items()}
    out = []
    for (test, chrom), rows in by.items():
        starts, ends = ([a[i] for a in axis[chrom]] for i in (1, 2))
        subs = []
        for cluster in sweep(rows):
            for g in linkage(sorted({r[:2] for r in cluster}), 0.85):
                own = [r for r in cluster if r[:2] in g]
                ll = sum(math.log10(r[4]) for r in own)
                if len(cluster) == 1 or (ll < -3 and len(own) >= 3):
                    s, e = statistics.median(r[0] for r in own), statistics.median(r[1] for r in own)
                    refs = {r[3] for r in own}
                    w0, w1 = bisect_left(starts, int(s)), bisect_left(ends, int(e))
                    d = []
                    for ref in refs:
                        pairs = [(cells[chrom, test, w], cells[chrom, ref, w]) for w in range(w0, w1) if (chrom, test, w) in cells and (chrom, ref, w) in cells]
                        if pairs:
                            d.append(abs(sum(a - b for a, b in pairs) / len(pairs)))
                    if len(own) > 1 and d and sum(d) / len(d) > accept:
                        subs.append((s, e, sorted(refs), ll))
        for c in sweep(subs):
            out.append((test, chrom, float(c[0][0]), float(max(x[1] for x in c)), ",".join(sorted({r for x in c for r in x[2]})), round(sum(x[3] for x in c), 6)))
    return sorted(out)


def test_whole_table_equals_a_plain_version(spark, tiny):
    got = sorted((r["indiv_test"], r["chr"], float(r["start"]), float(r["end"]), r["called_refs"], r["log_likelihood"]) for r in registry.queries()["refined_chain"](spark, tiny).collect())
    calls = [r.asDict() for r in queries_search.ratio_calls(spark, tiny).collect()]
    panel = [r.asDict() for r in v.panel(spark, tiny).collect()]
    want = plain(calls, panel, 0.6)
    assert len(got) == len(want) > 20
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-5)


def planted(spark, folder):
    """Ten samples of two copies; t has three in windows 20 to 30 and slightly more in 50 to 55, and one in 70 alone against one reference."""
    rows = []
    for i in range(10):
        for w in range(100):
            cp = 2.0 + ((i * 7 + w * 3) % 5) * 0.01
            if i == 0 and 20 <= w < 30:
                cp += 1.3
            if i in (0, 1, 2) and 50 <= w < 55:
                cp += 0.6
            rows.append(("chr1", f"s{i}", w, w * 500, w * 500 + 500, cp))
    panel = spark.createDataFrame(rows, "contig string, sample string, w long, start long, end long, cp double")
    path = str(folder / "panel")
    wr.write_panel(panel.withColumn("kind", F.lit("wssd")), path)
    with gzip.open(folder / "calls.tsv.gz", "wt") as f:
        f.write("indiv_ref\tindiv_test\trank\tchr\tstart\tend\tmu\tp\tadjusted_p\twindow_size\n")
        for r in range(3, 8):
            f.write(f"s{r}\ts0\t1\tchr1\t{10_000 + r % 2}\t{15_000 + r % 3}\t1.3\t0.0001\t*\t9\n")
            f.write(f"s{r}\ts0\t1\tchr1\t25000\t27500\t0.6\t0.0001\t*\t5\n")
            f.write(f"s{r}\ts0\t1\tchr1\t40000\t42000\t0.6\t0.0001\t*\t4\n")
        f.write("s3\ts0\t1\tchr1\t35000\t35500\t0.9\t0.0001\t*\t2\n")
    return path


def command(spark, folder, *more):
    out = str(folder / f"out{len(more)}{''.join(more[-1:]).replace('/', '')}")
    cli.run(spark, cli.parser().parse_args(["refine-calls", "--calls", str(folder / "calls.tsv.gz"), "--out", out, *more]))
    return [r["value"].split("\t") for r in spark.read.text(out).collect()][1:]


def test_command_checks_against_the_references(spark, tmp_path):
    panel = planted(spark, tmp_path)
    # without a panel every cluster that passes size and likelihood is a call, a lone call included
    assert [r[1] for r in command(spark, tmp_path)] == ["10001", "25000", "35000", "40000"]
    # with it: the first differs by more than 1; the second by 0.6, and its sample is of the lesser of two components; the third does not differ; the lone one goes
    assert [r[1:4] for r in command(spark, tmp_path, "--panel", panel, "--min-ref-cp-delta", "0.3")] == [["10001", "15001", "s3,s4,s5,s6,s7"], ["25000", "27500", "s3,s4,s5,s6,s7"]]
    assert [r[1] for r in command(spark, tmp_path, "--panel", panel, "--min-ref-cp-delta", "0.9")] == ["10001"]
    assert command(spark, tmp_path, "--panel", panel, "--limit-to-chr", "chr2") == []
    assert command(spark, tmp_path, "--panel", panel, "--subset-indivs", "s9:s8") == []


def test_many_samples_at_once_are_checked_against_their_own_windows(spark, tmp_path):
    panel = spark.read.parquet(planted(spark, tmp_path))
    rows = [(f"{t}{r}", t, f"s{r}", "chr1", 10_000, 15_000, 1e-4) for t in ("s0", "s1") for r in range(4, 8)]
    calls = spark.createDataFrame(rows, "call_id string, indiv_test string, indiv_ref string, chr string, start long, end long, p double")
    got = refine.refined(calls, panel, accept=0.5, min_delta=0.5).collect()
    assert [(r["indiv_test"], r["start"], r["end"]) for r in got] == [("s0", 10_000, 15_000)]
