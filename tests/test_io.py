"""Readers, writers, command line and the stream."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from windrow import cli
from windrow.plans import registry, views
from windrow.sources import readers as rd
from windrow.sources import writers as wr
from windrow.streaming.vcf_stream import filter_vcf_stream


@pytest.fixture(scope="module")
def panel_dir(spark, tiny, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panel") / "p")
    wr.write_panel(views.panel(spark, tiny).withColumn("kind", F.lit("wssd")), path)
    return path


def lines(spark, path):
    return [r["value"] for r in spark.read.text(path).collect()]


def test_panel_round_trip(spark, tiny, panel_dir, tmp_path):
    assert rd.panel(spark, panel_dir).count() == views.panel(spark, tiny).count()
    names = sorted(r["sample"] for r in rd.panel(spark, panel_dir).select("sample").distinct().collect())
    one = rd.panel(spark, panel_dir, "A", names[:2])
    assert {r["contig"] for r in one.select("contig").distinct().collect()} == {"A"}
    assert "PartitionFilters: [isnotnull(kind" in one._jdf.queryExecution().toString()
    wr.write_panel_meta(rd.panel(spark, panel_dir), str(tmp_path / "m"), 500, 100)
    meta = rd.panel_meta(spark, str(tmp_path / "m"))
    assert meta.first()["wnd_size"] == 500
    assert [r["sample"] for r in rd.ordered_samples(meta, names[2:4]).orderBy("ordinal").collect()] == names[2:4]


def test_window_size_is_checked(spark, tiny, tmp_path):
    views.track(spark, tiny).withColumn("sample", F.lit("x")).coalesce(1).write.parquet(str(tmp_path / "t"))
    (part,) = (tmp_path / "t").glob("part-*.parquet")
    good = tmp_path / "500_bp_x.parquet"
    part.rename(good)
    assert rd.window_track(spark, str(good), 500).count() > 0
    with pytest.raises(Exception, match="not of window size"):
        rd.window_track(spark, str(good), 300).count()


def test_segment_tables_name_both_samples(spark, tmp_path):
    with gzip.open(tmp_path / "dCGH_t1.r1.calls.gz", "wt") as f:
        f.write("1\tchr1\t10\t20\t0.5\t0.001\t*\t3\n")
    r = rd.segment_tables(spark, str(tmp_path)).first()
    assert (r["indiv_test"], r["indiv_ref"], r["adjusted_p"]) == ("t1", "r1", "*")
    cli.run(spark, cli.parser().parse_args(["merge-tables", "--calls", str(tmp_path), "--out", str(tmp_path / "out")]))
    assert rd.call_table(spark, str(tmp_path / "out")).first()["mu"] == 0.5


def test_refine_calls(spark, tmp_path):
    with gzip.open(tmp_path / "calls.tsv.gz", "wt") as f:
        f.write("indiv_ref\tindiv_test\trank\tchr\tstart\tend\tmu\tp\tadjusted_p\twindow_size\n")
        for i in range(4):
            f.write(f"r{i}\tt\t1\tchr1\t{100 + i}\t{200 + i}\t1.0\t0.0001\t*\t5\n")
        f.write("r1\tt\t1\tchr2\t5\t9\t0.01\t0.9\t-\t5\n")
    cli.run(spark, cli.parser().parse_args(["refine-calls", "--calls", str(tmp_path / "calls.tsv.gz"), "--out", str(tmp_path / "out")]))
    assert lines(spark, str(tmp_path / "out")) == ["contig\tstart\tend\tcalled_refs\tlog_likelihood", "chr1\t101\t201\tr0,r1,r2,r3\t-16.000000"]


def test_regions_and_genotypes(spark, panel_dir, tmp_path):
    (tmp_path / "r.bed").write_text("A 500 2500\nN\t0\t900\n\nZ 1 2\n")
    have = spark.createDataFrame([("A",), ("N",)], "contig string")
    assert rd.regions(spark, str(tmp_path / "r.bed"), have).count() == 2
    for command in (["genotype-regions"], ["genotype-regions", "--statistic", "mean"], ["genotype-loci", "--min-max-mu-d", "0.0", "--max-mu", "9"]):
        out = str(tmp_path / "-".join(command))
        cli.run(spark, cli.parser().parse_args([*command, "--panel", panel_dir, "--regions", str(tmp_path / "r.bed"), "--out", out]))
        assert spark.read.csv(out, sep="\t", header=True).columns[:3] == ["contig", "start", "end"]


def test_contrast_browser_and_gc(spark, panel_dir, tmp_path):
    s = sorted(r["sample"] for r in rd.panel(spark, panel_dir).select("sample").distinct().collect())
    cli.run(spark, cli.parser().parse_args(["contrast", "--panel", panel_dir, "--group1", s[0], "--group2", s[1], "--min-delta", "0.2", "--out", str(tmp_path / "c")]))
    assert all(len(x.split("\t")) == 5 for x in lines(spark, str(tmp_path / "c")))
    cli.run(spark, cli.parser().parse_args(["browser-track", "--panel", panel_dir, "--out", str(tmp_path / "b")]))
    assert all(len(x.split("\t")) == 9 for x in lines(spark, str(tmp_path / "b")))
    rd.panel(spark, panel_dir).select("contig", "w").distinct().withColumn("gc", F.lit(0.4)).write.parquet(str(tmp_path / "gc"))
    cli.run(spark, cli.parser().parse_args(["gc-stats", "--panel", panel_dir, "--gc", str(tmp_path / "gc"), "--out", str(tmp_path / "g")]))
    assert spark.read.csv(str(tmp_path / "g"), sep="\t", header=True).count() == 99


def test_genotype_matrix_and_vcf(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("contig\tstart\tend\ta\tb\nchr1\t10\t70000\t1\t2\nchr1\t90\t99\t-1\t2\n")
    g = rd.genotype_matrix(spark, str(tmp_path / "m.tsv"))
    assert g.where("cn is null").count() == 1
    assert sorted(map(tuple, wr.genotype_matrix(g, ["a", "b"]).collect())) == [("chr1", 10, 70000, 1, 2), ("chr1", 90, 99, -1, 2)]
    cli.run(spark, cli.parser().parse_args(["simple-genotypes", "--genotypes", str(tmp_path / "m.tsv"), "--out", str(tmp_path / "s")]))
    assert [r["n_long"] for r in spark.read.csv(str(tmp_path / "s/afs"), sep="\t", header=True).collect()] == ["1"]
    lls = spark.createDataFrame([("x", "a", 1, {1: -0.1, 2: -2.0}), ("x", "b", 2, {1: -3.0, 2: -0.2})], "locus string, sample string, cn int, lls map<int,double>")
    loci = spark.createDataFrame([("x", "chr1", 10, 70000, "A", -0.3)], "locus string, contig string, start long, end long, ref string, lprobs double")
    wr.write_text(wr.vcf_text_lines(lls, loci, ["a", "b", "c"]), str(tmp_path / "v"))
    out = lines(spark, str(tmp_path / "v"))
    assert out[0].startswith("##fileformat")
    assert out[1].startswith("#CHROM")
    assert out[2].split("\t") == ["1", "11", "chr1_11_70000", "A", "<CN0>", ".", "PASS", "END=70000;SVTYPE=DEL;LPROBS=-0.30", "GT:CN:GL:PL:CNL", "0/1:1:-2.00,-0.10,-1000.00:20,1,1000:-1000.00,-0.10,-2.00", "0/0:2:-0.20,-3.00,-1000.00:2,30,1000:-1000.00,-3.00,-0.20", "./.:0:0:0:0"]


def test_vcf_filter_batch_equals_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = "1\t5\t.\tN\t<CN0>\t.\tPASS\tEND=9;SVTYPE={};LPROBS={}"
    (tmp_path / "in/a.vcf").write_text("\n".join(["##x", row.format("DEL", -5), row.format("DEL", -50), row.format("DUP", -50)]) + "\n")
    cli.run(spark, cli.parser().parse_args(["filter-vcf", "--vcf", str(tmp_path / "in"), "--cutoff", "DEL=-20", "--out", str(tmp_path / "batch")]))
    q = filter_vcf_stream(spark, str(tmp_path / "in"), str(tmp_path / "stream"), str(tmp_path / "cp"), {"DEL": -20})
    q.awaitTermination(120)
    want = ["##x", row.format("DEL", -5), row.format("DUP", -50)]
    assert sorted(lines(spark, str(tmp_path / "batch"))) == sorted(want)
    assert sorted(lines(spark, str(tmp_path / "stream"))) == sorted(want)


def test_lines_of_calls(spark):
    c = spark.createDataFrame([(1, "c", 5, 9, 0.5, 1e-3, True, 2, "r", 1, 7)], "rank int, chr string, start long, end long, mu double, p double, significant boolean, window_size int, indiv_ref string, cluster_no long, call_id long")
    assert wr.segment_lines(c).first()["value"] == "1\tc\t5\t9\t0.500000\t1.00000000e-03\t*\t2"
    assert [r["value"] for r in wr.call_bed_lines(c, "x").orderBy("order").collect()] == ['track name="x"', "c\t5\t9\t-6.9078_r\t0.5000"]
    assert len(wr.cluster_bed_lines(c).first()["value"].split("\t")) == 9


def test_json_meta(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"indivs": ["b", "a"], "wnd_size": 1, "wnd_slide": 2}))
    assert [r["sample"] for r in rd.ordered_samples(rd.panel_meta(spark, str(tmp_path / "i.json"))).orderBy("ordinal").collect()] == ["b", "a"]


def test_vcf_lines_are_parsed_after_the_aggregation(spark, tiny):
    """A line names grouping keys only, so its filter could move below the panel's aggregation and parse every row of lineitem."""
    df = registry.queries()["vcf_filter"](spark, tiny)
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
