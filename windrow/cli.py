"""Command line: ``python -m windrow.cli <command> ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from windrow.operators import calls as cl
from windrow.operators import complex_loci as cx
from windrow.operators import genotype as gt
from windrow.operators import intervals as iv
from windrow.operators import mixture as mx
from windrow.operators import refine
from windrow.operators import tracks as tr
from windrow.operators import vcf
from windrow.sources import readers as rd
from windrow.sources import writers as wr


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="windrow")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, *arguments):
        s = sub.add_parser(name)
        for flag, options in arguments:
            s.add_argument(flag, **options)
        return s

    path, out = {"required": True}, ("--out", {"required": True})
    command("merge-tables", ("--calls", path), out)
    command("build-panel", ("--tracks", path), ("--window-size", {"type": int, "required": True}), ("--slide", {"type": int, "default": 0}), out)
    command(
        "refine-calls", ("--calls", path), ("--p-cutoff", {"type": float, "default": 0.005}), ("--min-windows", {"type": int, "default": 2}), ("--min-mu", {"type": float, "default": 0.5}),
        ("--max-callsize", {"type": int, "default": 200_000}), ("--min-overlapping-calls", {"type": int, "default": 3}), ("--no-p-adjust", {"action": "store_true"}),
        ("--panel", {}), ("--accept-ref-cp-delta", {"type": float, "default": 1.0}), ("--min-ref-cp-delta", {"type": float, "default": 0.0}), ("--limit-to-chr", {}), ("--subset-indivs", {}), out,
    )
    command("genotype-regions", ("--panel", path), ("--regions", path), ("--statistic", {"choices": ["mean", "median"], "default": "median"}), out)
    command("genotype-loci", ("--panel", path), ("--regions", path), ("--max-mu", {"type": float, "default": 7.0}), ("--min-max-mu-d", {"type": float, "default": 0.5}), ("--singleton-sigma", {"type": float, "default": 5.0}), ("--dup-sigma", {"type": float, "default": 4.0}), ("--target-loci", {}), ("--bin", {"type": int, "default": 1_000_000, "help": "width of the bins in which loci meet targets"}), ("--subset-samples", {}), ("--info", {}), out)
    command("contrast", ("--panel", path), ("--group1", path), ("--group2", path), ("--min-delta", {"type": float, "default": 0.5}), out)
    command("gc-stats", ("--panel", path), ("--gc", path), out)
    command("browser-track", ("--panel", path), out)
    command("filter-vcf", ("--vcf", path), ("--cutoff", {"action": "append", "default": [], "help": "TYPE=LPROBS"}), out)
    command("simple-genotypes", ("--genotypes", path), out)
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """Execute one parsed command."""
    if a.command == "merge-tables":
        wr.write_tsv(rd.segment_tables(spark, a.calls), a.out)
    elif a.command == "build-panel":
        p = rd.stacked([rd.window_track(spark, a.tracks, a.window_size)])
        wr.write_panel(p, a.out)
        wr.write_panel_meta(p, f"{a.out}-meta", a.window_size, a.slide)
    elif a.command == "refine-calls":
        c = rd.call_table(spark, a.calls)
        for column, names in (("chr", a.limit_to_chr), ("indiv_test", a.subset_indivs)):
            c = c.where(F.col(column).isin(names.split(":"))) if names else c
        c = cl.filtered(c, a.p_cutoff, a.min_windows, a.min_mu, not a.no_p_adjust, a.max_callsize)
        # numbers by content: the same calls however often they are read
        c = c.withColumn("call_id", F.xxhash64(*c.columns))
        panel = rd.panel(spark, a.panel) if a.panel else None
        final = refine.refined(c, panel, min_calls=a.min_overlapping_calls, accept=a.accept_ref_cp_delta, min_delta=a.min_ref_cp_delta)
        wr.write_text(wr.resolved_lines(final), a.out)
    elif a.command in ("genotype-regions", "genotype-loci"):
        subset = getattr(a, "subset_samples", None)
        p = rd.panel(spark, a.panel, samples=subset.split(":") if subset else None)
        axis = p.select("contig", "w", "start", "end").distinct()
        r = rd.regions(spark, a.regions)
        if getattr(a, "target_loci", None):
            # only regions that overlap a target
            t = rd.regions(spark, a.target_loci).select("contig", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
            r = r.join(iv.interval_join(r, t, ["contig"], a.bin).select("contig", "start", "end").distinct(), ["contig", "start", "end"], "left_semi")
        rule = getattr(a, "statistic", "genotyper")
        cells = iv.slice_join(iv.slices(r, axis, rule), p)
        keys = ["contig", "start", "end"]
        samples = [x["sample"] for x in p.select("sample").distinct().orderBy("sample").collect()]  # column names of a wide table
        if a.command == "genotype-regions":
            v = cells.groupBy(*keys, "sample").agg((F.avg if rule == "mean" else F.median)("cp").alias("value"))
            wr.write_tsv(wr.value_matrix(v, keys, samples, "value"), a.out)
        else:
            o = cells.withColumn("locus", F.format_string("%s:%d-%d", *keys)).groupBy("locus", *keys, "sample").agg(F.avg("cp").alias("mu"))
            g = mx.genotypes(o, ["locus", *keys])
            if a.info:
                g = g.persist()  # a row for each locus and sample, read by both outputs
                of = F.format_string("%s:%d-%d", *keys).alias("locus")
                spans = cells.groupBy(of, "contig", "sample").agg(F.min("w").alias("w0"), (F.max("w") + 1).alias("w1"))
                wr.write_text(wr.info_lines(gt.info(g, cells.select(of, "sample", "w", "cp"), r.select(of, *keys), singles=cx.singleton_z(p, spans))), a.info)
            s = gt.label_stats(g)
            bad = gt.quality(s, g, a.max_mu, a.min_max_mu_d, a.singleton_sigma, a.dup_sigma).where("fail").select("locus")
            named = g.join(gt.labels_to_cn(s).select("locus", "label", "cn"), ["locus", "label"]).join(bad, "locus", "left_anti")
            wr.write_tsv(wr.genotype_matrix(named, samples), a.out)
    elif a.command == "contrast":
        c = gt.contrasts(rd.panel(spark, a.panel), a.group1.split(":"), a.group2.split(":"), a.min_delta)
        wr.write_text(wr.contrast_lines(c), a.out)
    elif a.command == "gc-stats":
        gc = spark.read.schema("contig string, w long, gc double").parquet(a.gc)
        wr.write_tsv(gt.gc_bins(rd.panel(spark, a.panel).join(gc, ["contig", "w"])).orderBy("bin"), a.out)
    elif a.command == "browser-track":
        wr.write_text(wr.browser_lines(tr.bands(rd.panel(spark, a.panel), ["contig", "sample"])), a.out)
    elif a.command == "filter-vcf":
        cut = {k: float(x) for k, x in (c.split("=", 1) for c in a.cutoff)}
        vcf.filtered_lines(rd.vcf_lines(spark, a.vcf), cut).write.mode("overwrite").text(a.out)
    elif a.command == "simple-genotypes":
        g = rd.genotype_matrix(spark, a.genotypes).withColumn("locus", F.concat_ws(":", "contig", "start", "end"))
        wr.write_tsv(gt.simple_loci(g), f"{a.out}/loci")
        wr.write_tsv(gt.allele_spectrum(g).orderBy("af"), f"{a.out}/afs")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    run(SparkSession.builder.appName("windrow").config("spark.sql.session.timeZone", "UTC").getOrCreate(), a)


if __name__ == "__main__":
    main()
