"""Queries that write a table in one of the library's formats and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.operators import calls as cl
from windrow.operators import genotype as gt
from windrow.operators import nullmodel as nm
from windrow.operators import tracks as tr
from windrow.plans import sql as sq
from windrow.plans import views as v
from windrow.plans.queries_calls import _SWEEP, clustered
from windrow.plans.queries_genotype import _GENO, geno
from windrow.plans.queries_tracks import r6
from windrow.sources import readers as rd
from windrow.sources import writers as wr
from windrow.sources.scratch import scratch
from windrow.streaming import vcf_stream

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


@query("io_panel", v.sql(v.PANEL, select="SELECT contig, sample, w, start, \"end\", round(cp, 6) AS cp FROM panel WHERE contig = 'N' AND sample IN ('1', '2', '3')"))
def io_panel(spark, d):
    """One contig and some samples of a stored panel of two kinds."""
    p = v.panel(spark, d)
    at = scratch(spark, "panel")
    wr.write_panel(p.withColumn("kind", F.lit("wssd")).unionByName(p.withColumn("cp", F.col("cp") + 1).withColumn("kind", F.lit("sunk"))), at)
    return rd.panel(spark, at, "N", ["1", "2", "3"]).select("contig", F.col("sample").cast("string").alias("sample"), "w", "start", "end", r6(F.col("cp"), "cp"))


@query("io_panel_meta", v.sql(v.PANEL, select="SELECT CAST(row_number() OVER (ORDER BY sample) - 1 AS INT) AS ordinal, sample FROM (SELECT DISTINCT sample FROM panel)"))
def io_panel_meta(spark, d):
    at = scratch(spark, "meta")
    wr.write_panel_meta(v.panel(spark, d), at, 500, 250)
    return rd.ordered_samples(rd.panel_meta(spark, at)).select("ordinal", "sample")


@query("io_window_track", v.sql(v.PANEL, select="SELECT w, start, \"end\" FROM panel WHERE sample = '1' AND contig = 'A'"))
def io_window_track(spark, d):
    """The axis of one contig from a track file whose name gives the window size."""
    at = scratch(spark, "500_bp_1")
    v.panel(spark, d).where("sample = '1'").select("sample", "contig", "w", "start", "end", "cp").coalesce(1).write.parquet(f"{at}/x")
    name = spark.read.parquet(f"{at}/x").select(F.col("_metadata.file_path").alias("p")).first()
    if name is None:  # no such sample
        return v.panel(spark, d).where("false").select("w", "start", "end")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(name["p"]), jvm.org.apache.hadoop.fs.Path(f"{at}/500_bp_1.parquet")
    source.getFileSystem(conf).rename(source, target)
    return rd.contig_windows(rd.window_track(spark, f"{at}/500_bp_1.parquet", 500), "A")


@query("io_stacked_panel", v.sql(v.PANEL, "m AS (SELECT contig, sample, median(cp) FILTER (cp <> 0) AS m FROM panel GROUP BY 1, 2)", select="SELECT contig, sample, w, round(CASE WHEN contig = 'R' OR cp = 0 THEN cp ELSE cp + (2 - m) END, 6) AS cp, 'wssd' AS kind FROM panel JOIN m USING (contig, sample)"))
def io_stacked_panel(spark, d):
    p = v.panel(spark, d)
    even = F.col("sample").cast("int") % 2 == 0
    return rd.stacked([p.where(even), p.where(~even)], ("R",)).select("contig", "sample", "w", r6(F.col("cp"), "cp"), "kind")


_ROUNDED = "SELECT indiv_ref, chr, start, \"end\", round(mu, 4) AS mu, round(p, 9) AS p, window_size FROM calls"


def _as_calls(c: DataFrame) -> DataFrame:
    return c.select("indiv_ref", F.lit("t").alias("indiv_test"), F.col("call_id").cast("int").alias("rank"), "chr", "start", "end", "mu", "p", F.lit("-").alias("adjusted_p"), "window_size")


@query("io_call_table", v.sql(v.CALLS, select=_ROUNDED))
def io_call_table(spark, d):
    """The merged call table as gzip TSV."""
    at = scratch(spark, "calls")
    _as_calls(v.calls(spark, d)).write.option("compression", "gzip").csv(at, sep="\t", header=True)
    return rd.call_table(spark, at).select("indiv_ref", "chr", "start", "end", F.round("mu", 4).alias("mu"), F.round("p", 9).alias("p"), "window_size")


@query("io_segment_tables", v.sql(v.CALLS, select="SELECT indiv_ref, 't1' AS indiv_test, chr, start, \"end\", round(mu, 4) AS mu, window_size FROM calls"))
def io_segment_tables(spark, d):
    """A caller's files by pair of samples, written as lines in order of p, merged again; the file names give the pair."""
    c = v.calls(spark, d)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = scratch(spark, "pairs")
    folder = jvm.org.apache.hadoop.fs.Path(at)
    fs = folder.getFileSystem(conf)
    fs.mkdirs(folder)
    for ref in [f"s{i}" for i in range(10)]:
        own = c.where(F.col("indiv_ref") == ref).select("chr", "start", "end", "mu", "p", "window_size", F.col("call_id").alias("rank"), (F.col("p") < 0.01).alias("significant"))
        wr.write_text(wr.segment_lines(own).coalesce(1), f"{at}/_{ref}")
        for k, f in enumerate(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{at}/_{ref}/part-*"))):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{at}/dCGH_t1.{ref}.{k}.tab"))
    t = rd.segment_tables(spark, f"{at}/dCGH_*.tab")
    return t.select("indiv_ref", "indiv_test", "chr", "start", "end", F.round("mu", 4).alias("mu"), "window_size")


@query("io_regions", v.sql(v.CALLS, _SWEEP, select="SELECT chr AS contig, min(start) AS start, max(\"end\") AS \"end\" FROM clustered WHERE chr IN (SELECT chr FROM calls GROUP BY 1 HAVING avg(mu) > (SELECT avg(mu) FROM calls)) GROUP BY chr, cluster_no"))
def io_regions(spark, d):
    """Merged calls as headerless BED regions, read for the contigs that a contig table names: those with a mean above that of all."""
    at, known = scratch(spark, "regions"), scratch(spark, "contigs")
    c = clustered(spark, d)
    m = c.groupBy("chr", "cluster_no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    wr.write_text(wr.bed_lines(m, ["chr", "start", "end"]), at)
    mean = c.agg(F.avg("mu").alias("m"))
    named = c.groupBy("chr").agg(F.avg("mu").alias("own"), F.max("end").alias("length")).join(F.broadcast(mean), F.col("own") > F.col("m"))  # one row
    named.select(F.concat_ws("\t", "chr", F.col("length").cast("string"))).write.text(known)
    return rd.regions(spark, at, rd.contigs(spark, known)).select("contig", "start", "end")


@query("io_annotations", v.sql(v.CALLS, v.DUPS, select="SELECT DISTINCT chr, start, \"end\", 'dup' AS name FROM dups WHERE chr = 'click' AND start < 1704500000000000 AND \"end\" > 1704100000000000"))
def io_annotations(spark, d):
    """Annotation lines by column position, fetched by range."""
    at = scratch(spark, "dups")
    line = F.concat_ws("\t", F.lit("dup"), "chr", F.col("start").cast("string"), F.col("end").cast("string"))
    v.dups(spark, d).distinct().select(line).write.text(at)
    a = rd.annotations(spark, at, (1, 2, 3, 0), ("chr", "start", "end", "name"))
    return rd.fetched(a, "click", 1_704_100_000_000_000, 1_704_500_000_000_000)


@query("io_genotype_matrix", v.sql(v.PANEL, _GENO, select="SELECT g.contig, g.start, g.\"end\", s.sample, CASE WHEN x.cn <> 3 THEN x.cn END AS cn FROM (SELECT DISTINCT contig, start, \"end\" FROM geno) g CROSS JOIN (SELECT DISTINCT sample FROM geno) s LEFT JOIN geno x ON x.contig = g.contig AND x.start = g.start AND x.sample = s.sample"))
def io_genotype_matrix(spark, d):
    """A wide matrix with -1 for what is not assessed, read back as long rows."""
    g = geno(spark, d).withColumn("cn", F.when(F.col("cn") != 3, F.col("cn")))
    samples = [r["sample"] for r in g.select("sample").distinct().orderBy("sample").collect()]  # column names
    at = scratch(spark, "matrix")
    wr.write_tsv(wr.genotype_matrix(g, samples), at)
    return rd.genotype_matrix(spark, at)


@query("io_cluster_bed", v.sql(v.CALLS, _SWEEP, select="SELECT chr, CAST(start AS VARCHAR) AS start, CAST(\"end\" AS VARCHAR) AS \"end\", chr || '-' || cluster_no AS name, 9 AS columns FROM clustered"))
def io_cluster_bed(spark, d):
    """BED9 lines of clustered calls."""
    at = scratch(spark, "bed")
    wr.write_text(wr.cluster_bed_lines(clustered(spark, d)), at)
    f = F.split("value", "\t")
    return spark.read.text(at).select(f[0].alias("chr"), f[1].alias("start"), f[2].alias("end"), f[3].alias("name"), F.size(f).alias("columns"))


@query("io_call_bed", v.sql(v.CALLS, select="SELECT 'track name=\"calls\"' AS value UNION ALL SELECT chr || chr(9) || start || chr(9) || \"end\" || chr(9) || printf('%.4f', ln(p)) || '_' || indiv_ref || chr(9) || printf('%.4f', mu) FROM calls"))
def io_call_bed(spark, d):
    at = scratch(spark, "bed")
    wr.write_text(wr.call_bed_lines(v.calls(spark, d), "calls"), at)
    return spark.read.text(at)


@query("io_cluster_summary", v.sql(v.CALLS, _SWEEP, select="SELECT concat_ws(chr(9), chr, min(start), max(\"end\"), count(*), printf('%.6f', sum(log10(p))), array_to_string(list_sort(list(DISTINCT indiv_ref)), ',')) AS value FROM clustered GROUP BY chr, cluster_no"))
def io_cluster_summary(spark, d):
    """Cluster summary rows."""
    at = scratch(spark, "clusters")
    wr.write_text(wr.cluster_lines(clustered(spark, d), ["chr"]), at)
    return spark.read.text(at)


@query("io_cluster_elements", v.sql(v.CALLS, _SWEEP, select="SELECT concat_ws(chr(9), chr, cluster_no, indiv_ref, start, \"end\", printf('%.6f', mu), printf('%.8e', p)) AS value FROM clustered"))
def io_cluster_elements(spark, d):
    at = scratch(spark, "elements")
    wr.write_text(wr.cluster_element_lines(clustered(spark, d)), at)
    return spark.read.text(at)


@query("io_resolved", v.sql(v.CALLS, _SWEEP, select="SELECT 'contig' || chr(9) || 'start' || chr(9) || 'end' || chr(9) || 'called_refs' || chr(9) || 'log_likelihood' AS value UNION ALL SELECT concat_ws(chr(9), chr, CAST(trunc(median(start)) AS BIGINT), CAST(trunc(median(\"end\")) AS BIGINT), array_to_string(list_sort(list(DISTINCT indiv_ref)), ','), printf('%.6f', sum(log10(p)))) FROM clustered GROUP BY chr, cluster_no HAVING count(*) = 1 OR (round(sum(log10(p)), 9) < -3 AND count(*) >= 2)"))
def io_resolved(spark, d):
    """Resolved calls with a header."""
    at = scratch(spark, "resolved")
    wr.write_text(wr.resolved_lines(cl.resolved(clustered(spark, d).withColumn("sub", F.lit(0)), ["chr"])), at)
    return spark.read.text(at)


@query("io_browser_track", v.sql(v.PANEL, "r AS (SELECT *, sum(nw) OVER (PARTITION BY contig, sample ORDER BY w) AS g FROM (SELECT *, CASE WHEN lag(cn) OVER (PARTITION BY contig, sample ORDER BY w) = cn THEN 0 ELSE 1 END AS nw FROM (SELECT *, CAST(least(round(cp), 10) AS INT) AS cn FROM panel)))", select="SELECT contig, CAST(min(start) AS VARCHAR) AS start, CAST(max(\"end\") AS VARCHAR) AS \"end\", CAST(any_value(cn) AS VARCHAR) AS cn FROM r GROUP BY contig, sample, g"))
def io_browser_track(spark, d):
    at = scratch(spark, "track")
    wr.write_text(wr.browser_lines(tr.bands(v.panel(spark, d), ["contig", "sample"])), at)
    f = F.split("value", "\t")
    return spark.read.text(at).select(f[0].alias("contig"), f[1].alias("start"), f[2].alias("end"), f[3].alias("cn"))


_CONTRAST = """
g AS (SELECT contig, w, min(start) AS start, max("end") AS "end", min(cp) FILTER (x) AS lo1, max(cp) FILTER (NOT x) AS hi2, avg(cp) FILTER (x) AS m1, avg(cp) FILTER (NOT x) AS m2 FROM (SELECT *, sample IN ('0', '1') AS x FROM panel WHERE sample IN ('0', '1', '2', '3')) GROUP BY 1, 2),
h AS (SELECT *, w - row_number() OVER (PARTITION BY contig ORDER BY w) AS r FROM g WHERE lo1 - hi2 > 0.05)""".strip()


@query("io_contrasts", v.sql(v.PANEL, _CONTRAST, select="SELECT concat_ws(chr(9), contig, min(start), max(\"end\"), printf('%.3f', avg(m1)), printf('%.3f', avg(m2))) AS value FROM h GROUP BY contig, r"))
def io_contrasts(spark, d):
    at = scratch(spark, "contrasts")
    wr.write_text(wr.contrast_lines(gt.contrasts(v.panel(spark, d), ["0", "1"], ["2", "3"], 0.05)), at)
    f = F.split("value", "\t")
    return spark.read.text(at).select(F.concat_ws("\t", f[0], f[1], f[2], *(F.format_string("%.3f", f[i].cast("double")) for i in (3, 4))).alias("value"))


_STREAM = "SELECT concat_ws(chr(9), contig, w * 500 + 1, '.', 'N', '<CNV>', '.', 'PASS', 'END=' || (w * 500 + 500) || ';SVTYPE=DEL;LPROBS=' || -(w % 50)) AS value FROM (SELECT DISTINCT contig, w FROM panel) WHERE -(w % 50) >= -20"


@query("stream_vcf_filter", v.sql(v.PANEL, select=_STREAM))
def stream_vcf_filter(spark, d):
    """The line filter as a stream over a folder of VCF text, one batch."""
    source, out, mark = (scratch(spark, x) for x in ("in", "out", "mark"))
    w = v.panel(spark, d).select("contig", "w").distinct()
    line = F.concat_ws("\t", "contig", (F.col("w") * 500 + 1).cast("string"), F.lit("."), F.lit("N"), F.lit("<CNV>"), F.lit("."), F.lit("PASS"), F.concat(F.lit("END="), (F.col("w") * 500 + 500).cast("string"), F.lit(";SVTYPE=DEL;LPROBS="), (-(F.col("w") % 50)).cast("string")))
    w.select(line.alias("value")).write.text(source)
    vcf_stream.filter_vcf_stream(spark, source, out, mark, {"DEL": -20.0}).awaitTermination()
    return spark.read.text(out)


@query("reference_bases", v.sql(v.PANEL, select="SELECT contig, start, CASE WHEN w % 3 = 0 THEN chr(65 + CAST(w % 5 AS INT)) ELSE 'N' END AS ref FROM (SELECT DISTINCT contig, w, start FROM panel)"))
def reference_bases(spark, d):
    w = v.panel(spark, d).select("contig", "w", "start").distinct()
    bases = w.where("w % 3 = 0").select("contig", (F.col("start") + 1).alias("pos"), F.chr(65 + F.col("w") % 5).alias("base"))
    return rd.reference_bases(w.select("contig", "start"), bases).select("contig", "start", "ref")


@query("io_merged_bed", v.sql(v.CALLS, _SWEEP, select="SELECT concat_ws(chr(9), chr, min(start), max(\"end\")) AS value FROM clustered GROUP BY chr, cluster_no"))
def io_merged_bed(spark, d):
    """Three-column BED of merged calls."""
    at = scratch(spark, "merged")
    m = clustered(spark, d).groupBy("chr", "cluster_no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    wr.write_text(wr.bed_lines(m, ["chr", "start", "end"]), at)
    return spark.read.text(at)


_WIDTHS = (1, 2, 4, 8)
_CAL = [c for w in _WIDTHS for c in (
    f"m{w} AS (SELECT x FROM (SELECT row_number() OVER (PARTITION BY contig ORDER BY w) AS rn, avg(cp - 1.9) OVER (PARTITION BY contig ORDER BY w ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS x FROM track) WHERE rn > {w})",
    sq.histogram(f"h{w}", f"m{w}"), f"p{w} AS (SELECT {w} AS width, mu, {sq.density(f'h{w}', 'mu')} AS c FROM mus)",
)]


@query("calibration_table", v.sql(v.TRACK, "mus AS (SELECT k * 5 / 100.0::DOUBLE AS mu FROM range(1, 20) r(k))", *_CAL, select=f"SELECT CAST(width AS INT) AS width, round(greatest({sq.folded('c')}, 0), 6) AS p, mu FROM (" + " UNION ALL ".join(f"SELECT * FROM p{w}" for w in _WIDTHS) + ")"))
def calibration_table(spark, d):
    """p of means from 0.05 to 0.95 over several widths under the track's null distribution, written and read back."""
    t = v.track(spark, d).withColumn("cp", F.col("cp") - 1.9)
    at = scratch(spark, "calibration")
    wr.write_text(wr.calibration_lines(nm.calibration(t, ["contig"], _WIDTHS, [k * 5 / 100 for k in range(1, 20)])), at)
    return rd.calibration(spark, at)
