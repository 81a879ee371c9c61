"""Further queries: complex loci, alternatives, histograms, with their DuckDB SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from windrow.operators import calls as cl
from windrow.operators import complex_loci as cx
from windrow.operators import intervals as iv
from windrow.operators import segmentation as sg
from windrow.plans import views as v
from windrow.plans.queries_calls import BIN
from windrow.plans.queries_genotype import _OBS, obs
from windrow.plans.queries_tracks import r6

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


_CLOSED = """
sw AS (SELECT *, max("end") OVER (PARTITION BY chr ORDER BY start, "end", call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM calls)""".strip()


@query("closed_chunks", v.sql(v.CALLS, _CLOSED, select="SELECT call_id, chr, CAST(sum(CASE WHEN pm IS NULL OR start > pm THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY start, \"end\", call_id) AS BIGINT) AS cluster_no FROM sw"))
def closed_chunks(spark, d):
    return iv.overlap_clusters(v.calls(spark, d), ["chr"], ["start", "end", "call_id"], closed=True).select("call_id", "chr", "cluster_no")


@query("merged_starts", v.sql(v.CALLS, select="SELECT chr, start % 500 AS start, median(\"end\" % 500) AS \"end\", round(sum(log10(p)), 6) AS log10_p, count(*) AS n FROM calls GROUP BY 1, 2"))
def merged_starts(spark, d):
    c = v.calls(spark, d).withColumn("start", F.col("start") % 500).withColumn("end", F.col("end") % 500)
    return cl.merged_starts(c, ["chr"]).select("chr", "start", "end", r6(F.col("log10_p"), "log10_p"), "n")


_SEG = "sgm AS (SELECT contig, sample, w, w * 500 AS start, w * 500 + 500 AS \"end\", CAST(least(round(cp), 4) AS INT) AS cn FROM panel)"


def _segments(spark, d):
    return v.panel(spark, d).select("contig", "sample", "w", "start", "end", F.least(F.round("cp"), F.lit(4.0)).cast("int").alias("cn"))


@query("merged_abutting", v.sql(v.PANEL, _SEG, "r AS (SELECT *, sum(nw) OVER (PARTITION BY contig, sample ORDER BY start) AS g FROM (SELECT *, CASE WHEN lag(\"end\") OVER (PARTITION BY contig, sample ORDER BY start) = start THEN 0 ELSE 1 END AS nw FROM sgm WHERE cn <> 2))", select="SELECT contig, sample, min(start) AS start, max(\"end\") AS \"end\", count(*) AS n FROM r GROUP BY contig, sample, g"))
def merged_abutting(spark, d):
    return cx.merged_abutting(_segments(spark, d).where("cn <> 2"), ["contig", "sample"])


@query("merged_equal_vectors", v.sql(v.PANEL, _SEG, "vec AS (SELECT contig, start, \"end\", array_to_string(list(sample || ':' || cn ORDER BY sample || ':' || cn), ',') AS labels FROM sgm GROUP BY 1, 2, 3)", "r AS (SELECT *, sum(nw) OVER (PARTITION BY contig ORDER BY start) AS g FROM (SELECT *, CASE WHEN lag(labels) OVER (PARTITION BY contig ORDER BY start) = labels THEN 0 ELSE 1 END AS nw FROM vec))", select="SELECT contig, min(start) AS start, max(\"end\") AS \"end\", first(labels ORDER BY start) AS labels FROM r GROUP BY contig, g"))
def merged_equal_vectors(spark, d):
    cells = _segments(spark, d).groupBy("contig", "start", "end").agg(F.array_sort(F.collect_list(F.concat_ws(":", "sample", F.col("cn").cast("string")))).alias("labels"))
    return cx.merged_equal(cells, ["contig"]).select("contig", "start", "end", F.array_join("labels", ",").alias("labels"))


@query("adjacent_segments", v.sql(v.PANEL, _SEG, select="SELECT contig, sample, coalesce(bool_or(nx = \"end\"), false) AS adjacent FROM (SELECT *, lead(start) OVER (PARTITION BY contig, sample ORDER BY start) AS nx FROM sgm WHERE cn > 2) GROUP BY 1, 2"))
def adjacent_segments(spark, d):
    return cx.has_adjacent(_segments(spark, d).where("cn > 2"), ["contig", "sample"])


@query("added_segments", v.sql(v.CALLS, select="SELECT call_id AS seg_id, chr, start, \"end\" FROM calls WHERE call_id % 2 = 0 UNION ALL SELECT call_id, chr, start, \"end\" FROM calls c WHERE call_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM calls b WHERE b.call_id % 2 = 0 AND b.chr = c.chr AND c.start < b.\"end\" AND b.start < c.\"end\")"))
def added_segments(spark, d):
    c = v.calls(spark, d).select(F.col("call_id").alias("seg_id"), "chr", "start", "end")
    return cx.added(c.where("seg_id % 2 = 0"), c.where("seg_id % 2 = 1"), BIN)


@query("dup_existence", v.sql(v.CALLS, v.DUPS, select="SELECT call_id, EXISTS (SELECT 1 FROM dups b WHERE b.chr = c.chr AND c.start < b.\"end\" AND b.start < c.\"end\") AS in_dup FROM calls c"))
def dup_existence(spark, d):
    c = v.calls(spark, d)
    b = v.dups(spark, d).select("chr", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    hit = iv.interval_join(c, b, ["chr"], BIN).select("call_id").distinct().withColumn("in_dup", F.lit(True))
    return c.select("call_id").join(hit, "call_id", "left").select("call_id", F.coalesce("in_dup", F.lit(False)).alias("in_dup"))


@query("normal_rejection", v.sql(v.PANEL, v.REGION_VALUES, "md AS (SELECT region_id, median(cp) AS m FROM regions r JOIN panel p ON p.contig = r.contig AND r.start < p.\"end\" AND p.start < r.\"end\" WHERE r.start < r.\"end\" GROUP BY 1)", select="SELECT r.region_id AS call_id FROM regions r LEFT JOIN md ON md.region_id = r.region_id WHERE NOT coalesce(\"end\" - start >= 1500 AND m > 1.9 AND m < 2.1, false)"))
def normal_rejection(spark, d):
    r = v.regions(spark).select(F.col("region_id").alias("call_id"), F.col("contig").alias("chr"), "start", "end")
    return cl.not_normal(r, v.panel(spark, d), 1500, 1.9, 2.1, 10 * v.WIDTH).select("call_id")


@query("dbscan_1d", v.sql(*_OBS, "nn AS (SELECT a.locus, a.sample, a.mu, count(*) >= 3 AS core FROM obs a JOIN obs b ON a.locus = b.locus AND b.mu BETWEEN a.mu - 0.05 AND a.mu + 0.05 GROUP BY 1, 2, 3)", "cr AS (SELECT *, sum(nw) OVER (PARTITION BY locus ORDER BY mu, sample) - 1 AS label FROM (SELECT *, CASE WHEN mu - lag(mu) OVER (PARTITION BY locus ORDER BY mu, sample) <= 0.05 THEN 0 ELSE 1 END AS nw FROM nn WHERE core))", "j AS (SELECT n.locus, n.sample, n.mu, c.label, abs(c.mu - n.mu) AS dist, c.mu <= n.mu AS lf FROM nn n LEFT JOIN cr c ON c.locus = n.locus AND abs(c.mu - n.mu) <= 0.05)", select="SELECT locus, sample, CAST(coalesce(first(label ORDER BY dist, lf DESC), -1) AS INT) AS label FROM j GROUP BY 1, 2"))
def dbscan_1d(spark, d):
    return cx.dbscan(obs(spark, d), 0.05, 3).select("locus", "sample", "label")


_SIL = """
pd AS (SELECT a.locus, a.sample, a.label, b.label AS other, sum(abs(a.mu - b.mu)) AS s, count(*) AS n FROM obs a JOIN obs b ON a.locus = b.locus GROUP BY 1, 2, 3, 4),
ab AS (SELECT locus, sample, max(CASE WHEN label = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b FROM pd GROUP BY 1, 2)""".strip()


@query("silhouette", v.sql(*_OBS, _SIL, select="SELECT locus, round(avg(CASE WHEN a IS NULL THEN 0 WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab WHERE b IS NOT NULL GROUP BY 1"))
def silhouette(spark, d):
    return cx.silhouette(obs(spark, d)).select("locus", r6(F.col("silhouette"), "silhouette"))


@query("mean_shift_labels")
def mean_shift_labels(spark, d):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["locus", "sample"]].assign(label=cx.mean_shift(pdf.mu.to_numpy(float), 0.2))

    return obs(spark, d).select("locus", "sample", "mu").groupBy("locus").applyInPandas(of, "locus long, sample string, label int")


_Z = """
lo AS (SELECT DISTINCT contig || ':' || w // 2 AS locus, contig, w // 2 * 2 AS w0, w // 2 * 2 + 2 AS w1 FROM panel),
fl AS (SELECT locus, p.contig, p.sample, p.w, cp FROM lo JOIN panel p USING (contig) WHERE (p.w >= greatest(0, w0 - 23) AND p.w < w0 - 3) OR (p.w >= w1 + 3 AND p.w < w1 + 23)),
mv AS (SELECT locus, sample, cp, (cp + lag(cp) OVER (PARTITION BY locus, sample ORDER BY w)) / 2 AS m FROM fl),
fs AS (SELECT locus, sample, avg(m) AS mu, stddev_pop(m) AS sd FROM mv WHERE m IS NOT NULL GROUP BY 1, 2),
ow AS (SELECT locus, sample, avg(cp) AS own FROM lo JOIN panel USING (contig) WHERE w >= w0 AND w < w1 GROUP BY 1, 2)""".strip()


def window_pairs(p):
    """A locus of two windows at every even window of each contig, for each of the contig's samples."""
    at = p.select("contig", F.floor(F.col("w") / 2).alias("b")).distinct()
    s = at.join(p.select("contig", "sample").distinct(), "contig")
    return s.select("contig", "sample", F.concat_ws(":", "contig", F.col("b").cast("string")).alias("locus"), (F.col("b") * 2).alias("w0"), (F.col("b") * 2 + 2).alias("w1"))


@query("singleton_z", v.sql(v.PANEL, _Z, select="SELECT locus, sample, CASE WHEN sd > 1e-12 THEN round(abs((own - mu) / sd), 6) END AS cp_z FROM ow JOIN fs USING (locus, sample)"))
def singleton_z(spark, d):
    p = v.panel(spark, d)
    return cx.singleton_z(p, window_pairs(p)).select("locus", "sample", r6(F.col("cp_z"), "cp_z"))


@query("histogram_2d", v.sql(v.PANEL, select="SELECT CAST(floor(w / 10.0) AS BIGINT) AS bx, CAST(floor(cp / CAST(0.25 AS DOUBLE)) AS BIGINT) AS \"by\", count(*) AS n FROM panel GROUP BY 1, 2"))
def histogram_2d(spark, d):
    return cx.histogram_2d(v.panel(spark, d), "w", "cp", 10.0, 0.25)


@query("viz_histogram", v.sql(v.PANEL, "s AS (SELECT contig, min(cp) AS lo, max(cp) AS hi, count(*) AS k FROM panel GROUP BY 1)", "b AS (SELECT *, greatest(1, floor(CASE WHEN k > 50 THEN k / 10 ELSE k / 2 END)) AS bins FROM s)", select="SELECT contig, CAST(least(floor((cp - lo) / (hi - lo) * bins), bins - 1) AS BIGINT) AS bin, count(*) AS n FROM panel JOIN b USING (contig) GROUP BY 1, 2"))
def viz_histogram(spark, d):
    return cx.value_histogram(v.panel(spark, d), ["contig"], "cp")


@query("call_tsv_lines", v.sql(v.CALLS, select="SELECT concat(call_id, chr(9), chr, chr(9), start, chr(9), \"end\", chr(9), printf('%.4f', mu), chr(9), CASE WHEN p < 0.01 THEN '*' ELSE '-' END, chr(9), window_size) AS line FROM calls"))
def call_tsv_lines(spark, d):
    c = v.calls(spark, d)
    flag = F.when(F.col("p") < 0.01, "*").otherwise("-")
    return c.select(F.format_string("%d\t%s\t%d\t%d\t%.4f\t%s\t%d", "call_id", "chr", "start", "end", "mu", flag, "window_size").alias("line"))


@query("reported_calls")
def reported_calls(spark, d):
    p = v.panel(spark, d)
    s = sg.segments(p, ["contig", "sample"], n_scales=11, cutoff_scale=2, max_merge=0.2)
    return cx.reported_calls(s, v.windows(spark, d), ["contig", "sample"]).select("contig", "sample", "start", "call_end", "value", "n")


@query("sample_clusters")
def sample_clusters(spark, d):
    p = v.panel(spark, d)
    r = iv.runs(p.where("cp > 2.1"), ["contig", "sample"])
    s = r.select(F.col("contig").alias("chr"), "sample", (F.col("first") * v.WIDTH).alias("start"), (F.col("last") * v.WIDTH).alias("end"))
    return cx.sample_clusters(s, p, cutoff=0.95, max_frac_uniq=0.9)


@query("shared_chunks")
def shared_chunks(spark, d):
    p = v.panel(spark, d)
    r = iv.runs(p.where("cp > 2.0"), ["contig", "sample"])
    s = r.select(F.col("contig").alias("chr"), "sample", (F.col("first") * v.WIDTH).alias("start"), (F.col("last") * v.WIDTH).alias("end"))
    pairs = p.select("sample", F.floor(F.col("sample").cast("int") / 2).cast("int").alias("cluster")).distinct()
    return cx.shared_chunks(s, pairs)


