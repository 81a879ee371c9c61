"""Queries on further statistics, slices, filters and merges, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.operators import calls as cl
from windrow.operators import chain
from windrow.operators import complex_loci as cx
from windrow.operators import genotype as gt
from windrow.operators import intervals as iv
from windrow.operators import mixture as mx
from windrow.operators import nullmodel as nm
from windrow.operators import segmentation as sg
from windrow.operators import tracks as tr
from windrow.plans import sql as sq
from windrow.plans import views as v
from windrow.plans.queries_calls import _FINAL, _SUB, _SWEEP, BIN, PAD, clustered
from windrow.plans.queries_genotype import _OBS, obs, stats
from windrow.plans.queries_more import window_pairs
from windrow.plans.queries_tracks import _BASE, _SS, r6

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


_PLAIN = """
nul AS (SELECT count(*) AS nn, avg(cp) AS nm, var_pop(cp) AS nv FROM panel),
seg AS (SELECT contig, sample, w // 10 AS seg, count(*) AS n, avg(cp) AS mean, var_pop(cp) AS var FROM panel GROUP BY 1, 2, 3),
e AS (SELECT *, var / (n - 1) AS a, nv / (nn - 1) AS b FROM seg, nul WHERE n > 1),
pt AS (SELECT contig, sample, seg, (mean - nm) / sqrt(a + b) AS t, pow(a + b, 2) / (a * a / (n - 1) + b * b / (nn - 1)) AS df FROM e)""".strip()


@query("welch_p", v.sql(v.PANEL, _PLAIN, select=f"SELECT contig, sample, seg, round(t, 6) AS t, round(2 * {sq.t_tail()}, 6) AS p FROM pt"))
def welch_p(spark, d):
    p = v.panel(spark, d)
    seg = p.groupBy("contig", "sample", F.floor(F.col("w") / 10).alias("seg")).agg(F.count("*").alias("n"), F.avg("cp").alias("mean"), F.var_pop("cp").alias("var"))
    return nm.plain_welch_p(seg.where("n > 1"), nm.moments(p)).select("contig", "sample", "seg", r6(F.col("t"), "t"), r6(F.col("p"), "p"))


_LL = (
    v.TRACK, "v0 AS (SELECT contig, w, cp - 1.9 AS x FROM track)", sq.histogram("u", "v0"), f"dn AS (SELECT contig, w, x, {sq.density('u', 'x')} AS c, (SELECT any_value(total) FROM uh) AS total FROM v0)",
    f"lg AS (SELECT contig, w, ln(greatest({sq.folded('c')}, 0.5 / total)) AS l, ln(greatest(c, 0.5 / total)) AS own FROM dn)",
    "sm AS (SELECT x FROM (SELECT row_number() OVER (PARTITION BY contig ORDER BY w) AS rn, sum(l) OVER (PARTITION BY contig ORDER BY w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x FROM lg) WHERE rn > 4)", sq.histogram("s", "sm"),
    "ow AS (SELECT contig, w // 4 AS seg, sum(own) AS ll FROM lg GROUP BY 1, 2)", f"lp AS (SELECT contig, seg, ll, {sq.density('s', 'll')} AS c FROM ow)",
)


@query("likelihood_p", v.sql(*_LL, select=f"SELECT contig, seg, round(ll, 6) AS ll, round(greatest({sq.folded('c')}, 0), 6) AS p FROM lp"))
def likelihood_p(spark, d):
    t = v.track(spark, d).withColumn("cp", F.col("cp") - 1.9)
    cells = t.withColumn("call_id", F.struct("contig", F.floor(F.col("w") / 4).alias("seg")))
    p = nm.likelihood_p(cells.select("call_id").distinct(), cells.select("call_id", "cp"), t, ["contig"], 4)
    return p.select("call_id.contig", "call_id.seg", r6(F.col("ll"), "ll"), r6(F.col("p"), "p"))


_MATRIX = "p.w >= a AND p.w < least(b + 1, n)"


@query("region_matrix_mean", v.sql(*_BASE, select=f"SELECT region_id, sample, round(avg(cp), 6) AS mean_cp, count(*) AS k FROM ss JOIN panel p ON p.contig = ss.contig AND {_MATRIX} GROUP BY 1, 2"))
def region_matrix_mean(spark, d):
    cells = iv.slice_join(iv.slices(v.regions(spark), v.windows(spark, d), "matrix"), v.panel(spark, d))
    return cells.groupBy("region_id", "sample").agg(r6(F.avg("cp"), "mean_cp"), F.count("*").alias("k"))


@query("window_range", v.sql(*_BASE, select="SELECT region_id, CAST(a AS BIGINT) AS w0, CAST(least(b + 1, n) AS BIGINT) AS w1 FROM ss WHERE a > 3 AND least(b + 1, n) < 60"))
def window_range(spark, d):
    return cl.in_window_range(iv.slices(v.regions(spark), v.windows(spark, d), "matrix"), 3, 60).select("region_id", "w0", "w1")


_LONG = 2_000_000_000
_EX_LONG = f"""
es AS (SELECT *, max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM (SELECT DISTINCT chr, start - {PAD} AS s, "end" + {PAD} AS e FROM excludes WHERE "end" - start > {_LONG})),
ei AS (SELECT chr, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN pm IS NULL OR s >= pm THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY s, e) AS g FROM es) GROUP BY chr, g)""".strip()


@query("exclusion_min_length", v.sql(v.CALLS, v.EXCLUDES, _EX_LONG, _SUB, select='SELECT call_id, chr, s AS start, e AS "end" FROM pieces WHERE s < e'))
def exclusion_min_length(spark, d):
    return iv.subtracted(v.calls(spark, d).select("call_id", "chr", "start", "end"), v.excludes(spark, d), PAD, BIN, _LONG)


_DELTA = """
dl AS (SELECT region_id, round(avg(abs(d)), 9) AS delta FROM (SELECT region_id, r.sample, avg(t.cp - r.cp) AS d FROM ss JOIN panel t ON t.contig = ss.contig AND t.sample = '1' AND t.w >= a AND t.w < b JOIN panel r ON r.contig = t.contig AND r.w = t.w AND r.sample IN ('2', '3', '4') GROUP BY 1, 2) GROUP BY 1),
vr AS (SELECT o.locus, k > 2 OR o.label <> mode AS variable FROM obs o JOIN (SELECT locus, first(label ORDER BY n DESC, label) AS mode, count(*) AS k FROM stats GROUP BY 1) USING (locus) WHERE o.sample = '1')""".strip()


@query("reference_checked", v.sql(*_OBS, _DELTA, select="SELECT region_id, 1 + region_id % 3 AS size, round(delta, 6) AS delta, variable FROM dl JOIN vr ON locus = region_id WHERE 1 + region_id % 3 > 1 AND (delta > 0.3 OR (delta > 0.1 AND variable))"))
def reference_checked(spark, d):
    regions = v.regions(spark).withColumn("refs", F.array(*map(F.lit, "234")))
    delta = cl.deltas(regions, v.panel(spark, d), v.windows(spark, d), "1").select("region_id", F.round("delta", 9).alias("delta"), (1 + F.col("region_id") % 3).alias("size"))
    own = gt.variable(obs(spark, d)).where("sample = '1'").select(F.col("locus").alias("region_id"), "variable")
    return cl.reference_checked(delta.join(own, "region_id"), 0.3, 0.1).select("region_id", "size", r6(F.col("delta"), "delta"), "variable")


_COMPONENTS = """
ok AS (SELECT *, max(e) OVER (PARTITION BY chr ORDER BY s, e, cluster_no, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM sub WHERE members = 1 OR (round(ll, 9) < -3 AND n >= 2)),
cm AS (SELECT *, sum(CASE WHEN pm IS NULL OR s >= pm THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY s, e, cluster_no, sub) AS c FROM ok)""".strip()


@query("median_components", v.sql(v.CALLS, _SWEEP, _FINAL, _COMPONENTS, select="SELECT chr, CAST(c AS BIGINT) AS cluster_no, min(s) AS start, max(e) AS \"end\", array_to_string(list_sort(list_distinct(flatten(list(refs)))), ',') AS called_refs, round(sum(ll), 6) AS log_likelihood FROM cm GROUP BY 1, 2"))
def median_components(spark, d):
    c = clustered(spark, d).withColumn("sub", F.floor(F.col("start") / 1_000_000_000))
    ll = F.sum(F.log10("p"))
    s = c.groupBy("chr", "cluster_no", "sub").agg(F.median("start").alias("s"), F.median("end").alias("e"), F.count("*").alias("n"), ll.alias("ll"), F.collect_set("indiv_ref").alias("refs"))
    members = c.groupBy("chr", "cluster_no").agg(F.count("*").alias("members"))
    s = s.join(members, ["chr", "cluster_no"]).where("members = 1 OR (round(ll, 9) < -3 AND n >= 2)").withColumn("sub_id", F.struct("cluster_no", "sub"))
    f = cl.final_calls(s, ["chr"])
    return f.select("chr", "cluster_no", "start", "end", F.array_join("called_refs", ",").alias("called_refs"), r6(F.col("log_likelihood"), "log_likelihood"))


_SEGMENTS = """
pos AS (SELECT contig, sample, w, w - row_number() OVER (PARTITION BY contig, sample ORDER BY w) AS g FROM panel WHERE cp > 2.1),
sgs AS (SELECT contig, sample, min(w) AS start, max(w) + 1 AS "end" FROM pos GROUP BY contig, sample, g),
sw2 AS (SELECT *, max("end") OVER (PARTITION BY contig ORDER BY start, "end", sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM sgs),
cs2 AS (SELECT *, CAST(sum(CASE WHEN pm IS NULL OR start >= pm THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, "end", sample) AS BIGINT) AS cluster_no FROM sw2)""".strip()


def _segments(spark, d):
    r = iv.runs(v.panel(spark, d).where("cp > 2.1"), ["contig", "sample"])
    return r.select("contig", "sample", F.col("first").alias("start"), F.col("last").alias("end"))


@query("segment_sub_clusters", v.sql(v.PANEL, _SEGMENTS, sq.linkage("cs2", ["contig"], max_frac_uniq=0.6), select='SELECT contig, sample, cluster_no, start, "end", sub FROM cs2 JOIN linked USING (contig, cluster_no, start, "end")', recursive=True))
def segment_sub_clusters(spark, d):
    s = iv.overlap_clusters(_segments(spark, d), ["contig"], ["start", "end", "sample"]).withColumn("call_id", F.concat_ws(":", "sample", F.col("start").cast("string")))
    linked = mx.linkage_clusters(s, ["contig"], max_frac_uniq=0.6)
    return linked.select("contig", F.split("call_id", ":")[0].alias("sample"), "cluster_no", "start", "end", "sub")


_CN = 'CAST(least(round(cp), 4) AS INT)'


@query("varying_segments", v.sql(v.PANEL, f"vec AS (SELECT contig, start, \"end\", list({_CN} ORDER BY sample) AS labels FROM panel GROUP BY 1, 2, 3)", 'rn AS (SELECT *, sum(nw) OVER (PARTITION BY contig ORDER BY start, "end") AS g FROM (SELECT *, CASE WHEN lag(labels) OVER (PARTITION BY contig ORDER BY start, "end") = labels THEN 0 ELSE 1 END AS nw FROM vec))', select="SELECT contig, min(start) AS start, max(\"end\") AS \"end\", array_to_string(first(labels ORDER BY start), ',') AS labels FROM rn WHERE len(list_distinct(labels)) > 1 GROUP BY contig, g"))
def varying_segments(spark, d):
    p = v.panel(spark, d).withColumn("cn", F.least(F.round("cp"), F.lit(4.0)).cast("int"))
    s = p.groupBy("contig", "start", "end").agg(F.array_sort(F.collect_list(F.struct("sample", "cn"))).alias("l")).withColumn("labels", F.transform("l", lambda x: x["cn"]))
    return cx.varying(s, ["contig"]).select("contig", "start", "end", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query("second_panel", v.sql(*_OBS, select="SELECT locus, NOT (avg(mu) >= 2.0 OR max(mu) > 2.4 OR locus % 5 = 0) OR count(DISTINCT floor(mu * 2)) > 1 AS passes FROM obs GROUP BY 1"))
def second_panel(spark, d):
    o = obs(spark, d)
    other = o.withColumn("label", F.floor(F.col("mu") * 2))
    return gt.second_panel_passes(stats(o), o, other, o.where("locus % 5 = 0").select("locus"), 2.0, 2.4)


_GC = "((w * 37 + 11) % 100) / 100.0::DOUBLE + 0.005"


def _gc():
    return F.pmod(F.col("w") * 37 + 11, F.lit(100)) / 100.0 + 0.005


@query("region_gc", v.sql(v.PANEL, v.WINDOWS, v.REGION_VALUES, select=f'SELECT region_id, round(median({_GC}), 6) AS gc FROM regions r JOIN windows x ON x.contig = r.contig AND r.start < x."end" AND x.start < r."end" WHERE r.start < r."end" GROUP BY 1'))
def region_gc(spark, d):
    gc = v.windows(spark, d).withColumn("gc", _gc())
    return gt.region_gc(v.regions(spark).where("start < end"), gc, 10 * v.WIDTH).select("region_id", r6(F.col("gc"), "gc"))


@query("locus_gc_bins", v.sql(*_BASE, f"c AS (SELECT cp, {_GC.replace('w *', 'p.w *')} AS gc FROM ss JOIN panel p ON p.contig = ss.contig AND {_MATRIX})", "k AS (SELECT CAST(floor(gc * 100) AS BIGINT) AS bin, count(*) FILTER (round_even(cp, 0) = 2) AS n2, count(*) AS n FROM c GROUP BY 1)", select="SELECT b.bin, coalesce(n2, 0) AS n_two, greatest(coalesce(n, 0), 1) AS n FROM range(0, 99) b(bin) LEFT JOIN k ON k.bin = b.bin"))
def locus_gc_bins(spark, d):
    cells = iv.slice_join(iv.slices(v.regions(spark), v.windows(spark, d), "matrix"), v.panel(spark, d)).withColumn("gc", _gc())
    return gt.gc_bins(cells.select("cp", "gc")).select("bin", "n_two", F.col("n").cast("long").alias("n"))


_LOGZ = """
lo AS (SELECT DISTINCT contig || ':' || w // 2 AS locus, contig, w // 2 * 2 AS w0, w // 2 * 2 + 2 AS w1 FROM panel),
rt AS (SELECT locus, a.sample, o.sample AS other, a.w, w0, w1, log2(a.cp / o.cp) AS r FROM lo JOIN panel a USING (contig) JOIN panel o ON o.contig = a.contig AND o.w = a.w WHERE a.sample <> o.sample AND a.cp > 0 AND o.cp > 0),
fl AS (SELECT *, lag(r) OVER (PARTITION BY locus, sample, other ORDER BY w) AS p FROM rt WHERE (w >= greatest(0, w0 - 23) AND w < w0 - 3) OR (w >= w1 + 3 AND w < w1 + 23)),
nl AS (SELECT locus, sample, avg((r + p) / 2) AS mu, stddev_pop((r + p) / 2) AS sd FROM fl WHERE p IS NOT NULL GROUP BY 1, 2),
own AS (SELECT locus, sample, avg(r) AS own FROM rt WHERE w >= w0 AND w < w1 GROUP BY 1, 2)""".strip()


@query("singleton_log_z", v.sql(v.PANEL, _LOGZ, select="SELECT locus, sample, CASE WHEN sd > 0 THEN round(abs((own - mu) / sd), 6) END AS log_z FROM own JOIN nl USING (locus, sample)"))
def singleton_log_z(spark, d):
    p = v.panel(spark, d)
    return cx.singleton_log_z(p, window_pairs(p)).select("locus", "sample", r6(F.col("log_z"), "log_z"))


@query("smoothed_track", v.sql(v.TRACK, "a AS (SELECT contig, w, (coalesce(lag(cp) OVER o, cp) + 2 * cp + coalesce(lead(cp) OVER o, cp)) / 4 AS cp FROM track WINDOW o AS (PARTITION BY contig ORDER BY w))", select="SELECT contig, w, round((coalesce(lag(cp) OVER o, cp) + 2 * cp + coalesce(lead(cp) OVER o, cp)) / 4, 6) AS cp FROM a WINDOW o AS (PARTITION BY contig ORDER BY w)"))
def smoothed_track(spark, d):
    return tr.smoothed(v.track(spark, d), ["contig"], 2).select("contig", "w", r6(F.col("cp"), "cp"))


@query("moving_mean_first", v.sql(v.PANEL, select="SELECT contig, sample, w, round(m, 6) AS moving FROM (SELECT *, avg(cp) OVER o AS m, w AS rn FROM panel WINDOW o AS (PARTITION BY contig, sample ORDER BY w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE rn >= 4"))
def moving_mean_first(spark, d):
    return tr.moving(v.panel(spark, d), ["contig", "sample"], 5, first=True).select("contig", "sample", "w", r6(F.col("moving"), "moving"))


def _breaks(spark, d):
    t = v.track(spark, d)
    return t, t.groupBy("contig").agg(F.sequence(F.min("w"), F.max("w"), F.lit(3).cast("long")).alias("at"))


@query("iterative_merge")
def iterative_merge(spark, d):
    return sg.merged_tracks(*_breaks(spark, d), ["contig"], 0.08, "iterative")


@query("greedy_merge")
def greedy_merge(spark, d):
    return sg.merged_tracks(*_breaks(spark, d), ["contig"], 0.08, "greedy")


@query("heap_merge_breaks")
def heap_merge_breaks(spark, d):
    return sg.merged_tracks(*_breaks(spark, d), ["contig"], 0.08)


@query("complex_loci")
def complex_loci(spark, d):
    """Segments of every region's locus and the samples to genotype there."""
    p = v.panel(spark, d).select(F.col("contig").alias("locus"), "sample", "w", "cp")
    b = p.groupBy("locus").agg(F.sequence(F.min("w"), F.max("w") + 1, F.lit(8).cast("long")).alias("at"))
    a = chain.assessed_loci(p, b, chain.Limits(min_max_d=0.2, singleton_sigma=1.0, dup_sigma=1.0))
    return a.select("locus", "w0", "w1", F.array_join("samples", ",").alias("samples"), "simple")
