"""Queries on iterative models, and end-to-end chains; checked by tests on small fixtures rather than SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.operators import calls as cl
from windrow.operators import complex_loci as cx
from windrow.operators import genotype as gt
from windrow.operators import intervals as iv
from windrow.operators import mixture as mx
from windrow.operators import nullmodel as nm
from windrow.operators import segmentation as sg
from windrow.plans import sql as sq
from windrow.plans import views as v
from windrow.plans.queries_calls import _SWEEP, clustered
from windrow.plans.queries_genotype import cells, obs
from windrow.sources.scratch import written

QUERIES, SQL = {}, {}


def query(f, sql=None):
    QUERIES[f.__name__] = f
    if sql is not None:
        SQL[f.__name__] = sql
    return f


def checked(sql):
    return lambda f: query(f, sql)


@query
def contours(spark, d):
    return sg.contour_rows(v.track(spark, d), ["contig"])


@query
def heap_merge(spark, d):
    return sg.segments(v.track(spark, d), ["contig"], n_scales=8, cutoff_scale=0, max_merge=0.02)


@query
def segment_e2e(spark, d):
    """Segments of every sample's track, scored against the null and marked by false-discovery rate."""
    p = v.panel(spark, d)
    s = sg.segments(p, ["contig", "sample"], n_scales=21, cutoff_scale=3, max_merge=0.3)
    scored = nm.welch(sg.segment_stats(s, p, ["contig", "sample"]), nm.moments(p)).withColumn("p", nm.folded_p())
    return cl.bh_fdr(scored, 0.05, ["p", "contig", "sample", "w0"]).select("contig", "sample", "w0", "w1", "n", "mean", "p", "rank", "significant")


@checked(v.sql(v.CALLS, _SWEEP, sq.linkage("clustered", ["chr"]), select='SELECT chr, cluster_no, call_id, start, "end", sub FROM clustered JOIN linked USING (chr, cluster_no, start, "end")', recursive=True))
def linkage_clusters(spark, d):
    return mx.linkage_clusters(clustered(spark, d), ["chr"])


_REFINED = (v.CALLS.replace("calls AS", "every AS", 1), "calls AS (SELECT * FROM every WHERE (p / exp(mu * mu) < 0.05 OR abs(mu) > 0.5) AND window_size >= 2)", _SWEEP, sq.linkage("clustered", ["chr"]))
_RESOLVED = """
subs AS (SELECT chr, cluster_no, sub, median(start) AS s, median("end") AS e, count(*) AS n, sum(log10(p)) AS ll, list(indiv_ref) AS refs, sum(count(*)) OVER (PARTITION BY chr, cluster_no) AS members
         FROM clustered JOIN linked USING (chr, cluster_no, start, "end") GROUP BY 1, 2, 3)""".strip()


@checked(v.sql(*_REFINED, _RESOLVED, select='SELECT chr, cluster_no, min(s) AS start, max(e) AS "end", array_to_string(list_sort(list_distinct(flatten(list(refs)))), chr(44)) AS called_refs, round(sum(ll), 6) AS log_likelihood FROM subs WHERE members = 1 OR (round(ll, 9) < -3 AND n >= 2) GROUP BY 1, 2', recursive=True))
def refine_calls(spark, d):
    """Filter, cluster by overlap, split by linkage, keep likely sub-clusters, resolve."""
    counted = written(cl.counted(cl.filtered(v.calls(spark, d), 0.05, 2, 0.5), ["chr"]), "counted")  # read several times
    c = iv.overlap_clusters(counted, ["chr"], ["start", "end", "indiv_ref"])  # one order in both scans
    return cl.resolved(mx.linkage_clusters(c, ["chr"], carried=("indiv_ref", "n", "ll")), ["chr"]).withColumn("log_likelihood", F.round("log_likelihood", 6)).withColumn("called_refs", F.array_join("called_refs", ","))


@query
def gmm_genotype(spark, d):
    return mx.genotypes(obs(spark, d).select("locus", "sample", "mu"), ["locus"], merge=False)


@query
def gmm_merge(spark, d):
    return mx.genotypes(obs(spark, d).select("locus", "sample", "mu"), ["locus"])


@query
def genotype_e2e(spark, d):
    """Mixture labels of every region turned into copy numbers, with the quality filter's verdict."""
    o = mx.genotypes(obs(spark, d).select("locus", "sample", "mu"), ["locus"])
    s = gt.label_stats(o)
    cn = gt.labels_to_cn(s).select("locus", "label", "cn")
    q = gt.quality(s, o, max_mu=4.0, min_max_d=0.3, singleton_sigma=5.0, dup_sigma=3.0).select("locus", "fail")
    return o.join(cn, ["locus", "label"]).join(q, "locus").select("locus", "sample", "mu", "label", "cn", "post", "fail")


@query
def correlated_segments(spark, d):
    c = v.panel(spark, d).select(F.col("contig").alias("locus"), "sample", "w", "cp")
    b = c.groupBy("locus").agg(F.sequence(F.min("w"), F.max("w") + 1, F.lit(8).cast("long")).alias("at"))
    return mx.correlated_segments(c, b)


@query
def info_records(spark, d):
    """Quality statistics of every locus side by side."""
    c = cells(spark, d)
    # the fits feed nine branches; a row for each locus and sample
    o = mx.genotypes(obs(spark, d, c).select("locus", "sample", "mu"), ["locus"], high=12.0)
    o = v.kept(o)
    regions = v.regions(spark).select(F.col("region_id").alias("locus"), "contig", "start", "end")
    gc = c.groupBy("locus").agg(F.avg(F.pmod(F.col("w") * 37 + 11, F.lit(100)) / 100.0).alias("gc"))
    spans = c.groupBy("locus", "sample").agg(F.min("w").alias("w0"), (F.max("w") + 1).alias("w1")).join(regions.select("locus", "contig"), "locus")
    return gt.info(o, c, regions, gc, cx.singleton_z(v.panel(spark, d), spans))
