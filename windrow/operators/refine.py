"""The whole refinement of a sample's calls: clusters, sub-clusters, the check against the references, final calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.operators import calls as cl
from windrow.operators import genotype as gt
from windrow.operators import intervals as iv
from windrow.operators import mixture as mx
from windrow.sources.scratch import written

KEYS = ["indiv_test", "chr"]


def sub_clusters(calls: DataFrame, cut: float = 0.85, ll_cutoff: float = -3.0, min_calls: int = 3) -> DataFrame:
    """Sub-clusters of ``calls(indiv_test, indiv_ref, chr, start, end, p)`` by overlap and complete linkage that pass size and likelihood, with ``sub_id``."""
    c = iv.overlap_clusters(written(cl.counted(calls, KEYS), "counted"), KEYS, ["start", "end", "indiv_ref"])
    s = cl.passing_subs(mx.linkage_clusters(c, KEYS, cut, carried=("indiv_ref", "n", "ll")), KEYS, ll_cutoff, min_calls)
    return s.withColumn("sub_id", F.concat_ws(":", "indiv_test", "chr", F.col("cluster_no").cast("string"), F.col("sub").cast("string")))


def checked(subs: DataFrame, panel: DataFrame, accept: float = 1.0, min_delta: float = 0.0) -> DataFrame:
    """Those of ``subs`` whose sample differs from its references on ``panel(contig, sample, w, start, end, cp)``.

    Sub-clusters of one call go.  A mean difference above ``accept`` decides
    alone; one above ``min_delta`` needs a mixture over all samples at the
    sub-cluster's windows in which the sample is in a minority or there are more
    than two components.  Only these are fitted.
    """
    axis = panel.select("contig", "w", "start", "end").distinct().persist()
    at = subs.select(F.col("sub_id").alias("region_id"), F.col("chr").alias("contig"), F.col("s").cast("long").alias("start"), F.col("e").cast("long").alias("end"), F.col("indiv_test").alias("test"), "refs")
    delta = written(cl.deltas(at, panel, axis).join(subs.select(F.col("sub_id").alias("region_id"), F.col("n").alias("size")), "region_id"), "deltas")
    unsure = delta.where((F.col("size") > 1) & (F.col("delta") <= accept) & (F.col("delta") > min_delta)).select("region_id")
    near = at.join(unsure, "region_id")
    cells = iv.slice_join(iv.slices(near.select("region_id", "contig", "start", "end"), axis, "genotyper"), panel)
    fitted = mx.genotypes(cells.groupBy(F.col("region_id").alias("locus"), "sample").agg(F.avg("cp").alias("mu")), ["locus"])
    own = gt.variable(fitted).join(near.select(F.col("region_id").alias("locus"), F.col("test").alias("sample")), ["locus", "sample"]).select(F.col("locus").alias("region_id"), "variable")
    good = cl.reference_checked(delta.join(own, "region_id", "left").withColumn("variable", F.coalesce("variable", F.lit(False))), accept, min_delta)
    return subs.join(good.select(F.col("region_id").alias("sub_id")), "sub_id", "left_semi")


def refined(calls: DataFrame, panel: DataFrame | None = None, cut: float = 0.85, ll_cutoff: float = -3.0, min_calls: int = 3, accept: float = 1.0, min_delta: float = 0.0) -> DataFrame:
    """Final calls ``indiv_test, chr, cluster_no, start, end, called_refs, log_likelihood``.

    With a panel, sub-clusters have to pass :func:`checked`; those that
    remain and overlap by their median bounds become one call.  Without one,
    all sub-clusters of an overlap cluster do.
    """
    subs = sub_clusters(calls, cut, ll_cutoff, min_calls)
    if panel is None:
        return subs.groupBy(*KEYS, "cluster_no").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("called_refs"), F.sum("ll").alias("log_likelihood"))
    return cl.final_calls(checked(written(subs, "subs"), panel, accept, min_delta), KEYS)
