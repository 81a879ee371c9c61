"""Operators on call tables: filters, sharding, cluster statistics, resolution, significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.operators import intervals as iv
from windrow.operators.scan import ranked


def significant(p_cutoff: float, min_windows: int, min_mu: float = 0.5, adjusted: bool = True) -> Column:
    """Call filter: p over exp(mu^2) below the cut-off or |mu| large (plain p if not ``adjusted``), and enough windows."""
    if adjusted:
        good = (F.col("p") / F.exp(F.col("mu") * F.col("mu")) < p_cutoff) | (F.abs("mu") > min_mu)
    else:
        good = F.col("p") < p_cutoff
    return good & (F.col("window_size") >= min_windows)


def filtered(calls: DataFrame, p_cutoff: float = 0.005, min_windows: int = 2, min_mu: float = 0.5, adjusted: bool = True, max_size: int | None = None, chrom: str | None = None) -> DataFrame:
    """Calls of a contig and size that pass :func:`significant`."""
    out = calls
    if chrom is not None:
        out = out.where(F.col("chr") == chrom)
    if max_size is not None:
        out = out.where(F.col("end") - F.col("start") <= max_size)
    return out.where(significant(p_cutoff, min_windows, min_mu, adjusted))


def not_normal(calls: DataFrame, panel: DataFrame, min_length: int, low: float, high: float, width: int) -> DataFrame:
    """Drop calls that are long and whose median copy number over the panel is within (low, high)."""
    cells = panel.select(F.col("contig").alias("chr"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), "cp")
    med = iv.interval_join(calls, cells, ["chr"], width).groupBy("call_id").agg(F.median("cp").alias("_m"))
    normal = (F.col("end") - F.col("start") >= min_length) & (F.col("_m") > low) & (F.col("_m") < high)
    return calls.join(med, "call_id", "left").where(~F.coalesce(normal, F.lit(False))).drop("_m")


def shard(clustered: DataFrame, keys: list[str], subset: int, total: int) -> DataFrame:
    """Clusters whose 0-based number is ``subset`` modulo ``total``."""
    return clustered.where(F.pmod(F.col("cluster_no") - 1, F.lit(total)) == subset)


def cluster_stats(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """Size, extent, medians (linear and upper) and log-likelihood of clusters."""

    def upper(c):
        return F.element_at(F.sort_array(F.collect_list(c)), (F.floor(F.count("*") / 2) + 1).cast("int"))

    ll = F.sum(F.when(F.col("p") > 0, F.log10("p")).otherwise(F.lit(float("-inf"))))
    return clustered.groupBy(*keys, "cluster_no").agg(
        F.count("*").alias("n"), F.min("start").alias("min_start"), F.max("end").alias("max_end"),
        F.median("start").alias("med_start"), F.median("end").alias("med_end"),
        upper("start").alias("upper_start"), upper("end").alias("upper_end"), ll.alias("log_likelihood"),
    )


def best_breakpoints(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """Start and end of each cluster with the least summed log10 p; of equal sums the smaller coordinate."""
    out = None
    for side in ("start", "end"):
        score = clustered.groupBy(*keys, "cluster_no", side).agg(F.round(F.sum(F.log10("p")), 9).alias("_s"))
        best = score.groupBy(*keys, "cluster_no").agg(F.min(F.struct("_s", side)).alias("_b")).select(*keys, "cluster_no", F.col(f"_b.{side}").alias(f"best_{side}"))
        out = best if out is None else out.join(best, [*keys, "cluster_no"])
    return out


def merged_breakpoints(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls with equal breakpoints as one: product of p, set of references."""
    return calls.groupBy(*keys, "start", "end").agg(F.sum(F.log10("p")).alias("log10_p"), F.count("*").alias("n"), F.array_sort(F.collect_set("indiv_ref")).alias("refs"))


def merged_starts(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls with equal starts as one, at their median end."""
    return calls.groupBy(*keys, "start").agg(F.median("end").alias("end"), F.sum(F.log10("p")).alias("log10_p"), F.count("*").alias("n"))


def counted(calls: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, start, end, indiv_ref`` of calls with the number ``n`` of those that are equal in them, and the sum ``ll`` of their log10 p.

    Equal intervals overlap, so they are in one cluster.  One without a length
    does not overlap itself and stays a row for each call; calls without a
    key, a start or an end are left out.
    """
    apart = F.when(F.col("end") <= F.col("start"), F.monotonically_increasing_id()).alias("_apart")
    c = calls.dropna(subset=[*keys, "start", "end"]).select(*keys, "start", "end", "indiv_ref", apart, F.log10("p").alias("_l"))
    return c.groupBy(*keys, "start", "end", "indiv_ref", "_apart").agg(F.count("*").alias("n"), F.sum("_l").alias("ll")).drop("_apart")


def passing_subs(clustered: DataFrame, keys: list[str], ll_cutoff: float = -3.0, min_calls: int = 2) -> DataFrame:
    """Sub-clusters ``keys, cluster_no, sub, s, e, n, ll, refs`` that pass size and likelihood, at their median bounds; a cluster's only member passes without a test.

    Takes calls, or rows of :func:`counted` for several calls each.
    """
    if "n" not in clustered.columns:
        clustered = clustered.withColumn("n", F.lit(1).cast("long")).withColumn("ll", F.log10("p"))
    w = Window.partitionBy(*keys, "cluster_no")
    sub = clustered.groupBy(*keys, "cluster_no", "sub").agg(
        F.percentile("start", 0.5, F.col("n")).alias("s"), F.percentile("end", 0.5, F.col("n")).alias("e"), F.sum("n").alias("n"), F.sum("ll").alias("ll"), F.collect_set("indiv_ref").alias("refs")
    )
    sub = sub.withColumn("_members", F.sum("n").over(w))
    # sums that differ by their order alone are one
    return sub.where((F.col("_members") == 1) | ((F.round("ll", 9) < ll_cutoff) & (F.col("n") >= min_calls))).drop("_members")


def resolved(clustered: DataFrame, keys: list[str], ll_cutoff: float = -3.0, min_calls: int = 2) -> DataFrame:
    """Sub-clusters (equal breakpoints) of each cluster that pass size and likelihood, and the final call over them.

    The final call runs from the least median start to the largest median
    end of the sub-clusters that remain, with the union of their references.
    """
    return passing_subs(clustered, keys, ll_cutoff, min_calls).groupBy(*keys, "cluster_no").agg(
        F.min("s").alias("start"), F.max("e").alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("called_refs"), F.sum("ll").alias("log_likelihood")
    )


def deltas(calls: DataFrame, panel: DataFrame, axis: DataFrame, test: str | None = None) -> DataFrame:
    """``region_id, delta, n_refs``: mean over a call's references of |mean difference to the test sample| over its windows.

    ``calls(region_id, contig, start, end, refs)`` of one ``test`` sample, or
    with a column ``test`` of many; windows run from ss(starts, start) to
    ss(ends, end), the latter excluded.
    """
    r = iv.asof_index(calls, axis, "start", "start", "w0")
    r = iv.asof_index(r, axis, "end", "end", "w1").where("w1 > w0")
    r = r if test is None else r.withColumn("test", F.lit(test))
    cells = r.withColumn("w", F.explode(F.sequence("w0", F.col("w1") - 1))).withColumn("ref", F.explode("refs"))
    mine = panel.select("contig", "w", F.col("sample").alias("test"), F.col("cp").alias("t"))
    mine = mine if test is None else mine.where(F.col("test") == test)
    other = panel.select("contig", "w", F.col("sample").alias("ref"), F.col("cp").alias("r"))
    both = cells.select("region_id", "contig", "w", "test", "ref").join(mine, ["contig", "w", "test"]).join(other, ["contig", "w", "ref"])
    per = both.groupBy("region_id", "ref").agg(F.avg(F.col("t") - F.col("r")).alias("d"))
    return per.groupBy("region_id").agg(F.avg(F.abs("d")).alias("delta"), F.count("*").alias("n_refs"))


def bh_fdr(calls: DataFrame, fdr: float, order: list[str], strict: bool = True) -> DataFrame:
    """Benjamini-Hochberg step-up: adds the 0-based ``rank`` by ``order`` (p first, distinct rows) and ``significant``.

    Without ``strict`` the first call is significant even if none passes.
    """
    total = calls.count()
    r = ranked(calls, order, total, "rank")
    passed = r.where(F.col("p") < F.lit(fdr) * (F.col("rank") + 1) / F.lit(max(1, total))).agg(F.max("rank").alias("_k"))
    last = F.col("_k") if strict else F.coalesce("_k", F.lit(0))
    return r.join(F.broadcast(passed), F.lit(True)).withColumn("significant", F.coalesce(F.col("rank") <= last, F.lit(False))).drop("_k")  # one row


def reference_checked(calls: DataFrame, accept: float = 1.0, min_delta: float = 0.0) -> DataFrame:
    """Calls that differ from their references: rows (size, delta, variable) of more than one member whose delta exceeds ``accept``, or ``min_delta`` where the sample varies by its mixture label."""
    far = (F.col("delta") > accept) | ((F.col("delta") > min_delta) & F.col("variable"))
    return calls.where((F.col("size") > 1) & far)


def final_calls(sub: DataFrame, keys: list[str]) -> DataFrame:
    """One call for each component of sub-calls ``(sub_id, s, e, refs, ll)`` that overlap strictly by their median bounds: keys, start, end, called_refs, log_likelihood."""
    named = sub.select(*keys, F.col("sub_id"), F.col("s").alias("start"), F.col("e").alias("end"), "refs", "ll")
    c = iv.overlap_clusters(named, keys, ["start", "end", "sub_id"])
    refs = F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs"))))
    return c.groupBy(*keys, "cluster_no").agg(F.min("start").alias("start"), F.max("end").alias("end"), refs.alias("called_refs"), F.sum("ll").alias("log_likelihood"))


def in_window_range(calls: DataFrame, first: int, last: int) -> DataFrame:
    """Calls strictly inside a range of window ordinals."""
    return calls.where((F.col("w0") > first) & (F.col("w1") < last))
