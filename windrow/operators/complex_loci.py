"""Operators on loci with several overlapping segments, and alternatives to mixture genotyping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.operators import intervals as iv
from windrow.operators.genotype import set_similarity
from windrow.operators.mixture import complete_linkage
from windrow.operators.scan import ranked
from windrow.sources.scratch import written


def merged_abutting(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of segments that abut (each start is the end before): keys, start, end, n."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    s = segments.withColumn("_new", F.coalesce((F.lag("end").over(w) != F.col("start")), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return s.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_run")


def merged_equal(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of consecutive segments with equal ``labels`` arrays; the first of a run keeps its fit: keys, start, end, labels."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    s = segments.withColumn("_new", F.coalesce((F.lag("labels").over(w) != F.col("labels")), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return s.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("labels", "start").alias("labels")).drop("_run")


def has_adjacent(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Whether any segment's end is the next one's start: keys, adjacent."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    return segments.withColumn("_a", F.lead("start").over(w) == F.col("end")).groupBy(*keys).agg(F.coalesce(F.bool_or("_a"), F.lit(False)).alias("adjacent"))


def added(segments: DataFrame, more: DataFrame, width: int) -> DataFrame:
    """``segments`` and those of ``more`` that overlap none of them; both (seg_id, chr, start, end)."""
    b = segments.select("chr", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    hit = iv.interval_join(more, b, ["chr"], width).select("seg_id").distinct()
    return segments.unionByName(more.join(hit, "seg_id", "left_anti"))


def sample_clusters(segments: DataFrame, samples: DataFrame, cutoff: float = 0.85, max_frac_uniq: float = 0.1) -> DataFrame:
    """Complete-linkage clusters of a cohort's samples by the similarity of their segment sets: ``sample, cluster``.

    Similarities too far from 1 count as 0; samples without segments stay alone.
    """
    # stored: the plans of similarities and of each round hold tables, not all that came before
    s = set_similarity(written(segments.select("chr", "sample", "start", "end"), "segments")).where(1 - F.col("similarity") < max_frac_uniq)
    s = written(s.where(1 - F.col("similarity") <= cutoff), "similar")  # farther pairs are never in one cluster
    # least reachable sample of each: a component of the similarity graph is a task, and no matrix of the cohort is made
    both = s.select("a", "b").unionByName(s.select(F.col("b").alias("a"), F.col("a").alias("b")))
    part = written(samples.select("sample").distinct().select("sample", F.col("sample").alias("least")), "least")
    while True:
        near = both.join(part.select(F.col("sample").alias("b"), F.col("least").alias("l")), "b").groupBy(F.col("a").alias("sample")).agg(F.min("l").alias("l"))
        moved = written(part.join(near, "sample", "left").select("sample", F.least("least", F.coalesce("l", "least")).alias("new"), "least"), "least")
        part = moved.select("sample", F.col("new").alias("least"))
        if moved.where("new < least").isEmpty():
            break

    def of(key, p: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        names = sorted(n["sample"])
        at = {x: i for i, x in enumerate(names)}
        d = np.ones((len(names),) * 2)
        np.fill_diagonal(d, 0)
        for a, b, q in zip(p.a, p.b, p.similarity, strict=True):
            d[at[a], at[b]] = d[at[b], at[a]] = 1 - q
        group = complete_linkage(d, cutoff)
        first = {g: names[int(np.flatnonzero(group == g)[0])] for g in np.unique(group)}
        return pd.DataFrame({"sample": names, "first": [first[g] for g in group]})

    pairs = s.join(part.select(F.col("sample").alias("a"), "least"), "a").select("least", "a", "b", "similarity")
    found = pairs.groupBy("least").cogroup(part.withColumnRenamed("least", "of_least").groupBy("of_least")).applyInPandas(of, "sample string, first string")
    found = written(found, "found")
    # clusters are numbered by their first members' order
    kinds = found.select("first").distinct()
    numbered = ranked(kinds, ["first"], kinds.count(), "cluster")
    return found.join(numbered, "first").select("sample", F.col("cluster").cast("int").alias("cluster"))


def shared_chunks(segments: DataFrame, clusters: DataFrame) -> DataFrame:
    """Closed-overlap chunks of each cluster's segments that all its members share, at their median bounds: cluster, chr, start, end, members."""
    s = segments.join(clusters, "sample").withColumn("call_id", F.xxhash64("sample", "start", "end"))
    c = iv.overlap_clusters(s, ["cluster", "chr"], ["start", "end", "call_id"], closed=True)
    size = clusters.groupBy("cluster").agg(F.count_distinct("sample").alias("_all"))
    g = c.groupBy("cluster", "chr", "cluster_no").agg(F.median("start").alias("start"), F.median("end").alias("end"), F.count_distinct("sample").alias("members"))
    return g.join(size, "cluster").where("members = _all").drop("_all", "cluster_no")


def singleton_z(panel: DataFrame, singles: DataFrame, reach: int = 10, pad: int = 3) -> DataFrame:
    """|z| of a sample's mean over windows [w0, w1) against moving means of the flanks: ``locus, sample, cp_z``.

    Flanks are ``reach`` times the width on either side, ``pad`` windows off;
    both flanks form one sequence for the moving mean of the locus' width.
    """
    width = F.col("w1") - F.col("w0")
    s = singles.withColumn("_d", width)
    left = F.sequence(F.greatest(F.lit(0), F.col("w0") - reach * F.col("_d") - pad), F.col("w0") - pad - 1)
    right = F.sequence(F.col("w1") + pad, F.col("w1") + reach * F.col("_d") + pad - 1)
    flank = F.concat(F.when(F.col("w0") - pad > F.greatest(F.lit(0), F.col("w0") - reach * F.col("_d") - pad), left).otherwise(F.array().cast("array<bigint>")), right)
    cells = s.withColumn("w", F.explode(flank)).join(panel.select("contig", "sample", "w", "cp"), ["contig", "sample", "w"])
    seq = cells.groupBy("locus", "sample", "_d").agg(F.array_sort(F.collect_list(F.struct("w", "cp"))).alias("c"))
    means = seq.withColumn("m", F.expr("transform(sequence(1, greatest(size(c) - _d + 1, 1)), i -> aggregate(slice(c, CAST(i AS INT), CAST(_d AS INT)), 0D, (a, x) -> a + x.cp) / _d)"))
    flat = means.select("locus", "sample", F.explode("m").alias("m")).groupBy("locus", "sample").agg(F.avg("m").alias("mu"), F.stddev_pop("m").alias("sd"))
    own = s.withColumn("w", F.explode(F.sequence("w0", F.col("w1") - 1))).join(panel.select("contig", "sample", "w", "cp"), ["contig", "sample", "w"]).groupBy("locus", "sample").agg(F.avg("cp").alias("own"))
    return own.join(flat, ["locus", "sample"]).select("locus", "sample", F.abs((F.col("own") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd"))).alias("cp_z"))


def singleton_log_z(panel: DataFrame, singles: DataFrame, reach: int = 10, pad: int = 3) -> DataFrame:
    """The same for log2 ratios of a sample to every other one: ``locus, sample, log_z``.

    Each other sample's ratios over both flanks give moving means of the
    locus' width; their common mean and deviation hold the mean ratio of the
    locus' own windows.  Ratios of non-positive values count for nothing.
    """
    s = singles.select("locus", "contig", "sample", "w0", "w1", (F.col("w1") - F.col("w0")).alias("_d"))
    lo = F.greatest(F.lit(0), F.col("w0") - reach * F.col("_d") - pad)
    left = F.when(F.col("w0") - pad > lo, F.sequence(lo, F.col("w0") - pad - 1)).otherwise(F.array().cast("array<bigint>"))
    right = F.sequence(F.col("w1") + pad, F.col("w1") + reach * F.col("_d") + pad - 1)
    cp = panel.where("cp > 0").select("contig", "w", "sample", "cp")

    def ratios(windows: DataFrame) -> DataFrame:
        mine = windows.join(cp, ["contig", "w", "sample"]).withColumnRenamed("cp", "own")
        other = cp.select("contig", "w", F.col("sample").alias("other"), F.col("cp").alias("ref"))
        return mine.join(other, ["contig", "w"]).where("sample <> other").withColumn("r", F.log2(F.col("own") / F.col("ref")))

    flank = ratios(s.withColumn("w", F.explode(F.concat(left, right))))
    seq = flank.groupBy("locus", "sample", "other", "_d").agg(F.array_sort(F.collect_list(F.struct("w", "r"))).alias("c"))
    means = seq.select("locus", "sample", F.explode(F.expr("transform(sequence(1, greatest(size(c) - _d + 1, 1)), i -> aggregate(slice(c, CAST(i AS INT), CAST(_d AS INT)), 0D, (a, x) -> a + x.r) / _d)")).alias("m"))
    null = means.groupBy("locus", "sample").agg(F.avg("m").alias("mu"), F.stddev_pop("m").alias("sd"))
    own = ratios(s.withColumn("w", F.explode(F.sequence("w0", F.col("w1") - 1)))).groupBy("locus", "sample").agg(F.avg("r").alias("own"))
    return own.join(null, ["locus", "sample"]).select("locus", "sample", F.abs((F.col("own") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd"))).alias("log_z"))


def varying(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments(keys, start, end, labels) without those of one label for all; of consecutive ones with equal labels one remains, from the first's start to the last's end."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    s = segments.withColumn("_was", F.lag("labels").over(w)).withColumn("_new", F.coalesce(F.col("_was") != F.col("labels"), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    s = s.where(F.size(F.array_distinct("labels")) > 1)
    return s.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("labels", "start").alias("labels")).drop("_run")


def dbscan(obs: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """One-dimensional DBSCAN of obs(locus, sample, mu): adds ``label`` (from 0), -1 for noise.

    Cores have ``min_samples`` points within ``eps``, themselves included;
    cores at most ``eps`` apart in order are one cluster; other points join
    the nearest core within ``eps``.
    """
    near = f"count(*) OVER (PARTITION BY locus ORDER BY mu RANGE BETWEEN CAST({eps!r} AS DOUBLE) PRECEDING AND CAST({eps!r} AS DOUBLE) FOLLOWING)"
    n = obs.select("locus", "sample", "mu").withColumn("_n", F.expr(near)).withColumn("_core", F.col("_n") >= min_samples)
    cores = n.where("_core")
    o = Window.partitionBy("locus").orderBy("mu", "sample")
    cores = cores.withColumn("_new", F.coalesce((F.col("mu") - F.lag("mu").over(o) > eps), F.lit(True)).cast("int"))
    cores = cores.withColumn("label", (F.sum("_new").over(o) - 1).cast("int")).select("locus", "sample", "label")
    j = n.join(cores, ["locus", "sample"], "left")
    up = o.rowsBetween(Window.unboundedPreceding, 0)
    down = o.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("label").isNotNull(), F.struct("mu", "label"))
    j = j.withColumn("_l", F.last(at, ignorenulls=True).over(up)).withColumn("_r", F.first(at, ignorenulls=True).over(down))
    dl, dr = F.col("mu") - F.col("_l.mu"), F.col("_r.mu") - F.col("mu")
    near = F.when((dl <= eps) & (dr.isNull() | (dl <= dr)), F.col("_l.label")).when(dr <= eps, F.col("_r.label"))
    return j.select("locus", "sample", "mu", F.coalesce("label", near, F.lit(-1)).alias("label"))


def mean_shift(x: np.ndarray, bandwidth: float, rounds: int = 300) -> np.ndarray:
    """Flat-kernel mean shift in one dimension: labels of modes in order of their place."""
    s = np.sort(x)
    c = np.concatenate([[0.0], np.cumsum(s)])
    at = x.astype(float).copy()
    for _ in range(rounds):
        lo, hi = np.searchsorted(s, at - bandwidth, "left"), np.searchsorted(s, at + bandwidth, "right")
        new = (c[hi] - c[lo]) / (hi - lo)
        if np.abs(new - at).max() < 1e-3 * bandwidth:
            break
        at = new
    modes = np.sort(at)
    ids = np.concatenate([[0], np.cumsum(np.diff(modes) > bandwidth)])
    return ids[np.searchsorted(modes, at)]


def silhouette(obs: DataFrame) -> DataFrame:
    """Mean silhouette of labelled one-dimensional points, ``locus, silhouette``; loci with one label give no row.

    Sums of distances to a label follow from sorted prefix sums, so no pairs
    are formed.
    """
    marks = obs.groupBy("locus", "label").agg(F.count("*").alias("n"), F.sum("mu").alias("s")).withColumnRenamed("label", "other")
    kinds = marks.groupBy("locus").agg(F.count("*").alias("k")).where("k > 1").select("locus")
    p = obs.join(kinds, "locus", "left_semi").join(marks.select("locus", "other", "n", "s"), "locus")
    w = Window.partitionBy("locus", "other").orderBy("mu", "sample").rowsBetween(Window.unboundedPreceding, 0)
    mine = F.col("label") == F.col("other")
    p = p.withColumn("_c", F.sum(mine.cast("int")).over(w)).withColumn("_p", F.sum(F.when(mine, F.col("mu")).otherwise(0.0)).over(w))
    total = F.col("mu") * F.col("_c") - F.col("_p") + (F.col("s") - F.col("_p")) - F.col("mu") * (F.col("n") - F.col("_c"))
    p = p.withColumn("_d", F.when(mine, F.when(F.col("n") > 1, total / (F.col("n") - 1))).otherwise(total / F.col("n")))
    q = p.groupBy("locus", "sample").agg(F.max(F.when(mine, F.col("_d"))).alias("a"), F.min(F.when(~mine, F.col("_d"))).alias("b"))
    return q.groupBy("locus").agg(F.avg(F.when(F.col("a").isNull(), 0.0).when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))


def reported_calls(segments: DataFrame, axis: DataFrame, keys: list[str]) -> DataFrame:
    """Segments as calls: the last of a track is not reported, and a call ends with the window after its last one."""
    w = Window.partitionBy(*keys).orderBy("w0")
    s = segments.withColumn("_next", F.lead("w0").over(w)).where("_next is not null")
    ends = axis.select("contig", F.col("w").alias("w1"), F.col("end").alias("call_end"))
    return s.join(ends, ["contig", "w1"]).drop("_next")


def called_segments(segments: DataFrame, track: DataFrame, keys: list[str], exclusions: DataFrame, width: int, min_length: int = 20_000) -> DataFrame:
    """Segments as calls outside the exclusions: ``keys, start, end, w0, w1, mean, n``.

    ``segments(keys, w0, w1, start)`` are reported as :func:`reported_calls`
    does; what is left of each outside ``exclusions(contig, start, end)`` longer
    than ``min_length`` is cut to the windows of ``track(keys, w, start, end,
    cp)`` that lie in it whole.  Pieces without such a window, and windows
    without a row, make no call.  ``width`` is the bin of the interval joins.
    """
    axis = track.select("contig", "w", "start", "end").distinct()
    of = F.concat_ws(":", *keys, F.col("w0").cast("string"))
    reported = reported_calls(segments, axis, keys).withColumn("call_id", of)
    pieces = iv.subtracted(
        reported.select("call_id", F.col("contig").alias("chr"), "start", F.col("call_end").alias("end")), exclusions.select(F.col("contig").alias("chr"), "start", "end"), 0, width, min_length
    )
    named = pieces.join(reported.select("call_id", *keys), "call_id").select(*keys, "call_id", F.col("chr").alias("of"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    cells = track.select(*keys, "w", "start", "end", "cp")
    inside = iv.interval_join(cells, named.drop("of"), keys, width).where("start >= b_start and end <= b_end")
    return inside.groupBy(*keys, "call_id", "b_start").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("w").alias("w0"), (F.max("w") + 1).alias("w1"), F.avg("cp").alias("mean"), F.count("*").alias("n")
    ).drop("call_id", "b_start")


def histogram_2d(df: DataFrame, x: str, y: str, step_x: float, step_y: float) -> DataFrame:
    """Counts of a two-dimensional grid."""
    return df.groupBy(F.floor(F.col(x) / step_x).alias("bx"), F.floor(F.col(y) / step_y).alias("by")).agg(F.count("*").alias("n"))


def value_histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Equal-width histogram with a tenth as many bins as values, or half as many for up to 50: keys, bin, n."""
    s = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_k"))
    bins = F.greatest(F.lit(1), F.floor(F.when(F.col("_k") > 50, F.col("_k") / 10).otherwise(F.col("_k") / 2)))
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), bins - 1))
    return df.join(s, keys).groupBy(*keys, b.cast("long").alias("bin")).agg(F.count("*").alias("n"))
