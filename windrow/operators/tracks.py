"""Operators on windowed numeric tracks: recentring, ratios, repair, rolling statistics, runs, kernels, edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.operators.scan import key_rank, lagged, neighbours, running_count, with_halo
from windrow.operators.selection import exact_medians
from windrow.sources.scratch import written

#: Windows of a tile for rolling frames.
TILE = 65_536


def recentred(track: DataFrame, keys: list[str], skip: Column | None = None, large: bool = False) -> DataFrame:
    """Shift non-zero values so that the median of the non-zero ones is 2; rows where ``skip`` holds stay.

    With ``large`` the medians come by counts of buckets, a few passes over
    ``track``, and no group's values have to fit a task's memory.
    """
    if large:
        median = exact_medians(track.withColumn("_c", F.when(F.col("cp") != 0, F.col("cp"))), keys, "_c", "_m")
    else:
        median = track.groupBy(*keys).agg(F.median(F.when(F.col("cp") != 0, F.col("cp"))).alias("_m"))
    moved = F.when(F.col("cp") != 0, F.col("cp") + (2 - F.col("_m"))).otherwise(F.col("cp"))
    value = moved if skip is None else F.when(skip, F.col("cp")).otherwise(moved)
    return track.join(median, keys).withColumn("cp", value).drop("_m")


def log2_ratio(test: DataFrame, ref: DataFrame) -> DataFrame:
    """log2(test / ref) by (contig, w) over the windows of both tracks; absent, zero or non-finite ratios are null."""
    t, r = test.select("contig", "w", F.col("cp").alias("t")), ref.select("contig", "w", F.col("cp").alias("r"))
    return t.join(r, ["contig", "w"], "full").select("contig", "w", _finite_log2().alias("value"))


def log2_ratios(tests: DataFrame, ref: DataFrame) -> DataFrame:
    """The same for every sample of ``tests`` over its own windows: ``contig, sample, w, value``; the reference's windows are met once for all samples."""
    t, r = tests.select("contig", "sample", "w", F.col("cp").alias("t")), ref.select("contig", "w", F.col("cp").alias("r"))
    return t.join(r, ["contig", "w"], "left").select("contig", "sample", "w", _finite_log2().alias("value"))


def _finite_log2() -> Column:
    q = F.when((F.col("r") != 0) & (F.col("t") > 0), F.log2(F.col("t") / F.col("r")))
    return F.when(~F.isnan(q) & (F.abs(q) != float("inf")), q)


def repaired(track: DataFrame, keys: list[str]) -> DataFrame:
    """Replace runs of null ``value`` by the mean of the flanking values; ordinals ``w`` are dense from 0.

    At the left edge the right neighbour serves; a run that ends at or beyond
    the last window but one takes the left neighbour.  A track without any
    value stays null.
    """
    last = track.groupBy(*keys).agg(F.max("w").alias("_last"))
    j = neighbours(track, keys, "w", "value", TILE).join(last, keys)
    left, right = F.col("_before.v"), F.col("_after.v")
    end = F.coalesce("_after.at", F.col("_last") + 1)
    fill = F.when(left.isNull(), right).when(right.isNull() | (end >= F.col("_last")), left).otherwise((left + right) / 2)
    return j.withColumn("value", F.coalesce("value", fill)).drop("_before", "_after", "_last")


def _ends(track: DataFrame, keys: list[str], value: str) -> DataFrame:
    return track.groupBy(*keys).agg(F.count("*").alias("_n"), F.min_by(value, "w").alias("_f"), F.max_by(value, "w").alias("_l"))


def windowed_variance(track: DataFrame, keys: list[str], h: int, centred: bool = False, tile: int = TILE) -> DataFrame:
    """Adds ``variance``: mean square of ``cp`` over 2h+1 windows, clamped at the edges, about a mean.

    The mean trails (zero-padded, the last 2h+1 windows) unless ``centred``.
    Ordinals are dense, so border sums follow from the first and last value.
    """
    t = with_halo(track, "w", 2 * h, h, tile)
    w = Window.partitionBy(*keys, "_tile").orderBy("w")
    around, trail = w.rowsBetween(-h, h), w.rowsBetween(-2 * h, 0)
    sums = t.select("*", F.sum("cp").over(around).alias("_s1"), F.sum(F.col("cp") * F.col("cp")).over(around).alias("_s2"), (F.sum("cp").over(trail) / (2 * h + 1)).alias("_m")).where("_core")
    j = sums.join(_ends(track, keys, "cp"), keys)
    a = F.greatest(F.lit(h) - F.col("w"), F.lit(0))
    b = F.greatest(F.col("w") + h - (F.col("_n") - 1), F.lit(0))
    s1 = F.col("_s1") + a * F.col("_f") + b * F.col("_l")
    s2 = F.col("_s2") + a * F.col("_f") * F.col("_f") + b * F.col("_l") * F.col("_l")
    m = s1 / (2 * h + 1) if centred else F.col("_m")
    v = (s2 - 2 * m * s1 + (2 * h + 1) * m * m) / (2 * h + 1)
    return j.withColumn("variance", v).drop("_tile", "_core", "_s1", "_s2", "_m", "_n", "_f", "_l")


def shifted(track: DataFrame, keys: list[str], by: int, value: str, out: str) -> DataFrame:
    """Circular shift: adds ``out``, the ``value`` that stood ``by`` windows earlier."""
    n = track.groupBy(*keys).agg(F.count("*").alias("_n"))
    source = track.join(n, keys).select(*keys, F.pmod(F.col("w") + by, F.col("_n")).alias("w"), F.col(value).alias(out))
    return track.join(source, [*keys, "w"])


def moving(track: DataFrame, keys: list[str], width: int, how: str = "avg", first: bool = False, tile: int = TILE) -> DataFrame:
    """Mean or sum of ``width`` consecutive windows ending at each; the very first window of full width only if ``first``."""
    t = with_halo(track, "w", width - 1, 0, tile)
    frame = Window.partitionBy(*keys, "_tile").orderBy("w").rowsBetween(-(width - 1), 0)
    out = (F.avg("cp") if how == "avg" else F.sum("cp")).over(frame)
    return t.withColumn("moving", out).where(F.col("_core") & (F.col("w") >= width - (1 if first else 0))).drop("_tile", "_core")


def bands(track: DataFrame, keys: list[str], cap: int = 10) -> DataFrame:
    """Run-length bands of the rounded, capped value over consecutive windows: keys, start, end, cn."""
    t = track.withColumn("cn", F.least(F.round("cp"), F.lit(float(cap))).cast("int"))
    t = lagged(t, keys, ["w"], "w", "cn", "_was", TILE)
    g = running_count(t, keys, ["w"], "w", F.coalesce(F.col("_was") != F.col("cn"), F.lit(True)), "_band", TILE)
    return g.groupBy(*keys, "_band").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("cn").alias("cn")).drop("_band")


def smoothed(track: DataFrame, keys: list[str], times: int = 1) -> DataFrame:
    """Binomial smoothing [1, 2, 1] / 4 of ``cp``, ``times`` over, mirrored at the edges; ordinals are dense."""
    for _ in range(times):
        t = with_halo(track, "w", 1, 1, TILE)
        w = Window.partitionBy(*keys, "_tile").orderBy("w")
        cp = F.col("cp")
        mean = (F.coalesce(F.lag("cp").over(w), cp) + 2 * cp + F.coalesce(F.lead("cp").over(w), cp)) / 4
        track = t.withColumn("_cp", mean).where("_core").withColumn("cp", F.col("_cp")).drop("_cp", "_tile", "_core")
    return track


def midpoint_tiles(axis: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles between the half-way points of neighbouring windows' midpoints; the outer ones end at the window's own border."""
    t = axis.withColumn("mid", F.floor((F.col("start") + F.col("end")) / 2).cast("long"))
    n = neighbours(t, keys, "w", "mid", TILE)
    half = lambda a, b: F.floor((a + b) / 2).cast("long")
    n = n.withColumn("t_end", F.coalesce(half(F.col("mid"), F.col("_after.v")), F.col("end")))
    return n.withColumn("t_start", F.coalesce(half(F.col("_before.v"), F.col("mid")), F.col("start"))).drop("_before", "_after")


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float, float, float]]:
    """(offset, weight of order 0, 1 and 2 in correlation form) of a sampled Gaussian."""
    r = int(truncate * sigma + 0.5)
    phi = [math.exp(-0.5 * x * x / (sigma * sigma)) for x in range(-r, r + 1)]
    total = sum(phi)
    return [(x, p / total, x / sigma**2 * p / total, (x * x / sigma**4 - 1 / sigma**2) * p / total) for x, p in zip(range(-r, r + 1), phi, strict=True)]


def mirrored_tiles(track: DataFrame, keys: list[str], r: int, tile: int) -> DataFrame:
    """``keys, w, cp, at, _n, _tile, _core``: tiles of ``tile`` places with ``r`` more on either side, mirrored at the track's edges; ``at`` is the place, ``_n`` the track's length."""
    n = track.groupBy(*keys).agg(F.count("*").alias("_n"))
    t = track.select(*keys, "w", "cp").join(n, keys)
    images = F.array(F.col("w"), F.when(F.col("w") < r, -F.col("w") - 1), F.when(F.col("w") >= F.col("_n") - r, 2 * F.col("_n") - 1 - F.col("w")))
    # a track shorter than the kernel is folded again and again
    folded = F.when(F.col("_n") >= r, F.array_compact(images)).otherwise(
        F.filter(F.sequence(F.lit(-r).cast("long"), F.col("_n") + r), lambda x: F.least(F.pmod(x, 2 * F.col("_n")), 2 * F.col("_n") - 1 - F.pmod(x, 2 * F.col("_n"))) == F.col("w"))
    )
    return with_halo(t.withColumn("at", F.explode(folded)), "at", r, r, tile)


def gaussian_derivatives(track: DataFrame, keys: list[str], sigma: float, kernel: list[tuple] | None = None) -> DataFrame:
    """``keys, w, g0, g1, g2``: smoothed value and its first two derivatives, mirrored at the edges; ordinals are dense.

    The values of a tile and its halo meet once, as an array; each window is
    a dot product of the kernel with a slice of it.
    """
    kernel = kernel or gaussian_kernel(sigma)
    r = max(k[0] for k in kernel)
    tile = max(4 * r, 1_024)
    placed = mirrored_tiles(track, keys, r, tile)
    seen = placed.groupBy(*keys, "_tile", "_n").agg(F.array_sort(F.collect_list(F.struct("at", "cp"))).alias("s"))  # tile + 2 r values
    first = F.element_at("s", 1)["at"]
    seen = seen.withColumn("x", F.transform("s", lambda v: v["cp"])).withColumn("first", first)
    lo = F.greatest(F.lit(0).cast("long"), F.col("_tile") * tile)
    hi = F.least(F.col("_n"), (F.col("_tile") + 1) * tile) - 1
    out = seen.where(lo <= hi).withColumn("w", F.explode(F.sequence(lo, hi)))
    window = F.slice("x", (F.col("w") - F.col("first") - r + 1).cast("int"), 2 * r + 1)
    out = out.select(*keys, "w", window.alias("v"))
    weights = [F.array(*(F.lit(float(k[i])) for k in kernel)) for i in (1, 2, 3)]
    dot = lambda w: F.aggregate(F.zip_with("v", w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return out.select(*keys, "w", *(dot(w).alias(f"g{i}") for i, w in enumerate(weights)))


def edges(derivatives: DataFrame, keys: list[str], collapsed: bool = True, tile: int = TILE) -> DataFrame:
    """Sign changes of g2 with both ends, the strongest by |g1| where there are too many: ``keys, w, sign``.

    All intercepts stay if there are as many as windows, else the
    ``min(intercepts, windows - intercepts)`` strongest; cells whose own g2
    is 0 go.  The sign is -1 for every edge if ``collapsed``.  Signs are
    compared within tiles of ``tile`` windows, strengths ranked by buckets.
    """
    s = derivatives.select(*keys, "w", (-F.abs("g1")).alias("_weak"), F.signum("g2").alias("_s"))
    n = derivatives.groupBy(*keys).agg(F.count("*").alias("_n"))
    s = lagged(s, keys, ["w"], "w", "_s", "_was", tile).join(n, keys)
    cut = s.where((F.col("_was") != F.col("_s")) | (F.col("w") == 0) | (F.col("w") == F.col("_n") - 1))
    cut = written(cut.select(*keys, "w", "_weak", "_s", "_n"), "cuts")
    size = cut.groupBy(*keys).agg(F.count("*").alias("_len"))
    cut = key_rank(cut, keys, ["_weak", "w"], "_rank").join(size, keys)
    keep = F.when(F.col("_len") == F.col("_n"), F.col("_len")).otherwise(F.least("_len", F.col("_n") - F.col("_len")))
    kept = cut.where((F.col("_rank") < keep) & (F.col("_s") != 0))
    return kept.select(*keys, "w", (F.lit(-1) if collapsed else F.col("_s").cast("int")).alias("sign"))
