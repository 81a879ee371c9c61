"""Interval operators: searchsorted lookup, overlap joins, islands, clusters, subtraction.

Intervals are half-open.  Overlap tests are strict unless a name says
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.operators.scan import exclusive_max, running_count, tile_width

#: Axis windows aimed at in a bin of the lookup.
BIN_ROWS = 64
#: Ids at most in a piece of a class of equal intervals; pairs of calls of a bin aimed at in a task, and tasks at most.
PIECE, TASK_PAIRS, MOST_TASKS = 64, 1 << 25, 4096


def overlaps(s1, e1, s2, e2) -> Column:
    """Strict: touching intervals do not overlap."""
    return (F.col(s1) < F.col(e2)) & (F.col(s2) < F.col(e1))


def overlaps_closed(s1, e1, s2, e2) -> Column:
    """Closed on both sides: touching counts."""
    return (F.greatest(s1, s2) <= F.least(e1, e2))


def overlaps_unless_abutting(s1, e1, s2, e2) -> Column:
    """Closed, but intervals that merely abut do not overlap."""
    return overlaps_closed(s1, e1, s2, e2) & (F.col(e1) != F.col(s2)) & (F.col(e2) != F.col(s1))


def asof_index(points: DataFrame, axis: DataFrame, point: str, coordinate: str, out: str, keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Left searchsorted: adds ``out``, the least ``w`` of the axis with ``coordinate >= point``, or its length.

    The axis has dense ordinals ``w`` per key.  It is binned by coordinate; a
    point meets the windows of its own bin by an equi-join and otherwise the
    first window of a later bin, which a suffix minimum over the bins gives.
    """
    keys = keys or ["contig"]
    width = width or tile_width(axis, keys, coordinate, BIN_ROWS)
    a = axis.select(*keys, F.col("w").alias("_w"), F.col(coordinate).alias("_c"), F.floor(F.col(coordinate) / width).alias("_bin"))
    distinct = points.select(*keys, F.col(point).alias("_x")).distinct().withColumn("_bin", F.floor(F.col("_x") / width))
    here = distinct.join(a, [*keys, "_bin"]).where("_c >= _x").groupBy(*keys, "_x").agg(F.min("_w").alias("_here"))
    bins = a.groupBy(*keys, "_bin").agg(F.min("_w").alias("_first"), F.max("_w").alias("_last"))
    n = bins.groupBy(*keys).agg((F.max("_last") + 1).alias("_n"))
    # the first window of any later bin: an as-of step over bins and points' bins together
    later = distinct.select(*keys, "_bin").distinct().withColumn("_first", F.lit(None).cast("long")).withColumn("_point", F.lit(True))
    both = bins.select(*keys, "_bin", "_first").withColumn("_point", F.lit(False)).unionByName(later)
    ahead = Window.partitionBy(*keys).orderBy("_bin").rangeBetween(1, Window.unboundedFollowing)
    later = both.withColumn("_later", F.min("_first").over(ahead)).where("_point").select(*keys, "_bin", "_later")
    found = distinct.join(here, [*keys, "_x"], "left").join(later, [*keys, "_bin"], "left").join(n, keys, "left")
    found = found.select(*keys, F.col("_x").alias(point), F.coalesce("_here", "_later", "_n", F.lit(0)).cast("long").alias(out))
    return points.join(found, [*keys, point], "left")


def slices(regions: DataFrame, axis: DataFrame, rule: str) -> DataFrame:
    """Adds ``w0, w1`` (half-open window ordinals) of each region by one of the named rules.

    ``genotyper``: [ss(starts, s), ss(ends, e)), one window if empty, else
    without its first if it has several.  ``mean``: ss(starts, s) to
    min(ss(ends, e) + 1, n - 1) with the last one in.  ``median``: the same,
    the end pushed past the start if it is not beyond.
    """
    r = asof_index(regions, axis, "start", "start", "w0")
    r = asof_index(r, axis, "end", "end", "w1")
    n = axis.groupBy("contig").agg((F.max("w") + 1).alias("_n"))
    if rule == "genotyper":
        end = F.when(F.col("w1") <= F.col("w0"), F.col("w0") + 1).otherwise(F.col("w1"))
        r = r.withColumn("w1", end)
        return r.withColumn("w0", F.when(F.col("w1") - F.col("w0") > 1, F.col("w0") + 1).otherwise(F.col("w0")))
    if rule == "matrix":
        return r.join(n, "contig", "left").withColumn("w1", F.least(F.col("w1") + 1, F.coalesce("_n", F.lit(0)))).drop("_n")
    r = r.join(n, "contig", "left").withColumn("w1", F.least(F.col("w1") + 1, F.col("_n") - 1))
    if rule == "median":
        r = r.withColumn("w1", F.when(F.col("w1") <= F.col("w0"), F.col("w0") + 1).otherwise(F.col("w1")))
    elif rule != "mean":
        raise ValueError(f"unknown slice rule: {rule}")
    return r.withColumn("w1", F.col("w1") + 1).drop("_n")


def slice_join(sliced: DataFrame, panel: DataFrame) -> DataFrame:
    """Panel cells of each slice: window ordinals are expanded and met by an equi-join on (contig, w)."""
    spread = sliced.where("w1 > w0").withColumn("w", F.explode(F.sequence("w0", F.col("w1") - 1)))
    return spread.join(panel.select("contig", "w", "sample", "cp"), ["contig", "w"])


def in_bins(df: DataFrame, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """A row for each bin of ``width`` that an interval touches, with its number ``_bin``."""
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / width))))


def interval_join(a: DataFrame, b: DataFrame, keys: list[str], width: int, how: str = "inner", binned: bool = False) -> DataFrame:
    """Pairs of strictly overlapping intervals of ``a(start, end)`` and ``b(b_start, b_end)``.

    Both sides go to every bin of ``width`` that they touch (they are there
    already if ``binned``); a pair is kept in the bin where its overlap begins,
    so it comes once.
    """
    left, right = (a, b) if binned else (in_bins(a, width), in_bins(b, width, "b_start", "b_end"))
    hit = overlaps("start", "end", "b_start", "b_end") & (F.floor(F.greatest("start", "b_start") / width) == F.col("_bin"))
    return left.join(right, [*keys, "_bin"]).where(hit).drop("_bin")


def interval_classes(calls: DataFrame, keys: list[str], piece: int = PIECE) -> DataFrame:
    """Distinct intervals of ``calls(call_id, keys, start, end)`` with the sorted ``ids`` that have them, in pieces of at most ``piece``.

    Repeated ids stay repeated; calls without an id, a key, a start or an end are left out.
    """
    of = [*keys, "start", "end"]
    known = calls.select("call_id", *of).dropna()
    ranked = known.withColumn("_piece", F.floor((F.row_number().over(Window.partitionBy(*of).orderBy("call_id")) - 1) / piece))
    return ranked.groupBy(*of, "_piece").agg(F.array_sort(F.collect_list("call_id")).alias("ids")).drop("_piece")


def pair_tasks(calls: DataFrame, keys: list[str], width: int) -> int:
    """Tasks for the pairs of a bin's calls: no fewer than cores, else as many as the squares of the bins' counts ask for."""
    n = calls.groupBy(*keys, F.floor(F.col("start") / width)).count().agg(F.sum(F.pow("count", F.lit(2)))).first()[0] or 0
    return min(MOST_TASKS, max(calls.sparkSession.sparkContext.defaultParallelism, int(n // TASK_PAIRS)))


def reciprocal_pairs(calls: DataFrame, keys: list[str], width: int, piece: int = PIECE) -> DataFrame:
    """``a_id, b_id, recip`` of all pairs of strictly overlapping calls with ``a_id < b_id``.

    Classes of equal intervals are joined and compared, their members are
    paired only behind the join.  So the shuffle grows with the calls and not
    with their pairs, and the rows of two classes follow each other.  Both
    sides of the join read the same bins, which are dealt once, over as many
    tasks as the pairs ask for, and in order, so that neighbours meet the same
    classes one after the other.
    """
    c = in_bins(interval_classes(calls, keys, piece), width).repartition(pair_tasks(calls, keys, width), *keys, "_bin").sortWithinPartitions(*keys, "_bin", "start", "end", "ids")
    a = c.withColumnRenamed("ids", "a_ids")
    b = c.select(*keys, "_bin", F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("ids").alias("b_ids"))
    pairs = reciprocal(interval_join(a, b, keys, width, binned=True).where(F.col("a_ids")[0] < F.element_at("b_ids", -1)))
    rows = pairs.select(F.explode("a_ids").alias("a_id"), "b_ids", "recip")
    return rows.select("a_id", F.explode("b_ids").alias("b_id"), "recip").where("a_id < b_id")


def overlap_clusters(calls: DataFrame, keys: list[str], order: list[str], closed: bool = False) -> DataFrame:
    """Adds ``cluster_no`` (from 1 within ``keys``): a cluster begins where start reaches the largest end so far."""
    width = tile_width(calls, keys, "start")
    swept = exclusive_max(calls, keys, order, "start", "end", "_reach", width)
    begin = F.col("_reach").isNull() | (F.col("start") > F.col("_reach") if closed else F.col("start") >= F.col("_reach"))
    return running_count(swept, keys, order, "start", begin, "cluster_no", width).drop("_reach")


def merged(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Islands of overlapping intervals: keys, start, end."""
    d = intervals.select(*keys, "start", "end").distinct()
    return overlap_clusters(d, keys, ["start", "end"]).groupBy(*keys, "cluster_no").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("cluster_no")


def subtracted(calls: DataFrame, exclusions: DataFrame, pad: int, width: int, min_length: int = 0) -> DataFrame:
    """Pieces of ``calls(call_id, chr, start, end)`` outside the padded, merged exclusions; none for covered calls.

    Only exclusions longer than ``min_length`` count.
    """
    exclusions = exclusions.where(F.col("end") - F.col("start") > min_length)
    ex = merged(exclusions.select("chr", (F.col("start") - pad).alias("start"), (F.col("end") + pad).alias("end")), ["chr"])
    ex = ex.select("chr", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    hit = interval_join(calls, ex, ["chr"], width)
    w = Window.partitionBy("call_id").orderBy("b_start")
    gaps = hit.withColumn("s", F.coalesce(F.lag("b_end").over(w), F.col("start"))).withColumn("e", F.col("b_start"))
    tail = hit.groupBy("call_id", "chr", "end").agg(F.max("b_end").alias("s")).select("call_id", "chr", "s", F.col("end").alias("e"))
    cut = gaps.select("call_id", "chr", "s", "e").unionByName(tail).where("s < e")
    free = calls.join(hit.select("call_id").distinct(), "call_id", "left_anti").select("call_id", "chr", F.col("start").alias("s"), F.col("end").alias("e"))
    return cut.unionByName(free).select("call_id", "chr", F.col("s").alias("start"), F.col("e").alias("end"))


def reciprocal(pairs: DataFrame, max_dif: int | None = None, max_frac_uniq: float | None = None) -> DataFrame:
    """Adds ``recip`` to pairs(start, end, b_start, b_end): least share of either interval that the overlap covers."""
    o = F.least("end", "b_end") - F.greatest("start", "b_start")
    la, lb = F.col("end") - F.col("start"), F.col("b_end") - F.col("b_start")
    r = F.when(o > 0, F.least(o / la, o / lb)).otherwise(F.lit(0.0))
    if max_dif is not None:
        r = F.when(F.greatest(la - o, lb - o) > max_dif, F.lit(0.0)).otherwise(r)
    if max_frac_uniq is not None:
        r = F.when(1 - r >= max_frac_uniq, F.lit(0.0)).otherwise(r)
    return pairs.withColumn("recip", r)


def position_runs(df: DataFrame, keys: list[str], position: str = "w", tile: int | None = None) -> DataFrame:
    """Adds ``_run``, a number for each run of consecutive ordinals within ``keys``.

    Tiles of the axis are scanned apart; only their carries meet in one place.
    """
    tile = tile or tile_width(df, keys, position)
    swept = exclusive_max(df, keys, [position], position, position, "_before", tile)
    new = F.col("_before").isNull() | (F.col(position) - F.col("_before") > 1)
    return running_count(swept, keys, [position], position, new, "_run", tile).drop("_before")


def runs(df: DataFrame, keys: list[str], position: str = "w") -> DataFrame:
    """Runs of consecutive ordinals as keys, first, last (exclusive)."""
    g = position_runs(df, keys, position)
    return g.groupBy(*keys, "_run").agg(F.min(position).alias("first"), (F.max(position) + 1).alias("last")).drop("_run")


def covered_fraction(calls: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """``call_id, fraction``: share of each call that the merged features cover."""
    f = merged(features, ["chr"]).select("chr", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    hit = interval_join(calls, f, ["chr"], width).groupBy("call_id").agg(F.sum(F.least("end", "b_end") - F.greatest("start", "b_start")).alias("o"))
    return calls.join(hit, "call_id", "left").select("call_id", (F.coalesce("o", F.lit(0)) / (F.col("end") - F.col("start"))).alias("fraction"))
