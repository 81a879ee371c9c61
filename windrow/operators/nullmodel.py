"""Null distributions and significance of segment values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from windrow.functions import special
from windrow.operators.scan import ordered_buckets
from windrow.sources.scratch import written
from windrow.operators.tracks import moving


#: Bins of a null histogram at most.
MAX_BINS = 20_000
#: Deviation of a histogram whose values are all equal.
LEAST_SD = 1e-9


@F.pandas_udf(DoubleType())
def t_cdf(t: pd.Series, df: pd.Series) -> pd.Series:
    """Student t distribution function."""
    return pd.Series(special.t_cdf(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """Standard normal distribution function."""
    return pd.Series(special.normal_cdf(x.to_numpy(float)))


@F.pandas_udf(DoubleType())
def fisher_p(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Two-sided Fisher exact p of each row's 2 x 2 table."""
    for columns in batches:
        rows = zip(*(c.to_numpy(np.int64).tolist() for c in columns), strict=True)
        yield pd.Series([special.fisher_exact(*r) for r in rows], dtype=float)


def masked(track: DataFrame, masks: DataFrame) -> DataFrame:
    """Track without the windows whose ordinal lies in a mask(contig, first, last)."""
    cells = masks.select("contig", F.explode(F.sequence("first", F.col("last") - 1)).alias("w")).distinct()
    return track.join(cells, ["contig", "w"], "left_anti")


def moments(track: DataFrame) -> DataFrame:
    """One row: n, mean and population variance of the null."""
    return track.agg(F.count("cp").alias("null_n"), F.avg("cp").alias("null_mean"), F.var_pop("cp").alias("null_var"))


def welch(calls: DataFrame, null: DataFrame) -> DataFrame:
    """Adds t and df of the corrected Welch test to calls(n, mean, var); effective sizes are square roots."""
    j = calls.join(F.broadcast(null), F.lit(True))  # one row
    n1, n2 = F.greatest(F.sqrt("n"), F.lit(2.0)), F.sqrt("null_n")
    a, b = F.col("var") / n1, F.col("null_var") / n2
    return j.withColumn("t", (F.col("mean") - F.col("null_mean")) / F.sqrt(a + b)).withColumn("df", F.pow(a + b, F.lit(2)) / (a * a / (n1 - 1) + b * b / (n2 - 1)))


def folded_p() -> Column:
    """min(cdf, 1 - cdf) of (t, df); 0.5 where the call's variance is 0."""
    c = t_cdf(F.col("t"), F.col("df"))
    return F.when(F.col("var") == 0, F.lit(0.5)).otherwise(F.least(c, 1 - c))


def histogram(track: DataFrame, keys: list[str], width: int, how: str = "avg") -> DataFrame:
    """Density and cumulative density of moving means (or sums, for log-likelihoods): ``bin, lo, hi, n, share, cumulative``.

    Bins have 3.5 sd / n^(1/3) / 10 between -5 sd and 5 sd, but there are no
    more than MAX_BINS of them, and one open bin on either side.
    """
    return value_histogram(moving(track, keys, width, how).select("moving"))


def value_histogram(m: DataFrame) -> DataFrame:
    """The same histogram over a column ``moving`` of any values; equal ones have a deviation of LEAST_SD, so that there are bins."""
    s = m.agg(F.stddev_pop("moving").alias("sd"), F.count("*").alias("total")).withColumn("sd", F.when(F.col("sd") == 0, F.lit(LEAST_SD)).otherwise(F.col("sd")))
    step = 3.5 * F.col("sd") / F.pow(F.col("total").cast("double"), F.lit(1.0 / 3.0)) / 10
    step = F.greatest(step, 10 * F.col("sd") / F.lit(float(MAX_BINS)))
    s = s.withColumn("step", step).withColumn("bins", F.ceil(10 * F.col("sd") / F.col("step")))
    one = F.broadcast(s)
    last = F.col("bins") - 1
    at = F.floor((F.col("moving") + 5 * F.col("sd")) / F.col("step"))
    counted = m.join(one, F.lit(True)).groupBy(F.greatest(F.lit(-1), F.least(at, last)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    grid = s.select(F.explode(F.sequence(F.lit(-1).cast("long"), F.col("bins").cast("long") - 1)).alias("bin"), "sd", "step", "total", "bins")
    full = grid.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # MAX_BINS rows at most
    lo = F.when(F.col("bin") < 0, F.lit(-99999.9)).otherwise(-5 * F.col("sd") + F.col("bin") * F.col("step"))
    hi = F.when(F.col("bin") == last, F.lit(99999.9)).otherwise(-5 * F.col("sd") + (F.col("bin") + 1) * F.col("step"))
    return full.select("bin", lo.alias("lo"), hi.alias("hi"), "n", (F.col("n") / F.col("total")).alias("share"), (F.sum("n").over(up) / F.col("total")).alias("cumulative"))


def _cumulative_at(df: DataFrame, hist: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ``out``: the cumulative density one bin beyond the one that holds ``value``."""
    table = hist.agg(F.sort_array(F.collect_list(F.struct("bin", "lo", "cumulative"))).alias("_h"))  # MAX_BINS entries at most
    table = table.withColumn("_step", F.get("_h", F.lit(2))["lo"] - F.get("_h", F.lit(1))["lo"])
    j = df.join(F.broadcast(table), F.lit(True))
    v, first = F.col(value), F.element_at("_h", 2)["lo"]
    # edges are even but for the outer ones: a guess by division, moved by one where rounding misled it
    steps = F.greatest(F.lit(0.0), F.least((v - first) / F.col("_step"), F.size("_h").cast("double")))  # beyond the bins a step may be too small for a long
    guess = F.least(F.ceil(steps) + 1, F.size("_h")).cast("int")
    at = F.when(F.element_at("_h", guess)["lo"] >= v, guess - 1).when((guess < F.size("_h")) & (F.element_at("_h", F.least(guess + 1, F.size("_h")))["lo"] < v), guess + 1).otherwise(guess)
    return j.withColumn(out, F.element_at("_h", F.least(F.greatest(at, F.lit(0)) + 2, F.size("_h")).cast("int"))["cumulative"]).drop("_h", "_step")


def empirical_p(calls: DataFrame, hist: DataFrame, value: str, width: int) -> DataFrame:
    """Adds ``p`` from the cumulative histogram, one bin beyond the value's, folded, times sqrt(width), 0.5 at most."""
    j = _cumulative_at(calls, hist, value, "_c")
    folded = F.when(F.col("_c") > 0.5, 1 - F.col("_c")).otherwise(F.col("_c"))
    return j.withColumn("p", F.least(F.greatest(folded, F.lit(0.0)) * F.sqrt(F.lit(float(width))), F.lit(0.5))).drop("_c")


def calibration(track: DataFrame, keys: list[str], widths, means) -> DataFrame:
    """``width, mu, p``: folded p of each mean under the null distribution of means over each width's windows."""
    spark, out = track.sparkSession, None
    for width in widths:
        grid = spark.createDataFrame([(int(width), float(m)) for m in means], "width int, mu double")
        p = empirical_p(grid, histogram(track, keys, int(width)), "mu", 1)
        out = p if out is None else out.unionByName(p)
    return out


def log_p_track(track: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The histogram of single windows, and the track with ``cp`` replaced by the log of its folded cumulative density.

    A window beyond all bins counts as half a window, so that logs are finite.
    """
    hist = written(value_histogram(track.select(F.col("cp").alias("moving"))), "histogram")  # read at several places of one plan
    total = hist.agg(F.sum("n").alias("_total"))
    j = _cumulative_at(track, hist, "cp", "_c").join(F.broadcast(total), F.lit(True))  # one row
    folded = F.greatest(F.when(F.col("_c") > 0.5, 1 - F.col("_c")).otherwise(F.col("_c")), 0.5 / F.col("_total"))
    return hist, j.withColumn("cp", F.log(folded)).drop("_c", "_total")


def likelihood_p(calls: DataFrame, cells: DataFrame, track: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``call_id, ll, p``: the summed log density of a call's windows against sums over ``width`` consecutive windows of the null, folded.

    ``cells(call_id, cp)`` are the windows of ``calls(call_id)``; the call's
    densities are not folded, those of the null are.  Track, histogram and
    logs are stored, so that the plan does not hold the track's own some 30 times.
    """
    hist, logs = log_p_track(written(track, "track"))
    logs = written(logs, "logs")
    total = hist.agg(F.sum("n").alias("_total"))
    own = _cumulative_at(cells, hist, "cp", "_c").join(F.broadcast(total), F.lit(True))  # one row
    value = own.groupBy("call_id").agg(F.sum(F.log(F.greatest("_c", 0.5 / F.col("_total")))).alias("ll"))
    c = _cumulative_at(calls.join(value, "call_id"), histogram(logs, keys, width, "sum"), "ll", "_c")
    return c.select("call_id", "ll", F.greatest(F.when(F.col("_c") > 0.5, 1 - F.col("_c")).otherwise(F.col("_c")), F.lit(0.0)).alias("p"))


def plain_welch_p(calls: DataFrame, null: DataFrame) -> DataFrame:
    """Adds ``t, df, p`` of the two-sided Welch test of calls(n, mean, var) against the null, with sample variances and all windows counted."""
    j = calls.join(F.broadcast(null), F.lit(True))  # one row
    a, b = F.col("var") / (F.col("n") - 1), F.col("null_var") / (F.col("null_n") - 1)
    j = j.withColumn("t", (F.col("mean") - F.col("null_mean")) / F.sqrt(a + b)).withColumn("df", (a + b) * (a + b) / (a * a / (F.col("n") - 1) + b * b / (F.col("null_n") - 1)))
    return j.withColumn("p", F.when(F.col("n") > 1, 2 * t_cdf(-F.abs("t"), F.col("df"))))


def deciles(df: DataFrame, value: str, parts: int = 10) -> DataFrame:
    """Edges of equal-count bins: the values at sorted positions i * (n div parts), and the largest.

    Equal values are counted first; positions come from counts of buckets of
    values carried over, so no task sorts them all.
    """
    n = df.agg(F.count(value)).first()[0]
    if not n:
        return df.sparkSession.createDataFrame([], "i int, edge double")
    per = df.select(F.col(value).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("_n"))
    b = ordered_buckets(per, ["v"], n)
    above = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = b.groupBy("_b").agg(F.sum("_n").alias("_m")).withColumn("_carry", F.coalesce(F.sum("_m").over(above), F.lit(0))).drop("_m")
    to = F.sum("_n").over(Window.partitionBy("_b").orderBy("v")) + F.col("_carry")
    held = b.join(F.broadcast(carry), "_b").withColumn("_to", to)  # a row a bucket
    want = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(i * (n // parts)).alias("pos")) for i in range(parts)))
    inside = F.filter(want, lambda w: (w["pos"] >= F.col("_to") - F.col("_n")) & (w["pos"] < F.col("_to")))
    edges = held.select(F.explode(inside).alias("w"), F.col("v").alias("edge")).select("w.i", "edge")
    return edges.unionByName(df.agg(F.max(value).alias("edge")).select(F.lit(parts).alias("i"), "edge"))


def rank_sum(df: DataFrame, group: str, value: str, keys: list[str]) -> DataFrame:
    """Wilcoxon rank-sum z and two-sided p of groups true and false, average ranks, no tie correction; null values do not count.

    Ranks come from the counts of each distinct value, carried over buckets
    of (keys, value), so no task sorts a whole key.
    """
    per = written(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"), F.count_if(group).alias("_n1")), "values")
    b = ordered_buckets(per, [*keys, "_v"], per.count())
    above = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = b.groupBy("_b").agg(F.sum("_n").alias("_m")).withColumn("_carry", F.coalesce(F.sum("_m").over(above), F.lit(0))).drop("_m")
    inside = Window.partitionBy("_b").orderBy(*keys, "_v").rowsBetween(Window.unboundedPreceding, -1)
    held = b.join(F.broadcast(carry), "_b").withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)) + F.col("_carry"))  # a row a bucket
    first = held.groupBy(*keys).agg(F.min("_before").alias("_first"))
    rank = F.col("_before") - F.col("_first") + (F.col("_n") + 1) / 2
    s = held.join(first, keys).groupBy(*keys).agg(F.sum(F.when(F.col("_n1") > 0, F.col("_n1") * rank)).alias("s"), F.sum("_n1").alias("n1"), F.sum(F.col("_n") - F.col("_n1")).alias("n2"))
    z = (F.col("s") - F.col("n1") * (F.col("n1") + F.col("n2") + 1) / 2.0) / F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12.0)
    return s.withColumn("z", z).withColumn("p", 2 * (1 - normal_cdf(F.abs("z"))))
