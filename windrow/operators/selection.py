"""Exact medians of groups of any size, without a group's values in one buffer.

A group's range is cut into ``BUCKETS`` of equal width; counts of the buckets,
partially aggregated, tell in which one a rank lies, and only that bucket's
rows go on, with its own least and greatest value as the new range.  Once a
group has few rows left (or one value) their ordered list has the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.sources.scratch import written

#: Buckets of a step, and rows of a group that are ordered in one list.
BUCKETS, LIST_ROWS = 4_096, 100_000


def _ranked_list(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Values at the wanted ranks of groups of few rows."""
    v = rows.groupBy(*keys, "_lo_rank", "_hi_rank").agg(F.sort_array(F.collect_list("_v")).alias("l"))
    at = lambda c: F.element_at("l", (F.col(c) + 1).cast("int"))
    return v.select(*keys, at("_lo_rank").alias("_a"), at("_hi_rank").alias("_b"))


def exact_medians(df: DataFrame, keys: list[str], value: str, out: str = "median", buckets: int = BUCKETS, list_rows: int = LIST_ROWS) -> DataFrame:
    """``keys, out``: exact median of ``value`` in each group, the mean of the two middle ones if their number is even.

    Nulls and NaNs do not count; a group without other values has a null median.
    Infinite values count and are ordered as such.  Groups of up to
    ``list_rows`` rows take one step; larger ones are narrowed down first, each time to a
    range that is ``buckets`` times narrower or to a single value.
    """
    v = F.col(value).cast("double")
    groups = df.select(*keys).distinct()
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"))
    # the infinite ones are counted apart: a range that holds them has no buckets
    inf = float("inf")
    size = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(F.col("_v") == -inf).alias("_low"), F.count_if(F.col("_v") == inf).alias("_high"))
    state = size.select(*keys, F.floor((F.col("_n") - 1) / 2).alias("_lo_rank"), F.floor(F.col("_n") / 2).alias("_hi_rank"), "_low", "_high", "_n")
    ended = lambda rank: F.when(F.col(rank) < F.col("_low"), F.lit(-inf)).when(F.col(rank) >= F.col("_n") - F.col("_high"), F.lit(inf))
    state = written(state.withColumn("_known_a", ended("_lo_rank")).withColumn("_known_b", ended("_hi_rank")), "ranks")
    # ranks among the finite values; where one of the two is known to be infinite, the other stands for both
    rank = lambda own, known, other: (F.when(F.col(known).isNull(), F.col(own)).otherwise(F.col(other)) - F.col("_low")).alias(own)
    middle = state.where("_known_a is null or _known_b is null")
    middle = middle.select(*keys, rank("_lo_rank", "_known_a", "_hi_rank"), rank("_hi_rank", "_known_b", "_lo_rank"), (F.col("_n") - F.col("_low") - F.col("_high")).alias("_m"))
    finite = rows.where(F.abs("_v") < inf)
    few = finite.join(middle.where(F.col("_m") <= list_rows), keys).select(*keys, "_v", "_lo_rank", "_hi_rank")
    found = [_ranked_list(few, keys)]
    many = middle.where(F.col("_m") > list_rows)
    if many.take(1):
        ranges = finite.join(many.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        left = written(many.join(ranges, keys), "ranges")
        while left.take(1):
            one = left.where("_min = _max")
            found.append(one.select(*keys, F.col("_min").alias("_a"), F.col("_max").alias("_b")))
            small = left.where((F.col("_min") < F.col("_max")) & (F.col("_m") <= list_rows))
            within = (F.col("_v") >= F.col("_min")) & (F.col("_v") <= F.col("_max"))
            found.append(_ranked_list(finite.join(small, keys).where(within).select(*keys, "_v", "_lo_rank", "_hi_rank"), keys))
            left = written(_narrowed(finite, left.where((F.col("_min") < F.col("_max")) & (F.col("_m") > list_rows)), keys, within, buckets), "ranges")
            found.append(left.where("_apart").select(*keys, F.col("_min").alias("_a"), F.col("_max").alias("_b")))
            left = left.where("not _apart").drop("_apart")
    picked = found[0]
    for f in found[1:]:
        picked = picked.union(f)
    both = state.select(*keys, "_known_a", "_known_b").join(picked, keys, "left")
    a, b = F.coalesce("_known_a", "_a"), F.coalesce("_known_b", "_b")
    median = both.select(*keys, F.when(a == b, a).otherwise((a + b) / 2).alias(out))
    return groups.join(median, keys, "left")


def _narrowed(finite: DataFrame, left: DataFrame, keys: list[str], within: Column, buckets: int) -> DataFrame:
    """The bucket of each group that holds both wanted ranks, with its range; where two buckets share them, the values themselves (``_apart``)."""
    # halves first: a span of the largest doubles is no double
    share = (F.col("_v") / 2 - F.col("_min") / 2) / (F.col("_max") / 2 - F.col("_min") / 2)
    at = F.when(F.col("_v") == F.col("_max"), F.lit(buckets)).otherwise(F.least(F.floor(share * buckets), F.lit(buckets - 1)))
    counted = finite.join(left, keys).where(within).groupBy(*keys, "_lo_rank", "_hi_rank", at.alias("_bucket")).agg(F.count("*").alias("_m"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    above = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = counted.withColumn("_before", F.coalesce(F.sum("_m").over(above), F.lit(0)))
    holds = lambda rank: (F.col("_before") <= F.col(rank)) & (F.col(rank) < F.col("_before") + F.col("_m"))
    lo, hi = b.where(holds("_lo_rank")), b.where(holds("_hi_rank"))
    hi = hi.select(*keys, F.col("_bucket").alias("_next"), F.col("_min").alias("_least"))
    j = lo.join(hi, keys).withColumn("_apart", F.col("_bucket") != F.col("_next"))
    return j.select(*keys, (F.col("_lo_rank") - F.col("_before")).alias("_lo_rank"), (F.col("_hi_rank") - F.col("_before")).alias("_hi_rank"), "_m",
        F.when(F.col("_apart"), F.col("_max")).otherwise(F.col("_min")).alias("_min"), F.when(F.col("_apart"), F.col("_least")).otherwise(F.col("_max")).alias("_max"), "_apart")
