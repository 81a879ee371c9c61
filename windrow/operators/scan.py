"""Ordered scans in two levels.

A running value over all rows of a contig would put the contig into one task.
Here rows are cut into tiles of the coordinate axis; a window runs inside
each tile, and what a tile hands on (a maximum, a count) is carried over the
far smaller table of tiles.  Rolling frames of bounded width copy the few
rows at a tile's border into its neighbours instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows aimed at in a tile.
TILE_ROWS = 100_000


def tile_width(df: DataFrame, keys: list[str], position: str, rows: int = TILE_ROWS) -> int:
    """Coordinate width of tiles that hold about ``rows`` rows of the densest key; one small aggregation."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(position) - F.min(position)).alias("span"))
    width = per.agg(F.min(F.floor(F.col("span") * F.lit(float(rows)) / F.col("n")) + 1)).first()[0]
    return max(1, int(width or 1))


def exclusive_max(df: DataFrame, keys: list[str], order: list[str], position: str, value: str, out: str, tile: int | None = None) -> DataFrame:
    """Adds ``out``: the largest ``value`` of the rows before, by ``order`` within ``keys`` (null for the first)."""
    tile = tile or tile_width(df, keys, position)
    t = df.withColumn("_tile", F.floor(F.col(position) / tile))
    inside = Window.partitionBy(*keys, "_tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = t.groupBy(*keys, "_tile").agg(F.max(value).alias("_m")).withColumn("_carry", F.max("_m").over(above)).drop("_m")
    return t.join(carry, [*keys, "_tile"]).withColumn(out, F.greatest(F.max(value).over(inside), "_carry")).drop("_tile", "_carry")


def running_count(df: DataFrame, keys: list[str], order: list[str], position: str, flag: Column, out: str, tile: int | None = None) -> DataFrame:
    """Adds ``out``: how many rows so far, the row itself included, have ``flag``."""
    tile = tile or tile_width(df, keys, position)
    t = df.withColumn("_tile", F.floor(F.col(position) / tile)).withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("long"))
    inside = Window.partitionBy(*keys, "_tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = t.groupBy(*keys, "_tile").agg(F.sum("_flag").alias("_n")).withColumn("_carry", F.coalesce(F.sum("_n").over(above), F.lit(0))).drop("_n")
    return t.join(carry, [*keys, "_tile"]).withColumn(out, F.sum("_flag").over(inside) + F.col("_carry")).drop("_tile", "_carry", "_flag")


def lagged(df: DataFrame, keys: list[str], order: list[str], position: str, value: str, out: str, tile: int | None = None) -> DataFrame:
    """Adds ``out``: the ``value`` of the row before, by ``order`` within ``keys``, null if that is null or there is no such row."""
    tile = tile or tile_width(df, keys, position)
    t = df.withColumn("_tile", F.floor(F.col(position) / tile))
    inside = Window.partitionBy(*keys, "_tile").orderBy(*order)
    above = Window.partitionBy(*keys).orderBy("_tile")
    # structs tell a row with a null value from no row
    held = F.struct(F.col(value).alias("v"))
    carry = t.groupBy(*keys, "_tile").agg(F.max_by(held, F.struct(*order)).alias("_last")).withColumn("_carry", F.lag("_last").over(above)).drop("_last")
    return t.join(carry, [*keys, "_tile"]).withColumn(out, F.coalesce(F.lag(held).over(inside), "_carry")["v"]).drop("_tile", "_carry")


def key_rank(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``: the 0-based rank of each row of a stored ``df`` within ``keys`` by ``order``; no task sorts a whole key."""
    r = ranked(df, [*keys, *order], df.count(), out)
    first = r.groupBy(*keys).agg(F.min(out).alias("_first"))
    return r.join(first, keys).withColumn(out, F.col(out) - F.col("_first")).drop("_first")


def neighbours(df: DataFrame, keys: list[str], position: str, value: str, tile: int | None = None) -> DataFrame:
    """Adds ``_before`` and ``_after``: (position, value) of the nearest row on either side whose ``value`` is not null."""
    tile = tile or tile_width(df, keys, position)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("at"), F.col(value).alias("v")))
    t = df.withColumn("_tile", F.floor(F.col(position) / tile)).withColumn("_known", known)
    inside, tiles = Window.partitionBy(*keys, "_tile").orderBy(position), Window.partitionBy(*keys).orderBy("_tile")
    ends = t.groupBy(*keys, "_tile").agg(F.min("_known").alias("_lo"), F.max("_known").alias("_hi"))
    back, ahead = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    ends = ends.select(*keys, "_tile", F.last("_hi", ignorenulls=True).over(tiles.rowsBetween(*back)).alias("_hi"), F.first("_lo", ignorenulls=True).over(tiles.rowsBetween(*ahead)).alias("_lo"))
    j = t.join(ends, [*keys, "_tile"])
    j = j.withColumn("_before", F.coalesce(F.last("_known", ignorenulls=True).over(inside.rowsBetween(*back)), "_hi"))
    j = j.withColumn("_after", F.coalesce(F.first("_known", ignorenulls=True).over(inside.rowsBetween(*ahead)), "_lo"))
    return j.drop("_tile", "_known", "_lo", "_hi")


#: Buckets of a global order, and rows of the sample that bounds them.
BUCKETS, BOUND_ROWS = 64, 20_000


def ordered_buckets(df: DataFrame, order: list[str], total: int) -> DataFrame:
    """Adds ``_b``: buckets of about equal size in which ``df``, of ``total`` rows, follows ``order`` (no nulls there).

    The bounds are rows of a sample by hash, so they are the same whenever the
    plan is run, and rows of one value are split if later columns differ.
    """
    share = max(1, total // BOUND_ROWS)
    drawn = df.where(F.pmod(F.xxhash64(*order), F.lit(share)) == 0).select(*order).limit(4 * BOUND_ROWS).collect()
    rows = sorted(tuple(r) for r in drawn)
    bounds = sorted({rows[i * len(rows) // BUCKETS] for i in range(1, BUCKETS)}) if rows else []
    types = {f.name: f.dataType for f in df.select(*order).schema}
    bucket = F.lit(0)
    for b in bounds:
        at_or_after = F.struct(*order) >= F.struct(*(F.lit(x).cast(types[c]).alias(c) for c, x in zip(order, b, strict=True)))
        bucket = bucket + at_or_after.cast("int")
    return df.withColumn("_b", bucket)


def ranked(df: DataFrame, order: list[str], total: int, out: str) -> DataFrame:
    """Adds ``out``: the 0-based rank of each row in the global ``order``, by counts of its buckets; no task sorts the whole table."""
    b = ordered_buckets(df, order, total)
    above = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = b.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_carry", F.coalesce(F.sum("_n").over(above), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_b").orderBy(*order)
    return b.join(F.broadcast(carry), "_b").withColumn(out, F.row_number().over(inside) - 1 + F.col("_carry")).drop("_b", "_carry")  # BUCKETS rows


def with_halo(df: DataFrame, position: str, before: int, after: int, tile: int) -> DataFrame:
    """Rows in their tile (``_core`` true) and in neighbours whose rows look at them: ``before`` positions back, ``after`` ahead."""
    p = F.col(position)
    span = F.sequence(F.floor((p - after) / tile), F.floor((p + before) / tile))
    return df.withColumn("_tile", F.explode(span)).withColumn("_core", F.floor(p / tile) == F.col("_tile"))
