"""Interval tables stored by hierarchical bins, and fetches that read only the bins which they touch.

Level l has bins of ``width * fan ** l`` units; an interval lies in the bin of
the lowest level that holds it whole, or in the contig's last level, one bin
for all that no level holds.  The table is partitioned by contig, level and
bin, rows of a bin in order of start, so a fetch opens the few folders that
its requests touch and skips row groups within them.  An interval is stored
once, and meets a request in one bin, so a pair comes once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bins of a fetch whose names are put into the scan's filter; beyond that the join alone selects.
MAX_BINS = 10_000
_LAYOUT = "width long, fan int, levels int, schema string"


def _last(start: str, end: str) -> Column:
    """Last unit of a half-open interval; that of an empty one is its start."""
    return F.greatest(F.col(end) - 1, F.col(start))


def _bin(of: Column, width: int, fan: int, level: int) -> Column:
    return F.floor(of / F.lit(width * fan**level)).cast("long")


def with_bins(intervals: DataFrame, width: int, fan: int, levels: int) -> DataFrame:
    """Adds ``level`` and ``bin`` to ``intervals(chr, start, end, ...)``."""
    level, at = F.lit(levels), F.lit(0).cast("long")
    for i in reversed(range(levels)):
        first, last = _bin(F.col("start"), width, fan, i), _bin(_last("start", "end"), width, fan, i)
        level, at = F.when(first == last, F.lit(i)).otherwise(level), F.when(first == last, first).otherwise(at)
    return intervals.withColumn("level", level).withColumn("bin", at)


def write_binned(intervals: DataFrame, path: str, width: int, fan: int = 8, levels: int = 3) -> None:
    """Store ``intervals(chr, start, end, ...)`` below ``path`` in bins.

    Range partitions by contig, level, bin and start: a full bin is written by
    several tasks, a task writes neighbouring bins.  Columns may not be named
    ``level`` or ``bin``; rows with a null in chr, start or end are refused.
    """
    if {"level", "bin"} & set(intervals.columns):
        raise ValueError("level and bin name the stored bins")
    for c in ("chr", "start", "end"):
        intervals = intervals.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null"))).otherwise(F.col(c)))
    binned = with_bins(intervals, width, fan, levels)
    order = ["chr", "level", "bin", "start"]
    binned.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("chr", "level", "bin").parquet(f"{path}/intervals")
    layout = intervals.sparkSession.createDataFrame([(width, fan, levels, binned.schema.json())], _LAYOUT)
    layout.coalesce(1).write.mode("overwrite").json(f"{path}/layout")


def binned(spark: SparkSession, path: str) -> tuple[DataFrame, int, int, int]:
    """The stored table with its bins, and its width, fan and levels."""
    import json

    r = spark.read.schema(_LAYOUT).json(f"{path}/layout").first()
    schema = StructType.fromJson(json.loads(r["schema"]))
    return spark.read.schema(schema).parquet(f"{path}/intervals"), r["width"], r["fan"], r["levels"]


def _touched(requests: DataFrame, width: int, fan: int, levels: int) -> DataFrame:
    """Every request with each bin of each level that may hold an interval overlapping it."""

    def of_level(i: int) -> Column:
        bins = F.sequence(_bin(F.col("r_start"), width, fan, i), _bin(_last("r_start", "r_end"), width, fan, i))
        return F.transform(bins, lambda b: F.struct(F.lit(i).alias("level"), b.alias("bin")))

    whole = F.array(F.struct(F.lit(levels).alias("level"), F.lit(0).cast("long").alias("bin")))
    return requests.withColumn("_at", F.explode(F.concat(*map(of_level, range(levels)), whole))).select(*requests.columns, "_at.level", "_at.bin")


def fetched(spark: SparkSession, path: str, requests: DataFrame, max_bins: int = MAX_BINS) -> DataFrame:
    """Stored intervals that strictly overlap each of ``requests(chr, r_start, r_end, ...)``: a row a pair, with the columns of both.

    Empty requests and stored intervals of no length overlap what holds their
    place inside.  Requests on contigs that are not stored give nothing.
    """
    at, table = _opened(spark, path, requests, max_bins)
    hit = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    return at.join(table, ["chr", "level", "bin"]).where(hit).drop("level", "bin")


def _opened(spark: SparkSession, path: str, requests: DataFrame, max_bins: int) -> tuple[DataFrame, DataFrame]:
    """Every request with each bin that it touches, and the stored table, cut to those bins if they are at most ``max_bins``."""
    table, width, fan, levels = binned(spark, path)
    at = _touched(requests, width, fan, levels)
    names = at.select("chr", "level", "bin").distinct().limit(max_bins + 1).collect()
    if len(names) <= max_bins:
        per: dict[tuple[str, int], list[int]] = {}
        for r in names:
            per.setdefault((r["chr"], r["level"]), []).append(r["bin"])
        wanted = [(F.col("chr") == c) & (F.col("level") == level) & F.col("bin").isin(sorted(b)) for (c, level), b in per.items()]
        table = table.where(reduce(Column.__or__, wanted) if wanted else F.lit(False))
    return at, table


def fetched_sums(spark: SparkSession, path: str, requests: DataFrame, value: str, max_bins: int = MAX_BINS) -> DataFrame:
    """``chr, r_start, r_end, n, total``: how many stored intervals :func:`fetched` pairs each distinct request with, and the sum of their ``value``.

    No pairs are made: of a bin's intervals those that start before the
    request's end, without those that end by its start, come from running
    sums over the bin's starts, ends and requests in order, so the work grows
    with rows and not with their pairs.  Requests without a pair give no row;
    only requests of no length go by :func:`fetched`, and values may not be null.
    """
    key = ["chr", "r_start", "r_end"]
    requests = requests.select(*key).distinct()
    at, table = _opened(spark, path, requests.where("r_start < r_end"), max_bins)
    place = ["chr", "level", "bin"]
    # at one place: ends (0) count for requests' starts (1); requests' ends (2) come before starts (3)
    none, v = F.lit(None).cast("long"), F.col(value).cast("long")

    def mark(pos: str, kind: int) -> Column:
        return F.struct(F.col(pos).alias("pos"), F.lit(kind).alias("kind"))

    rows = table.withColumn("_m", F.explode(F.array(mark("end", 0), mark("start", 3)))).select(*place, "_m.*", v.alias("v"), none.alias("r_start"), none.alias("r_end"))
    asked = at.withColumn("_m", F.explode(F.array(mark("r_start", 1), mark("r_end", 2)))).select(*place, "_m.*", none.alias("v"), "r_start", "r_end")
    w = Window.partitionBy(*place).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = F.col("v").isNotNull()
    begun, ended = of & (F.col("kind") == 3), of & (F.col("kind") == 0)
    run = rows.unionByName(asked).select(
        "chr", "kind", "r_start", "r_end",
        *(F.coalesce(F.sum(F.when(flag, what)).over(w), F.lit(0)).alias(name) for name, flag, what in (("nb", begun, F.lit(1)), ("vb", begun, F.col("v")), ("ne", ended, F.lit(1)), ("ve", ended, F.col("v")))),
    )
    ends = F.col("kind") == 2
    sums = run.where("kind IN (1, 2)").groupBy(*key).agg(F.sum(F.when(ends, F.col("nb")).otherwise(-F.col("ne"))).alias("n"), F.sum(F.when(ends, F.col("vb")).otherwise(-F.col("ve"))).alias("total")).where("n > 0")
    empty = fetched(spark, path, requests.where("r_start >= r_end"), max_bins).groupBy(*key).agg(F.count("*").alias("n"), F.sum(v).alias("total"))
    return sums.unionByName(empty)
