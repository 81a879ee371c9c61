"""Views that project the driver's tables onto the domain schemas, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width of a window in coordinate units, and the month number of the first.
WIDTH, FIRST_MONTH = 500, 23_940


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _w():
    return (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1 - FIRST_MONTH).cast("long")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel(contig, sample, w, start, end, cp)."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_shipdate", "l_quantity")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    cells = lines.join(supp, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_returnflag").alias("contig"), F.col("s_nationkey").cast("string").alias("sample"), _w().alias("w"))
    return with_coordinates(cells.agg((F.sum("l_quantity") / (F.lit(12.5) * F.count("*"))).alias("cp")))


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense track(contig, w, start, end, cp)."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_quantity")
    return with_coordinates(lines.groupBy(F.col("l_returnflag").alias("contig"), _w().alias("w")).agg((F.sum("l_quantity") / (F.lit(12.5) * F.count("*"))).alias("cp")))


def with_coordinates(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("w") * WIDTH).withColumn("end", F.col("w") * WIDTH + WIDTH)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window axis(contig, w, start, end).

    A lookup reads the axis several times; it is a row for each window, kept
    so that the panel behind it is aggregated once.
    """
    return kept(with_coordinates(panel(spark, sf_dir).select("contig", "w").distinct()))


#: Frames that queries of a session keep, the oldest first.
_KEPT: list[DataFrame] = []


def kept(df: DataFrame, most: int = 4) -> DataFrame:
    """``df`` persisted; of a session's persisted frames the ``most`` latest stay, an older one is computed anew if it is read again."""
    _KEPT.append(df.persist())
    while len(_KEPT) > most:
        _KEPT.pop(0).unpersist()
    return df


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calls(call_id, chr, indiv_ref, start, end, mu, p, window_size)."""
    return calls_of(table(spark, sf_dir, "events"))


def calls_of(e: DataFrame) -> DataFrame:
    """Calls of a table or stream of events."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    hundredths = F.round(F.col("value") * 100).cast("long")
    return e.select(
        F.col("event_id").alias("call_id"),
        F.col("event_type").alias("chr"),
        F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("indiv_ref"),
        t.alias("start"),
        (t + F.lit(300_000_000) * (1 + F.col("event_id") % 4)).alias("end"),
        ((hundredths - 5000).cast("double") / F.lit(5000.0)).alias("mu"),
        F.pow(F.lit(10.0), -F.col("value") / 20).alias("p"),
        (1 + F.col("event_id") % 7).cast("int").alias("window_size"),
    )


def excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 97th call widened by ten minutes, as exclusion intervals(chr, start, end)."""
    c = calls(spark, sf_dir).where("call_id % 97 = 0")
    return c.select("chr", (F.col("start") - 600_000_000).alias("start"), (F.col("end") + 600_000_000).alias("end"))


def dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of value above 100 as (not yet collapsed) duplications(chr, start, end)."""
    return calls(spark, sf_dir).where("mu > 1.0").select("chr", "start", "end")


#: Regions: single windows, boundaries, stretches, beyond the end, and empty ones.
REGIONS = tuple(
    [(c, w * WIDTH, w * WIDTH + WIDTH) for c in "ANR" for w in (3, 40)]
    + [(c, 7 + 2600 * k, 7 + 2600 * k + 700 * (k + 1)) for c in "ANR" for k in range(6)]
    + [(c, 12_500 + 5 * k, 12_500 + 5 * k) for c in "ANR" for k in range(2)]
    + [(c, 41_000, 60_000) for c in "ANR"]
    + [(c, 20_125, 20_150) for c in "ANR"]
    + [("A", 0, 100), ("N", 0, 41_500), ("R", 1_000, 1_001), ("A", 39_999, 40_001)]
)


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(REGIONS)], "region_id long, contig string, start long, end long")


_W = f"CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 - {FIRST_MONTH} AS BIGINT)"
PANEL = f"""panel AS (
  SELECT *, w * {WIDTH} AS start, w * {WIDTH} + {WIDTH} AS "end" FROM (
    SELECT l_returnflag AS contig, CAST(s_nationkey AS VARCHAR) AS sample, {_W} AS w, CAST(SUM(l_quantity) AS DOUBLE) / (12.5 * COUNT(*)) AS cp
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3))"""
TRACK = f"""track AS (
  SELECT *, w * {WIDTH} AS start, w * {WIDTH} + {WIDTH} AS "end" FROM (
    SELECT l_returnflag AS contig, {_W} AS w, CAST(SUM(l_quantity) AS DOUBLE) / (12.5 * COUNT(*)) AS cp FROM lineitem GROUP BY 1, 2))"""
WINDOWS = f"""windows AS (SELECT DISTINCT contig, w, start, "end" FROM panel)"""
CALLS = """calls AS (
  SELECT event_id AS call_id, event_type AS chr, 's' || CAST(user_id % 10 AS VARCHAR) AS indiv_ref, t AS start, t + 300000000 * (1 + event_id % 4) AS "end",
         CAST(CAST(round(value * 100) AS BIGINT) - 5000 AS DOUBLE) / CAST(5000 AS DOUBLE) AS mu, power(CAST(10 AS DOUBLE), -value / 20) AS p, CAST(1 + event_id % 7 AS INT) AS window_size
  FROM (SELECT *, epoch_us(ts) AS t FROM events))"""
EXCLUDES = """excludes AS (SELECT chr, start - 600000000 AS start, "end" + 600000000 AS "end" FROM calls WHERE call_id % 97 = 0)"""
DUPS = """dups AS (SELECT chr, start, "end" FROM calls WHERE mu > 1.0)"""
REGION_VALUES = "regions(region_id, contig, start, \"end\") AS (SELECT CAST(a AS BIGINT), b, CAST(c AS BIGINT), CAST(d AS BIGINT) FROM (VALUES " + ", ".join(f"({i}, '{c}', {s}, {e})" for i, (c, s, e) in enumerate(REGIONS)) + ") v(a, b, c, d))"


def sql(*ctes: str, select: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + select
