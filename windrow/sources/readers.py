"""Readers of tracks, panels, call tables, regions, annotations, genotype matrices and VCF lines.

All schemas are given, none inferred; text readers take any path or glob that
Spark can read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS = "indiv_ref string, indiv_test string, rank int, chr string, start long, end long, mu double, p double, adjusted_p string, window_size int"
SEGMENTS = "rank int, chr string, start long, end long, mu double, p double, sig string, window_size int"
TRACK = "sample string, contig string, w long, start long, end long, cp double"


def window_track(spark: SparkSession, path: str, window_size: int) -> DataFrame:
    """Window track of one sample or several; the file name's ``<N>_bp`` prefix must equal ``window_size``."""
    size = F.regexp_extract(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"^(\d+)_bp", 1)
    t = spark.read.schema(TRACK).parquet(path)
    named = t.select("*", size.alias("_size"))
    wrong = F.assert_true((F.col("_size") == "") | (F.col("_size") == str(window_size)), F.lit(f"file is not of window size {window_size}"))
    return named.where(wrong.isNull()).drop("_size")


def contig_windows(track: DataFrame, contig: str) -> DataFrame:
    """Window bounds of one contig; prunes to its partition where the track is partitioned by contig."""
    return track.where(F.col("contig") == contig).select("w", "start", "end")


def panel(spark: SparkSession, path: str, contig: str | None = None, samples: list[str] | None = None, kind: str = "wssd") -> DataFrame:
    """Panel written by :func:`windrow.sources.writers.write_panel`, optionally one contig and some samples."""
    p = spark.read.parquet(path).where(F.col("kind") == kind)
    if contig is not None:
        p = p.where(F.col("contig") == contig)
    return p if samples is None else p.where(F.col("sample").isin(samples))


def panel_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row: indivs, wnd_size, wnd_slide."""
    return spark.read.schema("indivs array<string>, wnd_size int, wnd_slide int").json(path, multiLine=True)


def ordered_samples(meta: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """``ordinal, sample`` in the index's order."""
    s = meta.select(F.posexplode("indivs").alias("ordinal", "sample"))
    return s if subset is None else s.where(F.col("sample").isin(subset))


def discovered_samples(a: DataFrame, b: DataFrame) -> DataFrame:
    """Samples that both stores hold."""
    return a.select("sample").distinct().join(b.select("sample").distinct(), "sample", "left_semi")


def stacked(tracks: list[DataFrame], recentre_skip: tuple[str, ...] = ("chrX", "chrY"), kind: str = "wssd") -> DataFrame:
    """Panel of several samples' tracks: recentred but on the contigs to skip."""
    from windrow.operators.tracks import recentred

    whole = tracks[0]
    for t in tracks[1:]:
        whole = whole.unionByName(t)
    return recentred(whole, ["contig", "sample"], F.col("contig").isin(*recentre_skip)).withColumn("kind", F.lit(kind))


def call_table(spark: SparkSession, path: str) -> DataFrame:
    """Merged call table: gzip TSV with header."""
    return spark.read.csv(path, sep="\t", header=True, schema=CALLS)


def segment_tables(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Many per-pair call files as one merged table; test and reference come from ``dCGH_<test>.<ref>.*``."""
    t = spark.read.csv(path, sep="\t", header=False, schema=SEGMENTS).select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("_file"))
    test, ref = (F.regexp_extract("_file", r"^dCGH_([^.]+)\.([^.]+)\.", i) for i in (1, 2))
    return t.select(ref.alias("indiv_ref"), test.alias("indiv_test"), "rank", "chr", "start", "end", "mu", "p", F.col("sig").alias("adjusted_p"), "window_size")


def regions(spark: SparkSession, path: str, contigs: DataFrame | None = None) -> DataFrame:
    """Headerless BED regions, white-space separated, of the supported contigs."""
    f = F.split(F.trim("value"), r"\s+")
    r = spark.read.text(path).where("trim(value) <> ''").select(f[0].alias("contig"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"))
    return r if contigs is None else r.join(contigs.select("contig"), "contig", "left_semi")


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """``contig, length`` of a TSV."""
    return spark.read.csv(path, sep="\t", schema="contig string, length long")


def annotations(spark: SparkSession, path: str, columns: tuple[int, ...] = (0, 1, 2), names: tuple[str, ...] = ("chr", "start", "end")) -> DataFrame:
    """Annotation lines by column position; columns named start or end become numbers."""
    f = F.split("value", "\t")
    cast = {"start": "long", "end": "long"}
    lines = spark.read.text(path).where("value <> '' and not startswith(value, '#')")
    return lines.select(*(f[c].cast(cast.get(n, "string")).alias(n) for c, n in zip(columns, names, strict=True)))


def fetched(intervals: DataFrame, chrom: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Intervals of a contig that overlap [start, end); the bounds are pushed to the scan."""
    out = intervals.where(F.col("chr") == chrom)
    if end is not None:
        out = out.where(F.col("start") < end)
    return out if start is None else out.where(F.col("end") > start)


def genotype_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Long genotypes(contig, start, end, sample, cn) of a matrix TSV; -1 (not assessed) becomes null."""
    wide = spark.read.csv(path, sep="\t", header=True)
    fixed = wide.columns[:3]
    long = wide.unpivot(fixed, wide.columns[3:], "sample", "cn")
    return long.select(F.col(fixed[0]).alias("contig"), F.col(fixed[1]).cast("long").alias("start"), F.col(fixed[2]).cast("long").alias("end"), "sample", _assessed(F.col("cn").cast("int")).alias("cn"))


def _assessed(cn: Column) -> Column:
    return F.when(cn >= 0, cn)


def vcf_lines(spark: SparkSession, path: str) -> DataFrame:
    """VCF lines as ``value``."""
    return spark.read.text(path)


def reference_bases(loci: DataFrame, bases: DataFrame) -> DataFrame:
    """Adds ``ref`` of the base after the start (1-based position); N where unknown."""
    b = bases.select(F.col("contig"), (F.col("pos") - 1).alias("start"), F.col("base").alias("ref"))
    return loci.join(b, ["contig", "start"], "left").withColumn("ref", F.coalesce("ref", F.lit("N")))


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """``width, p, mu`` of a calibration table; its header may stand in any file."""
    lines = spark.read.text(path).where("value <> 'width\tp\tmu'")
    f = F.split("value", "\t")
    return lines.select(f[0].cast("int").alias("width"), f[1].cast("double").alias("p"), f[2].cast("double").alias("mu"))
