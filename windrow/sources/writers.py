"""Line formats and writers of calls, clusters, genotypes, VCF, panels and statistics.

Functions named ``*_lines`` give a DataFrame of text lines with the order to
write them in; :func:`write_text` puts them into text files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.operators import vcf

#: Colours of copy numbers 0 to 10 on a browser track.
COLOURS = ("229,229,229", "196,196,196", "0,0,0", "0,0,205", "65,105,225", "100,149,237", "180,238,180", "255,255,0", "255,165,0", "139,26,26", "255,0,0")


def write_panel(panel: DataFrame, path: str) -> None:
    """Panel as Parquet by kind and contig, sorted within files so that start bounds prune."""
    # by range, so that a contig with a third of all rows is many tasks and files
    panel.repartitionByRange("kind", "contig", "w").sortWithinPartitions("kind", "contig", "w").write.mode("overwrite").partitionBy("kind", "contig").parquet(path)


def write_panel_meta(panel: DataFrame, path: str, wnd_size: int, wnd_slide: int) -> None:
    """One JSON row of sample names, window size and slide."""
    names = panel.agg(F.array_sort(F.collect_set("sample")).alias("indivs"))
    names.select("indivs", F.lit(wnd_size).alias("wnd_size"), F.lit(wnd_slide).alias("wnd_slide")).coalesce(1).write.mode("overwrite").json(path)


def segment_lines(calls: DataFrame) -> DataFrame:
    """Caller's TSV lines in order of p: rank, contig, bounds, value, p, significance flag, width."""
    flag = F.when(F.col("significant"), "*").otherwise("-")
    line = F.format_string("%d\t%s\t%d\t%d\t%f\t%.8e\t%s\t%d", "rank", "chr", "start", "end", "mu", "p", flag, "window_size")
    return calls.select(F.struct("p", "rank").alias("order"), line.alias("value"))


def call_bed_lines(calls: DataFrame, name: str) -> DataFrame:
    """BED lines named ln(p)_ref with the value as score, below a track line."""
    label = F.concat_ws("_", F.format_string("%.4f", F.log("p")), "indiv_ref")
    body = calls.select(F.struct(F.lit(1).alias("a"), "chr", "start", "end").alias("order"), F.concat_ws("\t", "chr", F.col("start").cast("string"), F.col("end").cast("string"), label, F.format_string("%.4f", "mu")).alias("value"))
    head = calls.sparkSession.range(1).select(F.struct(F.lit(0).alias("a"), F.lit("").alias("chr"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")).alias("order"), F.lit(f'track name="{name}"').alias("value"))
    return head.unionByName(body)


def cluster_colour(key: Column) -> Column:
    """A colour that depends on the cluster only."""
    h = F.crc32(key.cast("string").cast("binary"))
    return F.concat_ws(",", *(((F.shiftright(h, s)) % 256).cast("string") for s in (0, 8, 16)))


def cluster_bed_lines(clustered: DataFrame) -> DataFrame:
    """BED9 lines of calls, coloured by cluster."""
    key = F.concat_ws("-", "chr", F.col("cluster_no").cast("string"))
    s, e = F.col("start").cast("string"), F.col("end").cast("string")
    line = F.concat_ws("\t", "chr", s, e, key, F.lit("0"), F.lit("+"), s, e, cluster_colour(key))
    return clustered.select(F.struct("chr", "start", "end", "call_id").alias("order"), line.alias("value"))


def bed_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Tab-separated lines of the columns (contig, start, end and any others), ordered by the first three."""
    return rows.select(F.struct(*columns[:3]).alias("order"), F.concat_ws("\t", *(F.col(c).cast("string") for c in columns)).alias("value"))


def cluster_lines(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """A line for each cluster: contig, extent, size, log10 likelihood, references."""
    c = clustered.groupBy(*keys, "cluster_no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.format_string("%.6f", F.sum(F.log10("p"))).alias("ll"), F.array_join(F.array_sort(F.collect_set("indiv_ref")), ",").alias("refs"))
    return bed_lines(c, [keys[-1], "start", "end", "n", "ll", "refs"])


def cluster_element_lines(clustered: DataFrame) -> DataFrame:
    """A line for each call of a cluster: contig, cluster, reference, bounds, value, p."""
    line = F.concat_ws("\t", "chr", F.col("cluster_no").cast("string"), "indiv_ref", F.col("start").cast("string"), F.col("end").cast("string"), F.format_string("%.6f", "mu"), F.format_string("%.8e", "p"))
    return clustered.select(F.struct("chr", "cluster_no", "start", "end", "indiv_ref").alias("order"), line.alias("value"))


def calibration_lines(table: DataFrame) -> DataFrame:
    """Width, p and mean, tab-separated, below a header."""
    body = table.select(F.struct(F.lit(1).alias("a"), "width", "mu").alias("order"), F.format_string("%d\t%f\t%f", "width", "p", "mu").alias("value"))
    head = table.sparkSession.range(1).select(F.struct(F.lit(0).alias("a"), F.lit(0).alias("width"), F.lit(0.0).alias("mu")).alias("order"), F.lit("width\tp\tmu").alias("value"))
    return head.unionByName(body)


def info_lines(records: DataFrame) -> DataFrame:
    """Tab-separated records of loci below a header: contig, start and end, then the other columns in their order; what is unknown is None."""
    fields = ["contig", "start", "end", *(c for c in records.columns if c not in ("contig", "start", "end"))]
    text = lambda f: F.concat_ws(",", F.col(f).cast("array<string>")) if f in lists else F.col(f).cast("string")
    lists = {f.name for f in records.schema if f.dataType.typeName() == "array"}
    body = records.select(F.struct(F.lit(1).alias("a"), "contig", "start").alias("order"), F.concat_ws("\t", *(F.coalesce(text(f), F.lit("None")) for f in fields)).alias("value"))
    head = records.sparkSession.range(1).select(F.struct(F.lit(0).alias("a"), F.lit("").alias("contig"), F.lit(0).cast("long").alias("start")).alias("order"), F.lit("\t".join(fields)).alias("value"))
    return head.unionByName(body)


def resolved_lines(resolved: DataFrame) -> DataFrame:
    """Resolved calls with five proper columns and a header."""
    body = resolved.select(F.struct(F.lit(1).alias("a"), "chr", "start").alias("order"), F.concat_ws("\t", "chr", F.col("start").cast("long").cast("string"), F.col("end").cast("long").cast("string"), F.array_join("called_refs", ","), F.format_string("%.6f", "log_likelihood")).alias("value"))
    head = resolved.sparkSession.range(1).select(F.struct(F.lit(0).alias("a"), F.lit("").alias("chr"), F.lit(0.0).alias("start")).alias("order"), F.lit("contig\tstart\tend\tcalled_refs\tlog_likelihood").alias("value"))
    return head.unionByName(body)


def genotype_matrix(genotypes: DataFrame, samples: list[str]) -> DataFrame:
    """Wide matrix contig, start, end and a column a sample; not assessed is -1."""
    wide = genotypes.groupBy("contig", "start", "end").pivot("sample", samples).agg(F.first("cn"))
    return wide.select("contig", "start", "end", *(F.coalesce(F.col(f"`{s}`"), F.lit(-1)).alias(s) for s in samples))


def value_matrix(values: DataFrame, keys: list[str], samples: list[str], value: str) -> DataFrame:
    """Wide matrix of a value with a column a sample."""
    wide = values.groupBy(*keys).pivot("sample", samples).agg(F.first(value))
    return wide.select(*keys, *(F.col(f"`{s}`") for s in samples))


def vcf_text_lines(genotypes: DataFrame, loci: DataFrame, samples: list[str]) -> DataFrame:
    """VCF text: meta lines, header, and a line for each locus.

    ``genotypes`` as :func:`windrow.operators.vcf.encoded` takes them;
    ``loci(locus, contig, start, end, ref, lprobs)``.
    """
    e = vcf.encoded(genotypes)
    cell = F.concat_ws(":", "gt", F.col("cn").cast("string"), "gl", "pl", "cnl")
    per = e.groupBy("locus", "alt", "svtype").agg(F.map_from_entries(F.collect_list(F.struct("sample", cell))).alias("cells"))
    j = per.join(loci, "locus")
    chrom = F.regexp_replace("contig", "^chr", "")
    pos = (F.col("start") + 1).cast("string")
    info = F.format_string("END=%d;SVTYPE=%s;LPROBS=%.2f", "end", "svtype", "lprobs")
    cells = [F.coalesce(F.element_at("cells", F.lit(s)), F.lit("./.:0:0:0:0")) for s in samples]
    ident = F.concat_ws("_", "contig", pos, F.col("end").cast("string"))
    body = j.select(F.struct(F.lit(1).alias("a"), "contig", "start").alias("order"), F.concat_ws("\t", chrom, pos, ident, "ref", "alt", F.lit("."), F.lit("PASS"), info, F.lit("GT:CN:GL:PL:CNL"), *cells).alias("value"))
    meta = ["##fileformat=VCFv4.1", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    head = genotypes.sparkSession.createDataFrame([(i, m) for i, m in enumerate(meta)], "i long, value string").select(F.struct(F.lit(0).alias("a"), F.lit("").alias("contig"), F.col("i").alias("start")).alias("order"), "value")
    return head.unionByName(body)


def browser_lines(bands: DataFrame) -> DataFrame:
    """BED9 lines of run-length bands, coloured by copy number."""
    colours = F.array(*map(F.lit, COLOURS))
    s, e = F.col("start").cast("string"), F.col("end").cast("string")
    line = F.concat_ws("\t", "contig", s, e, F.col("cn").cast("string"), F.lit("1000"), F.lit("+"), s, e, F.element_at(colours, F.col("cn") + 1))
    return bands.select(F.struct("contig", "start").alias("order"), line.alias("value"))


def contrast_lines(runs: DataFrame) -> DataFrame:
    """BED lines of group contrasts with both means."""
    line = F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), F.format_string("%f", "mean1"), F.format_string("%f", "mean2"))
    return runs.select(F.struct("contig", "start").alias("order"), line.alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    """Lines in order as text files: a global sort by range, so files in name order are the whole."""
    lines.orderBy("order").select("value").write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)
