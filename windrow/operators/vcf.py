"""Genotype encoding in VCF terms, and filtering of VCF lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = -1000.0


def haplotypes() -> Column:
    """Haplotype copy numbers of a locus with sorted distinct ``cns``: the reference 1, 0 if 0 or 1 occurs, then 2 up to half the largest."""
    top = F.ceil(F.array_max("cns") / 2).cast("int")
    low = F.when(F.array_contains("cns", 0) | F.array_contains("cns", 1), F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1)))
    return F.concat(low, F.when(F.array_max("cns") > 2, F.sequence(F.lit(2), top)).otherwise(F.array().cast("array<int>")))


def alternatives() -> Column:
    return F.array_join(F.transform(F.filter("haps", lambda h: h != 1), lambda h: F.concat(F.lit("<CN"), h.cast("string"), F.lit(">"))), ",")


def sv_type(alt: Column) -> Column:
    return F.when(alt == "<CN2>", "DUP").when(alt == "<CN0>", "DEL").otherwise("CNV")


#: Genotype pairs j <= k over allele numbers in VCF order (index k (k + 1) / 2 + j), with their copy number.
PAIRS = "flatten(transform(sequence(0, size(haps) - 1), k -> transform(sequence(0, k), j -> struct(j AS j, k AS k, haps[j] + haps[k] AS cn))))"
#: The same pairs by first allele, in which the first of a copy number names its genotype.
BY_FIRST = "flatten(transform(sequence(0, size(haps) - 1), j -> transform(sequence(j, size(haps) - 1), k -> struct(j AS j, k AS k, haps[j] + haps[k] AS cn))))"


def encoded(genotypes: DataFrame) -> DataFrame:
    """One row per locus and sample: ``alt, svtype, gt, cn, gl, pl, cnl`` from genotypes(locus, sample, cn, lls).

    ``lls`` maps each copy number seen at the locus to the sample's log10
    likelihood.  A null ``cn`` is a sample that was not assessed; copy
    numbers that no pair of haplotypes makes have no genotype.
    """
    seen = genotypes.groupBy("locus").agg(F.array_sort(F.collect_set("cn")).alias("cns")).withColumn("haps", haplotypes())
    seen = seen.withColumn("pairs", F.expr(PAIRS)).withColumn("by_first", F.expr(BY_FIRST)).withColumn("alt", alternatives())
    j = genotypes.join(seen, "locus")
    first = F.element_at(F.filter("by_first", lambda p: p["cn"] == F.col("cn")), 1)
    like = F.expr(f"transform(pairs, p -> if(array_contains(cns, p.cn), lls[p.cn] - log10(size(filter(pairs, q -> q.cn = p.cn))), {FLOOR}D))")
    e = j.withColumn("gls", like)
    pl = F.transform("gls", lambda g: F.when(g == FLOOR, 1000).otherwise(F.round(-10 * g).cast("int")))
    cnl = F.expr(f"transform(sequence(0, array_max(cns)), c -> if(array_contains(cns, c), lls[c], {FLOOR}D))")

    def two(c):
        return F.array_join(F.transform(c, lambda x: F.format_string("%.2f", F.round(x, 2))), ",")

    none = F.col("cn").isNull()
    return e.select(
        "locus", "sample", "alt", sv_type(F.col("alt")).alias("svtype"),
        F.when(none, "./.").otherwise(F.concat_ws("/", first["j"].cast("string"), first["k"].cast("string"))).alias("gt"),
        F.coalesce("cn", F.lit(0)).alias("cn"),
        F.when(none, "0").otherwise(two("gls")).alias("gl"),
        F.when(none, "0").otherwise(F.array_join(pl.cast("array<string>"), ",")).alias("pl"),
        F.when(none, "0").otherwise(two(cnl)).alias("cnl"),
    )


def filtered_lines(lines: DataFrame, cutoffs: dict[str, float]) -> DataFrame:
    """VCF lines whose LPROBS reaches the cut-off of their SVTYPE; header lines pass, and so do types without one.

    Stateless, so it runs unchanged on a stream of lines (``value``).
    """
    info = F.str_to_map(F.element_at(F.split("value", "\t"), 8), F.lit(";"), F.lit("="))
    limit = F.lit(None).cast("double")
    for kind, least in cutoffs.items():
        limit = F.when(info["SVTYPE"] == kind, F.lit(float(least))).otherwise(limit)
    return lines.where(F.startswith("value", F.lit("#")) | limit.isNull() | (info["LPROBS"].cast("double") >= limit))
