"""Queries on genotypes, contrasts and encodings with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from windrow.operators import genotype as gt
from windrow.operators import intervals as iv
from windrow.operators import nullmodel as nm
from windrow.operators import vcf
from windrow.plans import views as v
from windrow.sources.scratch import written
from windrow.plans.queries_tracks import _BASE, _GT, r6

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


_CELLS = f"""
cells AS (SELECT s.region_id AS locus, p.sample, p.w, p.cp FROM (SELECT *, CASE WHEN b <= a THEN a + 1 ELSE b END AS e FROM ss) s JOIN panel p ON p.contig = s.contig AND {_GT}),
obs AS (SELECT *, CAST(floor(mu * 4) AS INT) AS label FROM (SELECT locus, sample, round(avg(cp), 6) AS mu FROM cells GROUP BY 1, 2)),
stats AS (SELECT locus, label, round(avg(mu), 9) AS mean, stddev_pop(mu) AS sd, count(*) AS n FROM obs GROUP BY 1, 2)""".strip()
_OBS = (*_BASE, _CELLS)


def cells(spark, d):
    return iv.slice_join(iv.slices(v.regions(spark), v.windows(spark, d), "genotyper"), v.panel(spark, d)).select(F.col("region_id").alias("locus"), "sample", "w", "cp")


def obs(spark, d, of=None):
    return (of if of is not None else cells(spark, d)).groupBy("locus", "sample").agg(F.round(F.avg("cp"), 6).alias("mu")).withColumn("label", F.floor(F.col("mu") * 4).cast("int"))


def stats(o):
    return gt.label_stats(o).withColumn("mean", F.round("mean", 9))


@query("label_stats", v.sql(*_OBS, select="SELECT locus, label, CAST(round(mean * n * 1e6) AS BIGINT) AS sum_micro, CASE WHEN n > 2 THEN round(sd, 6) END AS sd, n FROM stats"))
def label_stats(spark, d):
    return stats(obs(spark, d)).select("locus", "label", F.round(F.col("mean") * F.col("n") * 1e6).cast("long").alias("sum_micro"), F.when(F.col("n") > 2, F.round("sd", 6)).alias("sd"), "n")


_CN = """
rk AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY mean, label) - 1 AS r FROM stats),
nr AS (SELECT *, first_value(r) OVER (PARTITION BY locus ORDER BY abs(mean - 2), r) AS nr, min(abs(mean - 2)) OVER (PARTITION BY locus) AS nd, first_value(round(mean)) OVER (PARTITION BY locus ORDER BY r) AS lo FROM rk),
c0 AS (SELECT *, CAST(CASE WHEN nd < 1 THEN 2 - (nr - r) ELSE lo + r END AS BIGINT) AS c FROM nr),
c1 AS (SELECT * EXCLUDE (c), c + greatest(0, -min(c) OVER (PARTITION BY locus)) AS c FROM c0),
md AS (SELECT locus, first(c ORDER BY n DESC, label) AS mc, first(mean ORDER BY n DESC, label) AS mm, max(n) AS mn, sum(n) AS total, min(c) AS low FROM c1 GROUP BY 1),
cn AS (SELECT locus, label, mean, sd, n, CAST(c + CASE WHEN mc % 2 = 1 AND mn >= 0.5 * total THEN CASE WHEN mm - mc > 0 OR low = 0 THEN 1 ELSE -1 END ELSE 0 END AS INT) AS cn FROM c1 JOIN md USING (locus))""".strip()


@query("labels_to_cn", v.sql(*_OBS, _CN, select="SELECT locus, label, n, cn FROM cn"))
def labels_to_cn(spark, d):
    return gt.labels_to_cn(stats(obs(spark, d))).select("locus", "label", "n", "cn")


@query("variable_samples", v.sql(*_OBS, "nl AS (SELECT locus, first(label ORDER BY n DESC, label) AS mode, count(*) AS k FROM stats GROUP BY 1)", select="SELECT locus, sample, k > 2 OR label <> mode AS variable FROM obs JOIN nl USING (locus)"))
def variable_samples(spark, d):
    return gt.variable(obs(spark, d)).select("locus", "sample", "variable")


@query("order_proportion", v.sql(*_OBS, "rk AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY mean, label) AS r FROM stats)", "pw AS (SELECT c.locus, c.w, r, min(cp) AS lo, max(cp) AS hi FROM cells c JOIN obs o USING (locus, sample) JOIN rk USING (locus, label) GROUP BY 1, 2, 3)", "nx AS (SELECT *, lead(lo) OVER (PARTITION BY locus, w ORDER BY r) AS nx FROM pw)", "f AS (SELECT locus, count(*) FILTER (hi < nx) / CAST(count(*) AS DOUBLE) AS f FROM nx WHERE nx IS NOT NULL GROUP BY 1)", select="SELECT DISTINCT stats.locus, round(coalesce(f, 0.0), 6) AS f_correct FROM stats LEFT JOIN f ON f.locus = stats.locus"))
def order_proportion(spark, d):
    c = cells(spark, d)
    o = obs(spark, d, c)
    return gt.order_proportion(c.join(o.select("locus", "sample", "label"), ["locus", "sample"]), stats(o)).select("locus", r6(F.col("f_correct"), "f_correct"))


_DIST = """
dd AS (SELECT *, lead(mean) OVER w - mean AS d, lead(greatest(sd, 1e-9)) OVER w AS nsd FROM stats WINDOW w AS (PARTITION BY locus ORDER BY mean, label)),
dist AS (SELECT locus, count(*) AS n_clusts, coalesce(avg(d), 0) AS mean_d, coalesce(min(d), 0) AS min_d, coalesce(max(d), 0) AS max_d, min(least(d / greatest(sd, 1e-9), d / nsd)) FILTER (d IS NOT NULL) AS min_z, min(n) AS min_count FROM dd GROUP BY 1)""".strip()


@query("min_z_dist", v.sql(*_OBS, _DIST, select="SELECT locus, n_clusts, round(mean_d, 6) AS mean_d, round(min_d, 6) AS min_d, round(max_d, 6) AS max_d, CASE WHEN min_z < 1e6 THEN round(min_z, 4) END AS min_z, min_count FROM dist"))
def min_z_dist(spark, d):
    m = gt.mean_distances(stats(obs(spark, d)))
    return m.select("locus", "n_clusts", *(r6(F.col(c), c) for c in ("mean_d", "min_d", "max_d")), F.when(F.col("min_z") < 1e6, F.round("min_z", 4)).alias("min_z"), "min_count")


@query("inter_label_dist", v.sql(*_OBS, select="SELECT locus, round(coalesce(min(CASE WHEN nl <> label THEN abs(nm - mu) END), 9e9), 6) AS min_inter_label_dist FROM (SELECT *, lead(label) OVER w AS nl, lead(mu) OVER w AS nm FROM obs WINDOW w AS (PARTITION BY locus ORDER BY mu, sample)) GROUP BY 1"))
def inter_label_dist(spark, d):
    return gt.inter_label_distance(obs(spark, d)).select("locus", r6(F.col("min_inter_label_dist"), "min_inter_label_dist"))


_COMP = """
comp AS (SELECT locus, label AS component, mean, greatest(sd * sd, 1e-2) AS var, n / CAST(sum(n) OVER (PARTITION BY locus) AS DOUBLE) AS weight FROM stats),
dens AS (SELECT o.locus, o.sample, o.mu, o.label, c.component, c.weight * exp(-(mu - mean) * (mu - mean) / (2 * var)) / sqrt(2 * pi() * var) AS dens FROM obs o JOIN comp c USING (locus)),
post AS (SELECT *, dens / sum(dens) OVER (PARTITION BY locus, sample) AS post FROM dens)""".strip()


def components(s):
    return s.select("locus", F.col("label").alias("component"), "mean", F.greatest(F.col("sd") * F.col("sd"), F.lit(1e-2)).alias("var"), (F.col("n") / F.sum("n").over(Window.partitionBy("locus"))).alias("weight"))


@query("posteriors", v.sql(*_OBS, _COMP, select="SELECT locus, sample, component, round(post, 6) AS post, CASE WHEN post > 1e-9 THEN round(log10(post), 6) + 0.0 END AS log10_post FROM post"))
def posteriors(spark, d):
    o = obs(spark, d)
    p = gt.posteriors(o, components(stats(o)))
    return p.select("locus", "sample", "component", r6(F.col("post"), "post"), F.when(F.col("post") > 1e-9, F.round("log10_post", 6) + 0.0).alias("log10_post"))


@query("responsibilities", v.sql(*_OBS, _COMP, select="SELECT locus, round(avg(post), 6) AS mean_r, round(min(post), 6) AS min_r, round(sum(ln(post)), 6) AS ll_r FROM post WHERE component = label GROUP BY 1"))
def responsibilities(spark, d):
    o = obs(spark, d)
    own = gt.posteriors(o, components(stats(o))).where("component = label").select("locus", "label", F.col("post").alias("own"))
    return gt.responsibilities(own).select("locus", *(r6(F.col(c), c) for c in ("mean_r", "min_r", "ll_r")))


@query("em_one_step", v.sql(*_OBS, _COMP, "s AS (SELECT locus, component, sum(post) AS w, sum(post * mu) / sum(post) AS mean, sum(post * mu * mu) / sum(post) AS q FROM post GROUP BY 1, 2)", select="SELECT locus, component, round(mean, 6) AS mean, round(greatest(q - mean * mean, 1e-4), 6) AS var, round(w / sum(w) OVER (PARTITION BY locus), 6) AS weight FROM s"))
def em_one_step(spark, d):
    o = obs(spark, d)
    return gt.em_step(o, components(stats(o))).select("locus", "component", *(r6(F.col(c), c) for c in ("mean", "var", "weight")))


_CROSS = """
cx AS (SELECT locus, component, mean AS m1, var AS v1, weight AS w1, lead(mean) OVER w AS m2, lead(var) OVER w AS v2, lead(weight) OVER w AS w2 FROM comp WINDOW w AS (PARTITION BY locus ORDER BY mean, component)),
ca AS (SELECT *, v1 * v2 * (pow(m2 - m1, 2) + k * (v2 - v1)) AS square FROM (SELECT *, 2 * ln(w1 / w2) + ln(v2 / v1) AS k FROM cx WHERE m2 IS NOT NULL)),
cd AS (SELECT *, CASE WHEN v1 = v2 THEN (m1 + m2) / 2 WHEN square >= 0 THEN m1 + v1 * (pow(m2 - m1, 2) + k * v2) / (sqrt(square) + v1 * (m2 - m1)) END AS x FROM ca)""".strip()


@query("gaussian_crossing", v.sql(*_OBS, _COMP, _CROSS, select="SELECT locus, component, round(x, 4) AS x FROM cd"))
def gaussian_crossing(spark, d):
    w = Window.partitionBy("locus").orderBy("mean", "component")
    c = components(stats(obs(spark, d)))
    c = c.withColumns({f"next_{k}": F.lead(k).over(w) for k in ("mean", "var", "weight")}).where("next_mean is not null")
    return gt.crossings(c).select("locus", "component", F.round("x", 4).alias("x"))


_QC = """
mx AS (SELECT locus, avg(mu) AS mean_mu, max(mu) AS max_mu FROM obs GROUP BY 1),
qc AS (SELECT dist.locus, n_clusts = 1 AS one_cluster, max_d < 0.45 AS close, round(mean_mu, 9) > 2.1 AS high_copy, n_clusts = 2 AND min_count = 1 AND coalesce(min_z, 0) < 5 AS weak_singleton, max_mu > 2.5 AND coalesce(min_z, 1e18) < 4 AS weak_dup FROM dist JOIN mx USING (locus))""".strip()


@query("genotype_qc", v.sql(*_OBS, _DIST, _QC, select="SELECT *, one_cluster OR close OR high_copy OR weak_singleton OR weak_dup AS fail FROM qc"))
def genotype_qc(spark, d):
    o = obs(spark, d)
    return gt.quality(stats(o), o, max_mu=2.1, min_max_d=0.45, singleton_sigma=5.0, dup_sigma=4.0).drop("overlapping")


_SEX = (*_OBS, "l AS (SELECT locus, label, count(*) AS n, count(*) FILTER (CAST(sample AS INT) % 2 = 0) AS f, count(*) FILTER (CAST(sample AS INT) % 2 = 1) AS m FROM obs GROUP BY 1, 2)", "r AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY n DESC, label) AS r FROM l)", "sx AS (" + "SELECT locus, coalesce(max(f) FILTER (r = 1), 0) AS f1, coalesce(max(m) FILTER (r = 1), 0) AS m1, coalesce(max(f) FILTER (r = 2), 0) AS f2, coalesce(max(m) FILTER (r = 2), 0) AS m2 FROM r WHERE r <= 2 GROUP BY 1" + ")")


@query("sex_link_counts", v.sql(*_SEX, select="SELECT * FROM sx"))
def sex_link_counts(spark, d):
    return gt.top_labels_by_sex(obs(spark, d), F.when(F.col("sample").cast("int") % 2 == 0, "F").otherwise("M"))


_FISHER = """
fx AS (SELECT *, unnest(range(greatest(0, f1 + m1 + f1 + f2 - n), least(f1 + m1, f1 + f2) + 1)) AS x FROM (SELECT *, f1 + m1 + f2 + m2 AS n FROM sx)),
fl AS (SELECT locus, x = f1 AS own, -(lgamma(x + 1) + lgamma(f1 + m1 - x + 1) + lgamma(f1 + f2 - x + 1) + lgamma(n - f1 - m1 - f1 - f2 + x + 1)) AS l FROM fx),
fo AS (SELECT locus, max(l) FILTER (own) AS o, max(l) AS top FROM fl GROUP BY 1)""".strip()


@query("fisher_p", v.sql(*_SEX, _FISHER, select="SELECT locus, round(sum(exp(l - top)) FILTER (l <= o + 1e-7) / sum(exp(l - top)), 6) AS p FROM fl JOIN fo USING (locus) GROUP BY 1"))
def fisher_p(spark, d):
    c = sex_link_counts(spark, d)
    return c.select("locus", r6(nm.fisher_p("f1", "m1", "f2", "m2"), "p"))


_GENO = """geno AS (SELECT contig, w, start, "end", sample, CAST(least(round(cp), 4) AS INT) AS cn, cp FROM panel)"""


def geno(spark, d):
    return v.panel(spark, d).withColumn("cn", F.least(F.round("cp"), F.lit(4.0)).cast("int"))


@query("gt_vector_groups", v.sql(v.PANEL, _GENO, "vec AS (SELECT contig AS locus, w AS segment, array_to_string(list(sample || ':' || cn ORDER BY sample), ',') AS v, count(*) FILTER (cn <> 2) AS k FROM geno GROUP BY 1, 2)", select="SELECT locus, array_to_string(list_sort(list(segment)), ',') AS members, first(segment ORDER BY k DESC, segment) AS representative, max(k) AS carriers FROM vec GROUP BY locus, v"))
def gt_vector_groups(spark, d):
    g = geno(spark, d).select(F.col("contig").alias("locus"), F.col("w").alias("segment"), "sample", "cn", (F.col("cn") != 2).alias("carrier"))
    return gt.vector_groups(g).select("locus", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "representative", "carriers")


_CAR = """
seg AS (SELECT DISTINCT region_id AS segment, contig, start, "end" FROM regions WHERE start < "end"),
car AS (SELECT DISTINCT s.segment, p.sample FROM seg s JOIN panel p ON p.contig = s.contig AND p.start < s."end" AND s.start < p."end" WHERE p.cp > 2.6),
ov AS (SELECT a.segment, b.segment AS other FROM seg a JOIN seg b ON a.contig = b.contig AND a.segment <> b.segment AND a.start <= b."end" AND b.start <= a."end" AND a."end" <> b.start AND b."end" <> a.start)""".strip()


@query("assess_samples", v.sql(v.PANEL, v.REGION_VALUES, _CAR, select="SELECT s.segment, x.sample FROM (SELECT DISTINCT segment FROM car) s, (SELECT DISTINCT sample FROM panel) x WHERE NOT EXISTS (SELECT 1 FROM ov JOIN car ON car.segment = ov.other WHERE ov.segment = s.segment AND car.sample = x.sample)"))
def assess_samples(spark, d):
    seg = v.regions(spark).where(F.col("start") < F.col("end")).select(F.col("region_id").alias("segment"), "contig", "start", "end")
    p = v.panel(spark, d)
    cellsx = p.where("cp > 2.6").select("contig", "sample", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    carriers = iv.interval_join(seg, cellsx, ["contig"], 10 * v.WIDTH).select("segment", "sample").distinct()
    b = seg.select("contig", F.col("segment").alias("other"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    pairs = seg.join(b, "contig").where(F.col("segment") != F.col("other")).where(iv.overlaps_unless_abutting("start", "end", "b_start", "b_end")).select("segment", "other")
    return gt.samples_to_assess(carriers, pairs, p.select("sample").distinct())


_SETS = """
sg AS (SELECT contig, sample, min(start) AS start, max("end") AS "end" FROM (SELECT *, w - row_number() OVER (PARTITION BY contig, sample ORDER BY w) AS g FROM panel WHERE cp > 2.3) GROUP BY contig, sample, g),
tot AS (SELECT sample, sum("end" - start) AS total FROM sg GROUP BY 1),
oo AS (SELECT a.sample AS a, b.sample AS b, sum(least(a."end", b."end") - greatest(a.start, b.start)) AS o FROM sg a JOIN sg b ON a.contig = b.contig AND a.sample < b.sample AND a.start < b."end" AND b.start < a."end" GROUP BY 1, 2)""".strip()


@query("seg_set_similarity", v.sql(v.PANEL, _SETS, select="SELECT a, b, round(least(o / CAST(x.total AS DOUBLE), o / CAST(y.total AS DOUBLE)), 6) AS similarity FROM oo JOIN tot x ON x.sample = a JOIN tot y ON y.sample = b"))
def seg_set_similarity(spark, d):
    r = iv.runs(v.panel(spark, d).where("cp > 2.3"), ["contig", "sample"])
    s = r.select(F.col("contig").alias("chr"), "sample", (F.col("first") * v.WIDTH).alias("start"), (F.col("last") * v.WIDTH).alias("end"))
    return gt.set_similarity(s).select("a", "b", r6(F.col("similarity"), "similarity"))


_CON = """
gr AS (SELECT *, dense_rank() OVER (ORDER BY CAST(sample AS INT)) AS rk FROM panel),
wn AS (SELECT contig, w, start, "end", min(cp) FILTER (rk <= 2) AS lo1, max(cp) FILTER (rk <= 2) AS hi1, avg(cp) FILTER (rk <= 2) AS m1, min(cp) FILTER (rk IN (3, 4)) AS lo2, max(cp) FILTER (rk IN (3, 4)) AS hi2, avg(cp) FILTER (rk IN (3, 4)) AS m2 FROM gr WHERE rk <= 4 GROUP BY 1, 2, 3, 4),
hit AS (SELECT *, w - row_number() OVER (PARTITION BY contig ORDER BY w) AS g FROM wn WHERE {})""".strip()
_CON_OUT = "SELECT contig, min(start) AS start, max(\"end\") AS \"end\", round(avg(m1), 6) AS mean1, round(avg(m2), 6) AS mean2 FROM hit GROUP BY contig, g"


def _groups(spark, d):
    """Names of the four smallest samples: a cohort's group lists are parameters of the operator."""
    s = [r["sample"] for r in v.table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("sample")).distinct().orderBy(F.col("sample").cast("int")).limit(4).collect()]
    return s[:2], s[2:]


def _contrast(dup):
    def f(spark, d):
        one, two = _groups(spark, d)
        return gt.contrasts(v.panel(spark, d), one, two, 0.25, dup).select("contig", "start", "end", r6(F.col("mean1"), "mean1"), r6(F.col("mean2"), "mean2"))

    return f


query("contrast_dup", v.sql(v.PANEL, _CON.format("lo1 - hi2 > 0.25"), select=_CON_OUT))(_contrast(True))
query("contrast_del", v.sql(v.PANEL, _CON.format("lo2 - hi1 > 0.25"), select=_CON_OUT))(_contrast(False))


@query("uniform_low", v.sql(v.PANEL, "mw AS (SELECT contig, w, start, \"end\", avg(cp) AS m FROM panel GROUP BY 1, 2, 3, 4)", "hit AS (SELECT *, w - row_number() OVER (PARTITION BY contig ORDER BY w) AS g FROM mw WHERE m < 2.0)", select="SELECT contig, min(start) AS start, max(\"end\") AS \"end\", round(avg(m), 6) AS mean1 FROM hit GROUP BY contig, g"))
def uniform_low(spark, d):
    return gt.uniform_windows(v.panel(spark, d), low=2.0).select("contig", "start", "end", r6(F.col("mean1"), "mean1"))


@query("uniform_high", v.sql(v.PANEL, "mw AS (SELECT contig, w, start, \"end\", avg(cp) AS m FROM panel GROUP BY 1, 2, 3, 4)", "hit AS (SELECT *, w - row_number() OVER (PARTITION BY contig ORDER BY w) AS g FROM mw WHERE m > 2.1)", select="SELECT contig, min(start) AS start, max(\"end\") AS \"end\", round(avg(m), 6) AS mean1 FROM hit GROUP BY contig, g"))
def uniform_high(spark, d):
    return gt.uniform_windows(v.panel(spark, d), high=2.1).select("contig", "start", "end", r6(F.col("mean1"), "mean1"))


_COR = """
sm AS (SELECT contig AS locus, w // 10 AS i, sample, avg(cp) AS mu FROM panel GROUP BY 1, 2, 3),
cr AS (SELECT a.locus, a.i, corr(a.mu, b.mu) AS r, avg(a.mu) AS x1, avg(b.mu) AS x2 FROM sm a JOIN sm b ON a.locus = b.locus AND b.i = a.i + 1 AND a.sample = b.sample GROUP BY 1, 2)""".strip()


def _correlation(spark, d):
    m = v.panel(spark, d).groupBy(F.col("contig").alias("locus"), F.floor(F.col("w") / 10).alias("i"), "sample").agg(F.avg("cp").alias("mu"))
    return gt.segment_correlation(m)


@query("segment_correlation", v.sql(v.PANEL, _COR, select="SELECT locus, i, round(r, 6) AS r, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM cr"))
def segment_correlation(spark, d):
    return _correlation(spark, d).select("locus", "i", *(r6(F.col(c), c) for c in ("r", "x1", "x2")))


@query("correlated_merge_round", v.sql(v.PANEL, _COR, "ct AS (SELECT *, least(0.9 / pow(least(x1, x2), 0.6) - 0.6, 0.9) AS cut FROM cr)", select="SELECT locus, i FROM ct WHERE abs(r) >= cut AND locus IN (SELECT locus FROM ct WHERE r > cut)"))
def correlated_merge_round(spark, d):
    # the stand-in segments hardly correlate, so the cut-off parameter is a lower one
    lowered = F.least(F.lit(0.9) / F.pow(F.least("x1", "x2"), F.lit(0.6)) - 0.6, F.lit(0.9))
    return gt.merge_round(_correlation(spark, d), lowered)


_SIMPLE = """
lo AS (SELECT contig || '-' || w AS locus, start, start + 10000 * (1 + w % 9) AS "end", sample, CAST(least(floor(cp), 3) AS INT) AS cn FROM panel),
sl AS (SELECT locus, start, "end", count(*) AS n, count(*) FILTER (cn = 0) AS n0, count(*) FILTER (cn = 1) AS n1 FROM lo GROUP BY 1, 2, 3 HAVING bool_and(cn IN (0, 1, 2)) AND count(DISTINCT cn) > 1)""".strip()


def _loci(spark, d):
    return v.panel(spark, d).select(F.concat_ws("-", "contig", F.col("w").cast("string")).alias("locus"), "start", (F.col("start") + 10_000 * (1 + F.col("w") % 9)).alias("end"), "sample", F.least(F.floor("cp"), F.lit(3)).cast("int").alias("cn"))


@query("simple_gts", v.sql(v.PANEL, _SIMPLE, select="SELECT locus, start, \"end\", n, n0, n1 FROM sl"))
def simple_gts(spark, d):
    return gt.simple_loci(_loci(spark, d))


@query("allele_spectrum", v.sql(v.PANEL, _SIMPLE, "f AS (SELECT (2 * n0 + n1) / (2.0 * n)::DOUBLE AS af, \"end\" - start > 50000 AS long FROM sl)", select="SELECT round(least(af, 1 - af), 9) AS af, count(*) AS n_all, count(*) FILTER (long) AS n_long FROM f GROUP BY 1"))
def allele_spectrum(spark, d):
    s = gt.allele_spectrum(_loci(spark, d))
    return s.groupBy(F.round("af", 9).alias("af")).agg(F.sum("n_all").alias("n_all"), F.sum("n_long").alias("n_long"))


@query("gc_bins", v.sql(v.PANEL, "c AS (SELECT cp, ((w * 37 + 11) % 100) / 100.0::DOUBLE + 0.005 AS gc FROM panel)", "k AS (SELECT CAST(floor(gc * 100) AS BIGINT) AS bin, count(*) FILTER (round_even(cp, 0) = 2) AS n2, count(*) AS n FROM c GROUP BY 1)", select="SELECT b.bin, coalesce(n2, 0) AS n_two, greatest(coalesce(n, 0), 1) AS n, round(coalesce(n2, 0) / CAST(greatest(coalesce(n, 0), 1) AS DOUBLE), 6) AS ratio FROM range(99) b(bin) LEFT JOIN k ON k.bin = b.bin"))
def gc_bins(spark, d):
    c = v.panel(spark, d).select("cp", (F.pmod(F.col("w") * 37 + 11, F.lit(100)) / 100.0 + 0.005).alias("gc"))
    return gt.gc_bins(c).select("bin", "n_two", F.col("n").cast("long").alias("n"), r6(F.col("ratio"), "ratio"))


_LINES = """
vl AS (SELECT contig || chr(9) || (w * 500 + 1) || chr(9) || '.' || chr(9) || 'N' || chr(9) || '<CNV>' || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'END=' || (w * 500 + 500) || ';SVTYPE=' || t || ';LPROBS=' || l AS value, t, l
       FROM (SELECT *, CASE sample_id % 3 WHEN 0 THEN 'DEL' WHEN 1 THEN 'DUP' ELSE 'CNV' END AS t, -(w * sample_id % 50) AS l FROM (SELECT contig, w, CAST(sample AS INT) AS sample_id FROM panel)))""".strip()


@query("vcf_filter", v.sql(v.PANEL, _LINES, select="SELECT value FROM vl WHERE l >= CASE t WHEN 'DEL' THEN -20 WHEN 'DUP' THEN -10 ELSE -1e9 END UNION ALL SELECT '##fileformat=VCFv4.1'"))
def vcf_filter(spark, d):
    s = F.col("sample").cast("int")
    kind = F.when(s % 3 == 0, "DEL").when(s % 3 == 1, "DUP").otherwise("CNV")
    info = F.concat(F.lit("END="), (F.col("w") * 500 + 500).cast("string"), F.lit(";SVTYPE="), kind, F.lit(";LPROBS="), (-(F.col("w") * s % 50)).cast("string"))
    line = F.concat_ws("\t", "contig", (F.col("w") * 500 + 1).cast("string"), F.lit("."), F.lit("N"), F.lit("<CNV>"), F.lit("."), F.lit("PASS"), info)
    # a line names grouping keys only: unless the lines are stored, the filter is moved below the panel's aggregation and parses every row of lineitem
    lines = written(v.panel(spark, d).select(line.alias("value")), "lines").unionByName(spark.createDataFrame([("##fileformat=VCFv4.1",)], "value string"))
    return vcf.filtered_lines(lines, {"DEL": -20.0, "DUP": -10.0})


_VCF = """
g AS (SELECT contig || ':' || w AS locus, sample, cp, CASE WHEN CAST(sample AS INT) % 11 = 10 THEN NULL ELSE CAST(least(round(cp), 4) AS INT) END AS cn FROM panel),
cs AS (SELECT locus, list_sort(list(DISTINCT cn) FILTER (cn IS NOT NULL)) AS cns FROM g GROUP BY 1),
hp AS (SELECT *, list_concat(CASE WHEN list_contains(cns, 0) OR list_contains(cns, 1) THEN [1, 0] ELSE [1] END, CASE WHEN list_max(cns) > 2 THEN CAST(range(2, CAST(ceil(list_max(cns) / 2.0) AS BIGINT) + 1) AS INT[]) ELSE [] END) AS haps FROM cs),
ix AS (SELECT *, array_to_string(list_transform(list_filter(haps, lambda h: h <> 1), lambda h: '<CN' || h || '>'), ',') AS alt FROM hp),
pr AS (SELECT locus, j, k, haps[j + 1] + haps[k + 1] AS pcn FROM ix, range(0, 8) a(j), range(0, 8) b(k) WHERE j <= k AND k < len(haps)),
pc AS (SELECT *, count(*) OVER (PARTITION BY locus, pcn) AS same FROM pr),
gl AS (SELECT g.locus, g.sample, list(CASE WHEN list_contains(ix.cns, pcn) THEN round(-9.87 * (cp - pcn) * (cp - pcn), 2) - log10(same) ELSE -1000 END ORDER BY k, j) AS gls, min(CASE WHEN pcn = g.cn THEN j * 100 + k END) AS best FROM g JOIN ix USING (locus) JOIN pc USING (locus) GROUP BY 1, 2),
o AS (SELECT g.*, ix.cns, ix.alt, gl.gls, gl.best FROM g JOIN ix USING (locus) JOIN gl ON gl.locus = g.locus AND gl.sample = g.sample)""".strip()


@query("vcf_encode", v.sql(v.PANEL, _VCF, select="""SELECT locus, sample, alt, CASE alt WHEN '<CN2>' THEN 'DUP' WHEN '<CN0>' THEN 'DEL' ELSE 'CNV' END AS svtype,
 CASE WHEN cn IS NULL THEN './.' ELSE coalesce((best // 100) || '/' || (best % 100), '') END AS gt, coalesce(cn, 0) AS cn,
 CASE WHEN cn IS NULL THEN '0' ELSE array_to_string(list_transform(gls, lambda x: printf('%.2f', round(x, 2) + 0.0)), ',') END AS gl,
 CASE WHEN cn IS NULL THEN '0' ELSE array_to_string(list_transform(gls, lambda x: CASE WHEN x = -1000 THEN 1000 ELSE CAST(round(-10 * x) AS INT) END), ',') END AS pl,
 CASE WHEN cn IS NULL THEN '0' ELSE array_to_string(list_transform(range(0, list_max(cns) + 1), lambda c: printf('%.2f', round(CASE WHEN list_contains(cns, c) THEN round(-9.87 * (cp - c) * (cp - c), 2) ELSE -1000 END, 2) + 0.0)), ',') END AS cnl FROM o"""))
def vcf_encode(spark, d):
    cn = F.when(F.col("sample").cast("int") % 11 == 10, None).otherwise(F.least(F.round("cp"), F.lit(4.0)).cast("int"))
    lls = F.map_from_arrays(F.sequence(F.lit(0), F.lit(4)), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: F.round(F.lit(-9.87) * (F.col("cp") - c) * (F.col("cp") - c), 2)))
    g = v.panel(spark, d).select(F.concat_ws(":", "contig", F.col("w").cast("string")).alias("locus"), "sample", cn.alias("cn"), lls.alias("lls"))
    return vcf.encoded(g)


@query("viz_group_summary", v.sql(v.PANEL, select="SELECT CAST(sample AS INT) % 5 AS grp, contig, w, round(avg(cp), 6) AS mean, round(stddev_pop(cp), 6) AS sd, min(cp) AS lo, max(cp) AS hi FROM panel GROUP BY 1, 2, 3"))
def viz_group_summary(spark, d):
    return v.panel(spark, d).groupBy((F.col("sample").cast("int") % 5).alias("grp"), "contig", "w").agg(r6(F.avg("cp"), "mean"), r6(F.stddev_pop("cp"), "sd"), F.min("cp").alias("lo"), F.max("cp").alias("hi"))


@query("viz_tiles", v.sql(v.PANEL, v.WINDOWS, select="SELECT contig, start // 10000 AS tile, count(*) AS n_windows, min(start) AS start, max(\"end\") AS \"end\" FROM windows GROUP BY 1, 2"))
def viz_tiles(spark, d):
    return v.windows(spark, d).groupBy("contig", F.floor(F.col("start") / 10_000).alias("tile")).agg(F.count("*").alias("n_windows"), F.min("start").alias("start"), F.max("end").alias("end"))


@query("target_loci", v.sql(v.CALLS, "t AS (SELECT chr, start + 100000000 AS ts, \"end\" + 50000000 AS te FROM calls WHERE call_id % 50 = 0)", select="SELECT call_id FROM calls c WHERE EXISTS (SELECT 1 FROM t WHERE t.chr = c.chr AND c.\"end\" >= ts AND c.start <= te)"))
def target_loci(spark, d):
    c = v.calls(spark, d)
    t = c.where("call_id % 50 = 0").select("chr", (F.col("start") + 100_000_000 - 1).alias("b_start"), (F.col("end") + 50_000_000 + 1).alias("b_end"))
    # closed on both sides: the half-open join on ends that reach one further
    return iv.interval_join(c, t, ["chr"], 3_600_000_000).select("call_id").distinct()


@query("shared_samples", "SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS sample, c_nationkey IN (SELECT s_nationkey FROM supplier) AS paired FROM customer")
def shared_samples(spark, d):
    a = v.table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("sample")).distinct()
    b = v.table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("sample"), F.lit(True).alias("paired")).distinct()
    return a.join(b, "sample", "left").select("sample", F.coalesce("paired", F.lit(False)).alias("paired"))
