"""Queries on call tables and null models with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.operators import calls as cl
from windrow.operators import intervals as iv
from windrow.operators import nullmodel as nm
from windrow.plans import sql as sq
from windrow.plans import views as v
from windrow.plans.queries_tracks import _SS, r6

QUERIES, SQL = {}, {}
#: Bin width of interval joins on call coordinates (microseconds).
BIN = 3_600_000_000
ORDER = ["start", "end", "call_id"]


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


_SWEEP = """
sweep AS (SELECT *, max("end") OVER (PARTITION BY chr ORDER BY start, "end", call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM calls),
clustered AS (SELECT *, CAST(sum(CASE WHEN pm IS NULL OR start >= pm THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY start, "end", call_id) AS BIGINT) AS cluster_no FROM sweep)""".strip()


def clustered(spark, d):
    return iv.overlap_clusters(v.calls(spark, d), ["chr"], ORDER)


@query("overlap_clusters", v.sql(v.CALLS, _SWEEP, select="SELECT call_id, chr, cluster_no FROM clustered"))
def overlap_clusters(spark, d):
    return clustered(spark, d).select("call_id", "chr", "cluster_no")


@query("cluster_stats", v.sql(v.CALLS, _SWEEP, select="""SELECT chr, cluster_no, count(*) AS n, min(start) AS min_start, max("end") AS max_end, median(start) AS med_start, median("end") AS med_end,
 list_sort(list(start))[CAST(floor(count(*) / 2) AS INT) + 1] AS upper_start, list_sort(list("end"))[CAST(floor(count(*) / 2) AS INT) + 1] AS upper_end, round(sum(log10(p)), 6) AS log_likelihood FROM clustered GROUP BY 1, 2"""))
def cluster_stats(spark, d):
    s = cl.cluster_stats(clustered(spark, d), ["chr"])
    return s.withColumn("log_likelihood", F.round("log_likelihood", 6))


@query("best_breakpoints", v.sql(v.CALLS, _SWEEP, "s AS (SELECT chr, cluster_no, start, round(sum(log10(p)), 9) AS s FROM clustered GROUP BY 1, 2, 3)", "e AS (SELECT chr, cluster_no, \"end\", round(sum(log10(p)), 9) AS s FROM clustered GROUP BY 1, 2, 3)", select="SELECT * FROM (SELECT chr, cluster_no, first(start ORDER BY s, start) AS best_start FROM s GROUP BY 1, 2) JOIN (SELECT chr, cluster_no, first(\"end\" ORDER BY s, \"end\") AS best_end FROM e GROUP BY 1, 2) USING (chr, cluster_no)"))
def best_breakpoints(spark, d):
    return cl.best_breakpoints(clustered(spark, d), ["chr"])


@query("merged_breakpoints", v.sql(v.CALLS, select="SELECT chr, start % 1000 AS start, \"end\" % 1000 AS \"end\", round(sum(log10(p)), 6) AS log10_p, count(*) AS n, array_to_string(list_sort(list(DISTINCT indiv_ref)), ',') AS refs FROM calls GROUP BY 1, 2, 3"))
def merged_breakpoints(spark, d):
    c = v.calls(spark, d).withColumn("start", F.col("start") % 1000).withColumn("end", F.col("end") % 1000)
    m = cl.merged_breakpoints(c, ["chr"])
    return m.select("chr", "start", "end", r6(F.col("log10_p"), "log10_p"), "n", F.array_join("refs", ",").alias("refs"))


@query("reciprocal_overlap", v.sql(v.CALLS, select="SELECT a.call_id AS a_id, b.call_id AS b_id, least(o / CAST(a.\"end\" - a.start AS DOUBLE), o / CAST(b.\"end\" - b.start AS DOUBLE)) AS recip FROM (SELECT * FROM calls) a JOIN calls b ON a.chr = b.chr AND a.call_id < b.call_id AND a.start < b.\"end\" AND b.start < a.\"end\", LATERAL (SELECT least(a.\"end\", b.\"end\") - greatest(a.start, b.start) AS o)"))
def reciprocal_overlap(spark, d):
    return iv.reciprocal_pairs(v.calls(spark, d), ["chr"], BIN)


_DUP_ISLANDS = """
ds AS (SELECT *, max("end") OVER (PARTITION BY chr ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM (SELECT DISTINCT * FROM dups)),
di AS (SELECT chr, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(CASE WHEN pm IS NULL OR start >= pm THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY start, "end") AS g FROM ds) GROUP BY chr, g)""".strip()


@query("dup_overlap_fraction", v.sql(v.CALLS, v.DUPS, _DUP_ISLANDS, select="SELECT c.call_id, coalesce(sum(CASE WHEN i.chr IS NOT NULL THEN least(c.\"end\", i.\"end\") - greatest(c.start, i.start) END), 0) / CAST(any_value(c.\"end\" - c.start) AS DOUBLE) AS fraction FROM calls c LEFT JOIN di i ON c.chr = i.chr AND c.start < i.\"end\" AND i.start < c.\"end\" GROUP BY 1"))
def dup_overlap_fraction(spark, d):
    return iv.covered_fraction(v.calls(spark, d), v.dups(spark, d), BIN).select("call_id", "fraction")


_EX = """
es AS (SELECT *, max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM (SELECT DISTINCT chr, start - 60000000 AS s, "end" + 60000000 AS e FROM excludes)),
ei AS (SELECT chr, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN pm IS NULL OR s >= pm THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY s, e) AS g FROM es) GROUP BY chr, g)""".strip()
PAD = 60_000_000


@query("exclusion_merge", v.sql(v.CALLS, v.EXCLUDES, _EX, select="SELECT chr, s AS start, e AS \"end\" FROM ei"))
def exclusion_merge(spark, d):
    ex = v.excludes(spark, d).select("chr", (F.col("start") - PAD).alias("start"), (F.col("end") + PAD).alias("end"))
    return iv.merged(ex, ["chr"])


_SUB = """
h AS (SELECT call_id, c.chr, start, "end", s, e, lag(e) OVER (PARTITION BY call_id ORDER BY s) AS pe FROM calls c JOIN ei ON c.chr = ei.chr AND start < e AND s < "end"),
pieces AS (
  SELECT call_id, chr, coalesce(pe, start) AS s, s AS e FROM h
  UNION ALL SELECT call_id, chr, max(e), any_value("end") FROM h GROUP BY 1, 2
  UNION ALL SELECT call_id, chr, start, "end" FROM calls WHERE call_id NOT IN (SELECT call_id FROM h))""".strip()


@query("exclusion_subtract", v.sql(v.CALLS, v.EXCLUDES, _EX, _SUB, select="SELECT call_id, chr, s AS start, e AS \"end\" FROM pieces WHERE s < e"))
def exclusion_subtract(spark, d):
    return iv.subtracted(v.calls(spark, d).select("call_id", "chr", "start", "end"), v.excludes(spark, d), PAD, BIN)


_FILTER = "(p / exp(mu * mu) < 0.05 OR abs(mu) > 1.5) AND window_size >= 3 AND \"end\" - start <= 900000000"


@query("call_filter", v.sql(v.CALLS, select=f"SELECT call_id, chr, start, \"end\", window_size FROM calls WHERE {_FILTER}"))
def call_filter(spark, d):
    return cl.filtered(v.calls(spark, d), 0.05, 3, 1.5, max_size=900_000_000).select("call_id", "chr", "start", "end", "window_size")


@query("call_shard", v.sql(v.CALLS, _SWEEP, select="SELECT call_id, chr, cluster_no FROM clustered WHERE (cluster_no - 1) % 7 = 3"))
def call_shard(spark, d):
    return cl.shard(clustered(spark, d), ["chr"], 3, 7).select("call_id", "chr", "cluster_no")


_FINAL = """
sub AS (SELECT chr, cluster_no, start // 1000000000 AS sub, median(start) AS s, median("end") AS e, count(*) AS n, sum(log10(p)) AS ll, list(indiv_ref) AS refs, sum(count(*)) OVER (PARTITION BY chr, cluster_no) AS members
        FROM clustered GROUP BY 1, 2, 3)""".strip()


@query("call_final", v.sql(v.CALLS, _SWEEP, _FINAL, select="SELECT chr, cluster_no, min(s) AS start, max(e) AS \"end\", array_to_string(list_sort(list_distinct(flatten(list(refs)))), ',') AS called_refs, round(sum(ll), 6) AS log_likelihood FROM sub WHERE members = 1 OR (round(ll, 9) < -3 AND n >= 2) GROUP BY 1, 2"))
def call_final(spark, d):
    c = clustered(spark, d).withColumn("sub", F.floor(F.col("start") / 1_000_000_000))
    f = cl.resolved(c, ["chr"])
    return f.select("chr", "cluster_no", "start", "end", F.array_join("called_refs", ",").alias("called_refs"), r6(F.col("log_likelihood"), "log_likelihood"))


_REFS = ["2", "3", "4"]


@query("delta_vs_refs", v.sql(v.PANEL, v.WINDOWS, v.REGION_VALUES, _SS.strip(), select="SELECT region_id, round(avg(abs(d)), 6) AS delta, count(*) AS n_refs FROM (SELECT region_id, r.sample, avg(t.cp - r.cp) AS d FROM ss JOIN panel t ON t.contig = ss.contig AND t.sample = '1' AND t.w >= a AND t.w < b JOIN panel r ON r.contig = t.contig AND r.w = t.w AND r.sample IN ('2', '3', '4') GROUP BY 1, 2) GROUP BY 1"))
def delta_vs_refs(spark, d):
    regions = v.regions(spark).withColumn("refs", F.array(*map(F.lit, _REFS)))
    return cl.deltas(regions, v.panel(spark, d), v.windows(spark, d), "1").select("region_id", r6(F.col("delta"), "delta"), "n_refs")


@query("bh_fdr", v.sql(v.CALLS, "q AS (SELECT call_id, round(p, 9) AS p FROM calls)", "k AS (SELECT *, row_number() OVER (ORDER BY p, call_id) - 1 AS k, count(*) OVER () AS m FROM q)", select="SELECT call_id, CAST(k AS BIGINT) AS rank, k <= coalesce((SELECT max(k) FROM k WHERE p < 0.05 * (k + 1) / m), -1) AS significant FROM k"))
def bh_fdr(spark, d):
    c = v.calls(spark, d).select("call_id", F.round("p", 9).alias("p"))
    return cl.bh_fdr(c, 0.05, ["p", "call_id"]).select("call_id", F.col("rank").cast("long").alias("rank"), "significant")


_WELCH = """
nul AS (SELECT count(*) AS nn, avg(cp) AS nm, var_pop(cp) AS nv FROM panel),
seg AS (SELECT contig, sample, w // 10 AS seg, count(*) AS n, avg(cp) AS mean, var_pop(cp) AS var FROM panel GROUP BY 1, 2, 3),
e AS (SELECT *, greatest(sqrt(n), 2) AS n1, sqrt(nn) AS n2 FROM seg, nul),
tt AS (SELECT *, (mean - nm) / sqrt(var / n1 + nv / n2) AS t, pow(var / n1 + nv / n2, 2) / (pow(var / n1, 2) / (n1 - 1) + pow(nv / n2, 2) / (n2 - 1)) AS df FROM e)""".strip()


def _segments(spark, d):
    p = v.panel(spark, d)
    seg = p.groupBy("contig", "sample", F.floor(F.col("w") / 10).alias("seg")).agg(F.count("*").alias("n"), F.avg("cp").alias("mean"), F.var_pop("cp").alias("var"))
    return nm.welch(seg, nm.moments(p))


@query("welch_t_stats", v.sql(v.PANEL, _WELCH, select="SELECT contig, sample, seg, n, round(t, 6) AS t, round(df, 6) AS df FROM tt"))
def welch_t_stats(spark, d):
    return _segments(spark, d).select("contig", "sample", "seg", "n", r6(F.col("t"), "t"), r6(F.col("df"), "df"))


@query("t_cdf_p", v.sql(v.PANEL, _WELCH, select=f"SELECT contig, sample, seg, CASE WHEN var = 0 THEN 0.5 ELSE round({sq.t_tail()}, 6) END AS p FROM tt"))
def t_cdf_p(spark, d):
    return _segments(spark, d).select("contig", "sample", "seg", r6(nm.folded_p(), "p"))


_HIST = """
mv AS (SELECT * FROM (SELECT row_number() OVER (PARTITION BY contig ORDER BY w) AS rn, avg(cp) OVER (PARTITION BY contig ORDER BY w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM track) WHERE rn > 4),
st AS (SELECT *, 3.5 * sd / pow(CAST(total AS DOUBLE), 1.0 / 3.0) / 10 AS step FROM (SELECT stddev_pop(m) AS sd, count(*) AS total FROM mv)),
gr AS (SELECT *, ceil(10 * sd / step) AS bins FROM st),
bn AS (SELECT unnest(range(-1, CAST(bins AS BIGINT))) AS bin, * FROM gr),
ct AS (SELECT CAST(greatest(-1, least(floor((m - 1.9 + 5 * sd) / step), bins - 1)) AS BIGINT) AS bin, count(*) AS n FROM mv, gr GROUP BY 1)""".strip()


@query("null_histogram", v.sql(v.TRACK, _HIST, select="SELECT bn.bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / CAST(total AS DOUBLE), 6) AS share, round(sum(coalesce(n, 0)) OVER (ORDER BY bn.bin) / CAST(total AS DOUBLE), 6) AS cumulative FROM bn LEFT JOIN ct ON bn.bin = ct.bin"))
def null_histogram(spark, d):
    t = v.track(spark, d).withColumn("cp", F.col("cp") - 1.9)
    return nm.histogram(t, ["contig"], 4).select("bin", F.col("n").cast("long").alias("n"), r6(F.col("share"), "share"), r6(F.col("cumulative"), "cumulative"))


_EMPIRICAL = (v.TRACK, "mm AS (SELECT contig, w, row_number() OVER (PARTITION BY contig ORDER BY w) AS rn, avg(cp - 1.9) OVER (PARTITION BY contig ORDER BY w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x FROM track)", "src AS (SELECT x FROM mm WHERE rn > 4)", sq.histogram("e", "src"), f"em AS (SELECT contig, seg, {sq.density('e', 'mean')} AS c FROM (SELECT contig, w // 4 AS seg, avg(cp - 1.9) AS mean FROM track GROUP BY 1, 2))")


@query("empirical_p", v.sql(*_EMPIRICAL, select=f"SELECT contig, seg, round(least(greatest({sq.folded('c')}, 0) * 2, 0.5), 6) AS p FROM em"))
def empirical_p(spark, d):
    t = v.track(spark, d).withColumn("cp", F.col("cp") - 1.9)
    segments = t.groupBy("contig", F.floor(F.col("w") / 4).alias("seg")).agg(F.avg("cp").alias("mean"))
    return nm.empirical_p(segments, nm.histogram(t, ["contig"], 4), "mean", 4).select("contig", "seg", r6(F.col("p"), "p"))


@query("variance_deciles", v.sql(v.PANEL, "vv AS (SELECT contig, sample, round(var_pop(cp), 9) AS v FROM panel GROUP BY 1, 2)", "o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS pos, count(*) OVER () AS n FROM vv)", select="SELECT CAST(i AS INT) AS i, v AS edge FROM o JOIN range(0, 10) r(i) ON pos = i * (n // 10) UNION ALL SELECT 10, max(v) FROM vv"))
def variance_deciles(spark, d):
    per = v.panel(spark, d).groupBy("contig", "sample").agg(F.round(F.var_pop("cp"), 9).alias("v"))
    return nm.deciles(per, "v")


@query("masked_null", v.sql(v.PANEL, select="SELECT count(*) AS null_n, round(avg(cp), 6) AS null_mean, round(var_pop(cp), 6) AS null_var FROM panel WHERE NOT (contig IN ('A', 'R') AND ((w >= 10 AND w < 20) OR (w >= 15 AND w < 25)))"))
def masked_null(spark, d):
    masks = spark.createDataFrame([("A", 10, 20), ("A", 15, 25), ("R", 10, 20), ("R", 15, 25)], "contig string, first long, last long")
    m = nm.moments(nm.masked(v.panel(spark, d), masks))
    return m.select("null_n", r6(F.col("null_mean"), "null_mean"), r6(F.col("null_var"), "null_var"))


_RS = """
x AS (SELECT contig, w, CAST(sample AS INT) % 2 = 0 AS g, cp FROM panel),
rk AS (SELECT *, rank() OVER (PARTITION BY contig, w ORDER BY cp) + (count(*) OVER (PARTITION BY contig, w, cp) - 1) / 2.0 AS r FROM x),
sm AS (SELECT contig, w, CAST(sum(r) FILTER (g) AS DOUBLE) AS s, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2 FROM rk GROUP BY 1, 2)""".strip()


@query("rank_sum_z", v.sql(v.PANEL, _RS, select="SELECT contig, w, n1, n2, round((s - n1 * (n1 + n2 + 1) / CAST(2 AS DOUBLE)) / sqrt(n1 * n2 * (n1 + n2 + 1) / CAST(12 AS DOUBLE)), 6) AS z FROM sm"))
def rank_sum_z(spark, d):
    x = v.panel(spark, d).withColumn("g", F.col("sample").cast("int") % 2 == 0)
    return nm.rank_sum(x, "g", "cp", ["contig", "w"]).select("contig", "w", "n1", "n2", r6(F.col("z"), "z"))


@query("rank_sum_p", v.sql(v.PANEL, _RS, "zz AS (SELECT contig, w, (s - n1 * (n1 + n2 + 1) / CAST(2 AS DOUBLE)) / sqrt(n1 * n2 * (n1 + n2 + 1) / CAST(12 AS DOUBLE)) AS z FROM sm)", select=f"SELECT contig, w, round({sq.normal_two_sided('z')}, 6) AS p FROM zz"))
def rank_sum_p(spark, d):
    x = v.panel(spark, d).withColumn("g", F.col("sample").cast("int") % 2 == 0)
    return nm.rank_sum(x, "g", "cp", ["contig", "w"]).select("contig", "w", r6(F.col("p"), "p"))


