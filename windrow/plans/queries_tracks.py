"""Queries on tracks and regions with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.operators import intervals as iv
from windrow.operators import tracks as tr
from windrow.plans import views as v

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def r6(c, name):
    return F.round(c, 6).alias(name)


_SS = """
ss AS (
  SELECT r.*, (SELECT count(*) FROM (SELECT DISTINCT contig, w, start FROM windows) x WHERE x.contig = r.contig AND x.start < r.start) AS a,
         (SELECT count(*) FROM (SELECT DISTINCT contig, w, "end" FROM windows) x WHERE x.contig = r.contig AND x."end" < r."end") AS b,
         (SELECT count(*) FROM windows x WHERE x.contig = r.contig) AS n FROM regions r)"""
_BASE = (v.PANEL, v.WINDOWS, v.REGION_VALUES, _SS.strip())


@query("asof_window_index", v.sql(*_BASE, select="SELECT region_id, CAST(a AS BIGINT) AS w_start, CAST(b AS BIGINT) AS w_end FROM ss"))
def asof_window_index(spark, d):
    axis = v.windows(spark, d)
    r = iv.asof_index(v.regions(spark), axis, "start", "start", "w_start")
    r = iv.asof_index(r, axis, "end", "end", "w_end")
    return r.select("region_id", "w_start", "w_end")


def _slice(rule):
    return lambda spark, d: iv.slice_join(iv.slices(v.regions(spark), v.windows(spark, d), rule), v.panel(spark, d))


@query("region_mean", v.sql(*_BASE, select="SELECT region_id, sample, round(avg(cp), 6) AS mean_cp FROM ss JOIN panel p ON p.contig = ss.contig AND p.w BETWEEN a AND least(b + 1, n - 1) GROUP BY 1, 2"))
def region_mean(spark, d):
    return _slice("mean")(spark, d).groupBy("region_id", "sample").agg(r6(F.avg("cp"), "mean_cp"))


_MEDIAN = "p.w BETWEEN a AND (CASE WHEN least(b + 1, n - 1) <= a THEN a + 1 ELSE least(b + 1, n - 1) END)"


@query("region_median", v.sql(*_BASE, select=f"SELECT region_id, sample, round(median(cp), 6) AS median_cp FROM ss JOIN panel p ON p.contig = ss.contig AND {_MEDIAN} GROUP BY 1, 2"))
def region_median(spark, d):
    return _slice("median")(spark, d).groupBy("region_id", "sample").agg(r6(F.median("cp"), "median_cp"))


_GT = "p.w >= (CASE WHEN e - a > 1 THEN a + 1 ELSE a END) AND p.w < e"


@query("region_locus_mean", v.sql(*_BASE, select=f"SELECT region_id, sample, round(avg(cp), 6) AS mean_cp, count(*) AS n FROM (SELECT *, CASE WHEN b <= a THEN a + 1 ELSE b END AS e FROM ss) s JOIN panel p ON p.contig = s.contig AND {_GT} GROUP BY 1, 2"))
def region_locus_mean(spark, d):
    return _slice("genotyper")(spark, d).groupBy("region_id", "sample").agg(r6(F.avg("cp"), "mean_cp"), F.count("*").alias("n"))


_PIVOT = tuple(map(str, range(25)))  # every nation's key is a sample


@query("region_pivot", v.sql(*_BASE, select="SELECT contig, start, \"end\", " + ", ".join(f"round(median(cp) FILTER (sample = '{s}'), 6) AS s{s}" for s in _PIVOT) + f" FROM (SELECT ss.contig, ss.start, ss.\"end\", p.sample, p.cp FROM ss JOIN panel p ON p.contig = ss.contig AND {_MEDIAN}) GROUP BY 1, 2, 3"))
def region_pivot(spark, d):
    cells = iv.slice_join(iv.slices(v.regions(spark), v.windows(spark, d), "median"), v.panel(spark, d))
    wide = cells.groupBy("contig", "start", "end").pivot("sample", _PIVOT).agg(F.median("cp"))
    return wide.select("contig", "start", "end", *(r6(F.col(f"`{s}`"), f"s{s}") for s in _PIVOT))


@query("weighted_region_mean", v.sql(*_BASE[:3], select="SELECT region_id, sample, round(sum(cp * o) / sum(o), 6) AS mean_cp FROM (SELECT region_id, sample, cp, CAST(least(r.\"end\", p.\"end\") - greatest(r.start, p.start) AS DOUBLE) AS o FROM regions r JOIN panel p ON p.contig = r.contig AND p.start < r.\"end\" AND r.start < p.\"end\") WHERE o > 0 GROUP BY 1, 2"))
def weighted_region_mean(spark, d):
    cells = v.panel(spark, d).select("contig", "sample", "cp", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    o = (F.least("end", "b_end") - F.greatest("start", "b_start")).cast("double")
    hit = iv.interval_join(v.regions(spark), cells, ["contig"], 10 * v.WIDTH).withColumn("o", o).where("o > 0")
    return hit.groupBy("region_id", "sample").agg(r6(F.sum(F.col("cp") * F.col("o")) / F.sum("o"), "mean_cp"))


@query("panel_recentre", v.sql(v.PANEL, "m AS (SELECT contig, sample, median(cp) FILTER (cp <> 0) AS m FROM panel GROUP BY 1, 2)", select="SELECT contig, sample, w, round(CASE WHEN contig = 'R' OR cp = 0 THEN cp ELSE cp + (2 - m) END, 6) AS cp FROM panel JOIN m USING (contig, sample)"))
def panel_recentre(spark, d):
    return tr.recentred(v.panel(spark, d), ["contig", "sample"], F.col("contig") == "R").select("contig", "sample", "w", r6(F.col("cp"), "cp"))


_RATIO = """
axis AS (SELECT * FROM (SELECT DISTINCT contig, w FROM panel) JOIN (SELECT DISTINCT contig, sample FROM panel WHERE sample <> '1') USING (contig)),
q AS (SELECT a.contig, a.sample, a.w, CASE WHEN r.cp <> 0 AND t.cp > 0 THEN log2(t.cp / r.cp) END AS value
      FROM axis a LEFT JOIN panel t ON t.contig = a.contig AND t.sample = a.sample AND t.w = a.w LEFT JOIN panel r ON r.contig = a.contig AND r.w = a.w AND r.sample = '1'),
k AS (SELECT *, max(w) OVER p AS top,
        last_value(value IGNORE NULLS) OVER (p ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
        first_value(value IGNORE NULLS) OVER (p ORDER BY w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r,
        min(CASE WHEN value IS NOT NULL THEN w END) OVER (p ORDER BY w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM q WINDOW p AS (PARTITION BY contig, sample))"""


@query("log2_ratio_repaired", v.sql(v.PANEL, _RATIO.strip().replace("OVER (p ", "OVER (PARTITION BY contig, sample "), select="SELECT contig, sample, w, round(coalesce(value, CASE WHEN l IS NULL THEN r WHEN r IS NULL OR coalesce(nx, top + 1) >= top THEN l ELSE (l + r) / 2 END), 6) AS value FROM k"))
def log2_ratio_repaired(spark, d):
    """Ratios of every other sample to sample 1, with the gaps of both repaired."""
    p = v.panel(spark, d)
    others = p.where("sample <> '1'")
    axis = p.select("contig", "w").distinct().join(others.select("contig", "sample").distinct(), "contig")
    ratio = tr.log2_ratios(others, p.where("sample = '1'"))
    return tr.repaired(axis.join(ratio, ["contig", "sample", "w"], "left"), ["contig", "sample"]).select("contig", "sample", "w", r6(F.col("value"), "value"))


_VAR = """
x AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY w) - 1 AS i, count(*) OVER (PARTITION BY contig) AS n FROM track),
f AS (SELECT contig, arg_min(cp, w) AS f, arg_max(cp, w) AS l FROM track GROUP BY 1),
d AS (SELECT x.contig, x.w, x.i, (SELECT sum(y.cp) FROM x y WHERE y.contig = x.contig AND y.i BETWEEN x.i - 4 AND x.i) / 5 AS m, n FROM x),
j AS (SELECT d.contig, d.w, d.m, y.cp FROM d, range(-2, 3) o(k), x y WHERE y.contig = d.contig AND y.i = least(greatest(d.i + k, 0), d.n - 1))"""


@query("windowed_variance", v.sql(v.TRACK, _VAR.strip(), select="SELECT contig, w, round(sum((cp - m) * (cp - m)) / 5, 6) AS variance FROM j GROUP BY 1, 2"))
def windowed_variance(spark, d):
    return tr.windowed_variance(v.track(spark, d), ["contig"], 2, tile=32).select("contig", "w", r6(F.col("variance"), "variance"))


@query("shifted_variance", v.sql(v.TRACK, _VAR.strip(), "vv AS (SELECT contig, w, sum((cp - m) * (cp - m)) / 5 AS variance FROM j GROUP BY 1, 2)", "c AS (SELECT contig, count(*) AS n FROM vv GROUP BY 1)", select="SELECT a.contig, a.w, round(b.variance, 6) AS l_var, round(e.variance, 6) AS r_var FROM vv a JOIN c USING (contig) JOIN vv b ON b.contig = a.contig AND b.w = (a.w - 3 + n) % n JOIN vv e ON e.contig = a.contig AND e.w = (a.w + 3) % n"))
def shifted_variance(spark, d):
    t = tr.windowed_variance(v.track(spark, d), ["contig"], 2, tile=32).select("contig", "w", "variance")
    t = tr.shifted(tr.shifted(t, ["contig"], 3, "variance", "l"), ["contig"], -3, "variance", "r")
    return t.select("contig", "w", r6(F.col("l"), "l_var"), r6(F.col("r"), "r_var"))


@query("moving_mean", v.sql(v.TRACK, select="SELECT contig, w, round(m, 6) AS mean_cp, round(s, 6) AS sum_cp FROM (SELECT contig, w, row_number() OVER q AS rn, avg(cp) OVER f AS m, sum(cp) OVER f AS s FROM track WINDOW q AS (PARTITION BY contig ORDER BY w), f AS (PARTITION BY contig ORDER BY w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE rn > 5"))
def moving_mean(spark, d):
    a = tr.moving(v.track(spark, d), ["contig"], 5, "avg", tile=32)
    b = tr.moving(v.track(spark, d), ["contig"], 5, "sum", tile=32).select("contig", "w", F.col("moving").alias("s"))
    return a.join(b, ["contig", "w"]).select("contig", "w", r6(F.col("moving"), "mean_cp"), r6(F.col("s"), "sum_cp"))


@query("dup_runs", v.sql(v.PANEL, select="SELECT contig, sample, min(w) * 500 AS start, (max(w) + 1) * 500 AS \"end\", count(*) AS n FROM (SELECT *, w - row_number() OVER (PARTITION BY contig, sample ORDER BY w) AS g FROM panel WHERE cp > 2.5) GROUP BY contig, sample, g"))
def dup_runs(spark, d):
    r = iv.runs(v.panel(spark, d).where("cp > 2.5"), ["contig", "sample"])
    return r.select("contig", "sample", (F.col("first") * 500).alias("start"), (F.col("last") * 500).alias("end"), (F.col("last") - F.col("first")).alias("n"))


@query("rle_bands", v.sql(v.PANEL, "c AS (SELECT *, CAST(least(round(cp), 10) AS INT) AS cn FROM panel)", "b AS (SELECT *, sum(nw) OVER (PARTITION BY contig, sample ORDER BY w) AS g FROM (SELECT *, CASE WHEN lag(cn) OVER (PARTITION BY contig, sample ORDER BY w) = cn THEN 0 ELSE 1 END AS nw FROM c))", select="SELECT contig, sample, min(start) AS start, max(\"end\") AS \"end\", any_value(cn) AS cn FROM b GROUP BY contig, sample, g"))
def rle_bands(spark, d):
    return tr.bands(v.panel(spark, d), ["contig", "sample"]).select("contig", "sample", "start", "end", "cn")


@query("midpoint_tiles", v.sql(v.TRACK, "m AS (SELECT *, (start + \"end\") // 2 AS mid FROM track)", "e AS (SELECT *, coalesce((mid + lead(mid) OVER (PARTITION BY contig ORDER BY w)) // 2, \"end\") AS t_end FROM m)", select="SELECT contig, w, coalesce(lag(t_end) OVER (PARTITION BY contig ORDER BY w), start) AS t_start, t_end, CAST(least(round(cp), 10) AS INT) AS cn FROM e"))
def midpoint_tiles(spark, d):
    return tr.midpoint_tiles(v.track(spark, d), ["contig"]).select("contig", "w", "t_start", "t_end", F.least(F.round("cp"), F.lit(10.0)).cast("int").alias("cn"))


_SIGMA = 2.0
_KERNEL = tr.gaussian_kernel(_SIGMA)
_RADIUS = max(k[0] for k in _KERNEL)
_CONV = f"""
kern(off, k0, k1, k2) AS (VALUES {", ".join(f"({o}, CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE), CAST({c!r} AS DOUBLE))" for o, a, b, c in _KERNEL)}),
n AS (SELECT contig, count(*) AS n FROM track GROUP BY 1),
mir AS (SELECT t.contig, t.w, k0, k1, k2, CASE WHEN t.w + off < 0 THEN -(t.w + off) - 1 WHEN t.w + off >= n THEN 2 * n - 1 - (t.w + off) ELSE t.w + off END AS j FROM track t JOIN n USING (contig), kern),
g AS (SELECT a.contig, a.w, sum(cp * k0) AS g0, sum(cp * k1) AS g1, sum(cp * k2) AS g2 FROM mir a JOIN track t ON t.contig = a.contig AND t.w = a.j GROUP BY 1, 2)"""


@query("gaussian_derivative", v.sql(v.TRACK, _CONV.strip(), select="SELECT contig, w, round(g0, 6) AS g0, round(g1, 6) AS g1, round(g2, 6) AS g2 FROM g"))
def gaussian_derivative(spark, d):
    g = tr.gaussian_derivatives(v.track(spark, d), ["contig"], _SIGMA)
    return g.select("contig", "w", *(r6(F.col(f"g{i}"), f"g{i}") for i in range(3)))


_EDGE = """
s AS (SELECT *, sign(g2) AS s, count(*) OVER (PARTITION BY contig) AS n, lag(sign(g2)) OVER (PARTITION BY contig ORDER BY w) AS was FROM (SELECT contig, w, round(g1, 9) AS g1, round(g2, 9) AS g2 FROM g)),
c AS (SELECT *, count(*) OVER (PARTITION BY contig) AS len, row_number() OVER (PARTITION BY contig ORDER BY abs(g1) DESC, w) AS rk FROM s WHERE was <> s OR w = 0 OR w = n - 1)"""


@query("edge_detect", v.sql(v.TRACK, _CONV.strip(), _EDGE.strip(), select="SELECT contig, w, CAST(s AS INT) AS sign FROM c WHERE rk <= CASE WHEN len = n THEN len ELSE least(len, n - len) END AND s <> 0"))
def edge_detect(spark, d):
    g = tr.gaussian_derivatives(v.track(spark, d), ["contig"], _SIGMA)
    return tr.edges(g.select("contig", "w", F.round("g1", 9).alias("g1"), F.round("g2", 9).alias("g2")), ["contig"], collapsed=False)
