"""Pieces of DuckDB SQL that several queries share: integrals, histograms, complete linkage."""

from __future__ import annotations


def simpson(term: str, step: str, parts: int = 200) -> str:
    """Integral of ``term``, an expression in k, from 0 to ``parts`` times ``step``."""
    weight = f"CASE WHEN k = 0 OR k = {parts} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"((SELECT sum({weight} * {term}) FROM range(0, {parts + 1}) r(k)) * {step} / 3)"


def t_tail(t: str = "t", df: str = "df") -> str:
    """Probability of a Student t beyond ``|t|``: the density in the angle whose tangent is t over the root of df."""
    step = f"(atan(abs({t}) / sqrt({df})) / 200)"
    return f"(0.5 - exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {simpson(f'pow(cos(k * {step}), {df} - 1)', step)})"


def normal_two_sided(z: str) -> str:
    step = f"(abs({z}) / 200)"
    return f"(1 - 2 / sqrt(2 * pi()) * {simpson(f'exp(-pow(k * {step}, 2) / 2)', step)})"


def histogram(name: str, source: str) -> str:
    """CTEs up to ``{name}h(bin, lo, n, total, c)``: the null histogram of ``source(x)`` with cumulative densities."""
    return f"""
{name}s AS (SELECT stddev_pop(x) AS sd, count(*) AS total FROM {source}),
{name}g AS (SELECT *, ceil(10 * sd / step) AS bins FROM (SELECT *, 3.5 * sd / pow(CAST(total AS DOUBLE), 1.0 / 3.0) / 10 AS step FROM {name}s)),
{name}b AS (SELECT unnest(range(-1, CAST(bins AS BIGINT))) AS bin, * FROM {name}g),
{name}c AS (SELECT CAST(greatest(-1, least(floor((x + 5 * sd) / step), bins - 1)) AS BIGINT) AS bin, count(*) AS n FROM {source}, {name}g GROUP BY 1),
{name}h AS (SELECT b.bin, CASE WHEN b.bin < 0 THEN -99999.9 ELSE -5 * sd + b.bin * step END AS lo, coalesce(n, 0) AS n, total, sum(coalesce(n, 0)) OVER (ORDER BY b.bin) / CAST(total AS DOUBLE) AS c
  FROM {name}b b LEFT JOIN {name}c c ON b.bin = c.bin)""".strip()


def density(name: str, value: str) -> str:
    """Cumulative density one bin beyond the one that holds ``value``."""
    return f"(SELECT c FROM {name}h WHERE bin = least((SELECT count(*) FROM {name}h WHERE lo < {value}) + 2, (SELECT count(*) FROM {name}h)) - 2)"


def folded(c: str) -> str:
    return f"CASE WHEN {c} > 0.5 THEN 1 - {c} ELSE {c} END"


def linkage(source: str, keys: list[str], cut: float = 0.85, max_frac_uniq: float | None = None) -> str:
    """CTEs up to ``linked(keys, cluster_no, start, "end", sub)``: complete linkage of each cluster's distinct intervals of ``source``, merge by merge."""
    k = ", ".join([*keys, "cluster_no"])
    a, b = (", ".join(f"{x}.{c}" for c in [*keys, "cluster_no"]) for x in "ab")
    r = "CASE WHEN o > 0 THEN least(o / CAST(la AS DOUBLE), o / CAST(lb AS DOUBLE)) ELSE 0 END"
    if max_frac_uniq is not None:
        r = f"CASE WHEN 1 - ({r}) >= {max_frac_uniq} THEN 0 ELSE {r} END"
    return f"""
points AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY start, "end") - 1 AS p FROM (SELECT DISTINCT {k}, start, "end" FROM {source})),
apart AS (
  SELECT {k}, pa, pb, 1 - ({r}) AS d FROM (
    SELECT {a}, a.p AS pa, b.p AS pb, least(a."end", b."end") - greatest(a.start, b.start) AS o, a."end" - a.start AS la, b."end" - b.start AS lb FROM points a JOIN points b USING ({k}) WHERE a.p < b.p)),
state AS (
  SELECT 0 AS step, {k}, p, p AS g FROM points
  UNION ALL
  SELECT s.step + 1, {", ".join("s." + c for c in [*keys, "cluster_no"])}, s.p, CASE WHEN s.g = m.gb THEN m.ga ELSE s.g END
  FROM state s JOIN (
    SELECT {k}, first(ga ORDER BY d, ga, gb) AS ga, first(gb ORDER BY d, ga, gb) AS gb FROM (
      SELECT {a}, least(a.g, b.g) AS ga, greatest(a.g, b.g) AS gb, max(x.d) AS d
      FROM apart x JOIN state a ON {" AND ".join(f"x.{c} = a.{c}" for c in [*keys, "cluster_no"])} AND x.pa = a.p JOIN state b ON {" AND ".join(f"x.{c} = b.{c}" for c in [*keys, "cluster_no"])} AND x.pb = b.p
      WHERE a.g <> b.g GROUP BY ALL)
    WHERE d <= {cut} GROUP BY {k}) m USING ({k})),
linked AS (
  SELECT {", ".join("z." + c for c in [*keys, "cluster_no"])}, q.start, q."end", CAST(dense_rank() OVER (PARTITION BY {", ".join("z." + c for c in [*keys, "cluster_no"])} ORDER BY z.g) - 1 AS INT) AS sub
  FROM (SELECT * FROM state QUALIFY step = max(step) OVER (PARTITION BY {k})) z JOIN points q USING ({k}, p))""".strip()
