"""Overlap of mixture components by adaptive quadrature of the least of their weighted densities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Error allowed in an integral, deviations on either side that it covers, and halvings of an interval at most.
TOLERANCE, REACH, HALVINGS = 1e-9, 10.0, 48


def integral(f: Callable[[np.ndarray], np.ndarray], cuts: np.ndarray, tolerance: float = TOLERANCE) -> float:
    """Integral of ``f`` from the first cut to the last by adaptive Simpson steps.

    All intervals that are not yet exact enough are halved at once; each
    may have the share of ``tolerance`` that its length is of the whole.
    Kinks cost halvings, not accuracy.
    """
    a, b = cuts[:-1], cuts[1:]
    a, b = a[b > a], b[b > a]
    if not len(a):
        return 0.0
    per_length, total = tolerance / (b[-1] - a[0]), 0.0
    fa, fm, fb = f(a), f((a + b) / 2), f(b)
    for depth in range(HALVINGS + 1):
        m = (a + b) / 2
        left, right = f((a + m) / 2), f((m + b) / 2)
        coarse = (b - a) / 6 * (fa + 4 * fm + fb)
        fine = (b - a) / 12 * (fa + 4 * left + 2 * fm + 4 * right + fb)
        done = (np.abs(fine - coarse) <= 15 * per_length * (b - a)) | (depth == HALVINGS)
        total += float((fine + (fine - coarse) / 15)[done].sum())
        o = ~done
        a, m, b, fa, left, fm, right, fb = (x[o] for x in (a, m, b, fa, left, fm, right, fb))
        if not len(a):
            break
        a, b, fa, fm, fb = np.concatenate([a, m]), np.concatenate([m, b]), np.concatenate([fa, fm]), np.concatenate([left, right]), np.concatenate([fm, fb])
    return total


def densities(mean: np.ndarray, sd: np.ndarray, weight: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Weighted normal densities, a row a component."""
    scale = weight / (sd * np.sqrt(2 * np.pi))
    return lambda x: scale[:, None] * np.exp(-0.5 * ((x - mean[:, None]) / sd[:, None]) ** 2)


def cuts(mean: np.ndarray, sd: np.ndarray, reach: float = REACH) -> np.ndarray:
    """Starting intervals: no component's bulk lies inside one of them unseen."""
    at = np.concatenate([mean + k * sd for k in (-reach, -4, -2, -1, 0, 1, 2, 4, reach)])
    return np.unique(at)


def least_mass(mean, sd, weight, reach: float = REACH, tolerance: float = TOLERANCE) -> float:
    """Integral of the least of all weighted densities."""
    mean, sd, weight = (np.asarray(x, float) for x in (mean, sd, weight))
    f = densities(mean, sd, weight)
    return integral(lambda x: f(x).min(0), cuts(mean, sd, reach), tolerance)


def lost_mass(mean, sd, weight, reach: float = REACH, tolerance: float = TOLERANCE) -> float:
    """Integral of all weighted densities but the greatest: the share that the best assignment gets wrong."""
    mean, sd, weight = (np.asarray(x, float) for x in (mean, sd, weight))
    f = densities(mean, sd, weight)

    def rest(x: np.ndarray) -> np.ndarray:
        d = f(x)
        return d.sum(0) - d.max(0)

    return integral(rest, cuts(mean, sd, reach), tolerance)


def mixture_overlaps(components: DataFrame, least_sd: float) -> tuple[DataFrame, DataFrame]:
    """Overlaps of neighbouring components by mean, and of whole mixtures.

    ``components(locus, label, mean, sd, n)``; weights are shares of ``n``,
    deviations below ``least_sd`` or unknown count as that.  First table:
    ``locus, label, next_label, overlap, of_own, of_next`` (the overlap as a
    share of either weight), a row for each pair of neighbours.  Second:
    ``locus, n_components, lost``.  Equal means are ordered by label; a
    single component has no neighbours and loses nothing.  A locus' few
    components are one group.
    """
    usable = components.where("mean is not null and n > 0").select("locus", "label", F.col("mean").cast("double").alias("mean"), F.greatest(F.coalesce("sd", F.lit(0.0)), F.lit(least_sd)).cast("double").alias("sd"), F.col("n").cast("double").alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in usable.schema}

    def pairs(key, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["mean", "label"])
        w, mean, sd, label = (p.n / p.n.sum()).to_numpy(), p["mean"].to_numpy(), p.sd.to_numpy(), p.label.tolist()
        o = [least_mass(mean[i : i + 2], sd[i : i + 2], w[i : i + 2]) for i in range(len(p) - 1)]
        cols = {"locus": [key[0]] * len(o), "label": label[:-1], "next_label": label[1:], "overlap": o, "of_own": [x / v for x, v in zip(o, w[:-1], strict=True)], "of_next": [x / v for x, v in zip(o, w[1:], strict=True)]}
        return pd.DataFrame(cols, dtype=object)

    def whole(key, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["mean", "label"])
        return pd.DataFrame({"locus": [key[0]], "n_components": [len(p)], "lost": [lost_mass(p["mean"], p.sd, p.n / p.n.sum())]})

    grouped = usable.groupBy("locus")
    neighbours = grouped.applyInPandas(pairs, f"locus {kinds['locus']}, label {kinds['label']}, next_label {kinds['label']}, overlap double, of_own double, of_next double")
    return neighbours, grouped.applyInPandas(whole, f"locus {kinds['locus']}, n_components long, lost double")
