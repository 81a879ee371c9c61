"""The whole assessment of a locus of several overlapping calls: which segments to genotype, on which samples.

A locus is samples x windows, so it is one grouped task; loci are spread over
the cluster.  The steps are those of the relational operators in
:mod:`windrow.operators.complex_loci` and :mod:`windrow.operators.genotype`,
which take whole tables; what decides between them depends on the fits of the
locus itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from windrow.operators import mixture as mx

Span = tuple[int, int]


@dataclass(frozen=True)
class Limits:
    """Reasons to reject a segment's fit, as in :func:`windrow.operators.genotype.quality`, and bounds of the second panel's check."""

    max_mu: float = 7.0
    min_max_d: float = 0.5
    singleton_sigma: float = 5.0
    dup_sigma: float = 4.0
    second_mean: float = 3.0
    second_top: float = 2.5


def sample_means(wide: np.ndarray, w: np.ndarray, span: Span) -> np.ndarray:
    """Mean of each sample over windows [w0, w1); NaN without any."""
    part = wide[:, (w >= span[0]) & (w < span[1])]
    n = np.isfinite(part).sum(1)
    return np.where(n > 0, np.nansum(part, 1) / np.maximum(n, 1), np.nan)


def _labels(mu: np.ndarray) -> np.ndarray:
    """Mixture labels, -1 where there is no value."""
    out = np.full(len(mu), -1)
    known = np.isfinite(mu)
    if known.any():
        out[known] = mx.genotype(mu[known])["labels"]
    return out


def _kinds(labels: np.ndarray) -> np.ndarray:
    return np.unique(labels[labels >= 0])


def varying_spans(wide: np.ndarray, w: np.ndarray, at: list[int]) -> list[tuple[Span, np.ndarray]]:
    """Spans between breaks whose fits have several labels; neighbours with equal labels are one."""
    out, before = [], None
    for a, e in zip(at[:-1], at[1:], strict=True):
        labels = _labels(sample_means(wide, w, (a, e)))
        if len(_kinds(labels)) > 1:
            if out and before is not None and np.array_equal(before, labels):
                out[-1] = ((out[-1][0][0], e), out[-1][1])
            else:
                out.append(((a, e), labels))
        before = labels
    return out


def carried_spans(spans: list[tuple[Span, np.ndarray]], samples: int) -> list[list[Span]]:
    """Each sample's spans where its label is not the most frequent one; abutting spans are one."""
    out: list[list[Span]] = [[] for _ in range(samples)]
    for (a, e), labels in spans:
        kinds, n = np.unique(labels[labels >= 0], return_counts=True)
        mode = kinds[n.argmax()]
        for i in np.flatnonzero((labels >= 0) & (labels != mode)):
            if out[i] and out[i][-1][1] == a:
                out[i][-1] = (out[i][-1][0], e)
            else:
                out[i].append((a, e))
    return out


def shared_length(a: list[Span], b: list[Span]) -> int:
    return sum(max(0, min(e, f) - max(s, t)) for s, e in a for t, f in b)


def sample_groups(carried: list[list[Span]], max_frac_uniq: float, cut: float = 0.85) -> np.ndarray:
    """Complete-linkage clusters of samples by the least share of either's spans that the other's cover."""
    n = len(carried)
    size = [sum(e - s for s, e in c) for c in carried]
    d = np.ones((n, n))
    for i in range(n):
        d[i, i] = 0
        for j in range(i):
            if size[i] and size[j]:
                q = shared_length(carried[i], carried[j])
                far = 1 - min(q / size[i], q / size[j])
                d[i, j] = d[j, i] = far if far < max_frac_uniq else 1
    return mx.complete_linkage(d, cut)


def group_chunks(carried: list[list[Span]], groups: np.ndarray) -> dict[Span, set[int]]:
    """Chunks of spans that touch or overlap and that all of a group's samples share, at their median bounds, with the samples."""
    out: dict[Span, set[int]] = {}
    for g in np.unique(groups):
        members = np.flatnonzero(groups == g)
        spans = sorted((s, e, int(i)) for i in members for s, e in carried[i])
        chunk: list[tuple[int, int, int]] = []
        for x in [*spans, None]:
            if chunk and (x is None or x[0] > max(e for _, e, _ in chunk)):
                if {i for *_, i in chunk} == set(members.tolist()):
                    key = (int(np.median([s for s, *_ in chunk])), int(np.median([e for _, e, _ in chunk])))
                    out.setdefault(key, set()).update(members.tolist())
                chunk = []
            if x is not None:
                chunk.append(x)
    return out


def overlap(a: Span, b: Span) -> bool:
    return a[0] < b[1] and b[0] < a[1]


def to_assess(carriers: dict[Span, set[int]], samples: int) -> list[tuple[Span, list[int]]]:
    """Every span with the samples that carry no other span that overlaps it."""
    out = []
    for span in sorted(carriers):
        taken = set().union(*(c for other, c in carriers.items() if other != span and overlap(span, other)), set())
        out.append((span, [i for i in range(samples) if i not in taken]))
    return out


def alike(carriers: dict[Span, set[int]], wide: np.ndarray, w: np.ndarray, max_uniq: float) -> dict[Span, set[int]]:
    """Of overlapping spans that differ little and genotype all samples alike, the one with most carriers, with the carriers of all."""
    left = dict(carriers)
    labels = {s: _labels(sample_means(wide, w, s)) for s in left}
    for a in sorted(carriers, key=lambda s: (-len(carriers[s]), s)):
        for b in [s for s in left if a in left and s != a and overlap(a, s)]:
            q = min(a[1], b[1]) - max(a[0], b[0])
            near = 1 - min(q / (a[1] - a[0]), q / (b[1] - b[0])) < max_uniq
            if near and np.array_equal(labels[a], labels[b]):
                left[a] = left[a] | left.pop(b)
    return left


def passes(mu: np.ndarray, labels: np.ndarray, limits: Limits) -> bool:
    """Whether a fit survives the quality filter."""
    kinds = _kinds(labels)
    if len(kinds) < 2:
        return False
    stats = sorted((mu[labels == k].mean(), max(mu[labels == k].std(), 1e-9), int((labels == k).sum())) for k in kinds)
    d = np.diff([m for m, *_ in stats])
    z = min(min(x / a[1], x / b[1]) for x, a, b in zip(d, stats[:-1], stats[1:], strict=True))
    known = mu[labels >= 0]
    singleton = len(kinds) == 2 and min(n for *_, n in stats) == 1 and z < limits.singleton_sigma
    return not (d.max() < limits.min_max_d or known.mean() > limits.max_mu or singleton or (known.max() > 2.5 and z < limits.dup_sigma))


def assess(wide: np.ndarray, w: np.ndarray, breaks: list[int], limits: Limits = Limits(), second: np.ndarray | None = None, dups: list[Span] = ()) -> list[tuple[Span, list[int], bool]]:
    """(windows, samples to genotype there, whether the locus is simple) of the segments of one locus.

    ``wide`` is samples x windows with ordinals ``w``, ``breaks`` the bounds
    of its calls, ``second`` the other kind of panel over the same windows,
    ``dups`` duplicated stretches as window ranges.  A locus with one varying
    span, or without abutting ones, is simple: all samples are genotyped
    everywhere.
    """
    n = len(wide)
    at = mx.correlated_breaks(wide, w, sorted(set(breaks)))
    spans = varying_spans(wide, w, at)
    abutting = any(a[0][1] == b[0][0] for a, b in zip(spans[:-1], spans[1:], strict=True))
    if len(spans) <= 1 or not abutting:
        return [(s, list(range(n)), True) for s, _ in spans]
    carried = carried_spans(spans, n)
    original: dict[Span, set[int]] = {}
    for i, own in enumerate(carried):
        for s in own:
            original.setdefault(s, set()).add(i)
    inside = wide[:, (w >= at[0]) & (w < at[-1])]
    level = float(np.nanmean(inside))
    # the higher the copy number, the more samples and spans count as alike
    max_uniq, max_frac = (0.85, 0.9) if level > 20 else (0.7, 0.5) if level > 10 else (0.3, 0.1)
    found = group_chunks(carried, sample_groups(carried, max_frac))
    found |= {s: c for s, c in original.items() if not any(overlap(s, f) for f in found)}
    if len(found) > 1:
        found = alike(found, wide, w, max_uniq)
    kept: dict[Span, set[int]] = {}
    for span, who in to_assess(found, n):
        if len(who) < 2:
            continue
        mu = sample_means(wide, w, span)
        mine = np.full(n, np.nan)
        mine[who] = mu[who]
        high = any(overlap(span, x) for x in dups) or np.nanmean(mu) >= limits.second_mean or np.nanmax(mu) > limits.second_top
        if second is not None and high and len(_kinds(_labels(sample_means(second, w, span)))) < 2:
            continue
        if passes(mine, _labels(mine), limits):
            kept[span] = found[span]
    return [(s, who, False) for s, who in to_assess(kept, n)]


def assessed_loci(cells: DataFrame, breaks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``locus, w0, w1, samples, simple`` of every locus: cells(locus, sample, w, cp[, kind]), breaks(locus, at).

    Cells of kind ``sunk``, where there are any, are the second panel.
    """
    cols = [c for c in ("locus", "sample", "w", "cp", "kind") if c in cells.columns]

    def of(key, c: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"locus": [], "w0": [], "w1": [], "samples": [], "simple": []}
        if not c.empty and not b.empty:
            own = c[c.kind != "sunk"] if "kind" in c else c
            names, w = np.sort(own["sample"].unique()), np.sort(own.w.unique())

            def wide(p: pd.DataFrame) -> np.ndarray:
                return p.pivot_table(index="sample", columns="w", values="cp").reindex(index=names, columns=w).to_numpy(float)

            second = wide(c[c.kind == "sunk"]) if "kind" in c and (c.kind == "sunk").any() else None
            for (a, e), who, simple in assess(wide(own), w, [int(x) for at in b["at"] for x in at], limits, second):
                for k, v in zip(out, (key[0], int(a), int(e), [str(names[i]) for i in who], bool(simple)), strict=True):
                    out[k].append(v)
        return pd.DataFrame({k: pd.Series(x, dtype={"w0": "int64", "w1": "int64", "simple": "bool"}.get(k, "object")) for k, x in out.items()})

    b = breaks.select(breaks["locus"].alias("of_locus"), "at")
    return cells.select(*cols).groupBy("locus").cogroup(b.groupBy("of_locus")).applyInPandas(of, "locus string, w0 long, w1 long, samples array<string>, simple boolean")
