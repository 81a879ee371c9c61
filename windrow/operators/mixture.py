"""One-dimensional Gaussian mixture genotyping and linkage clustering, one grouped task per locus or cluster."""

from __future__ import annotations

import heapq
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.functions.special import gaussian_overlap
from windrow.operators.scan import running_count
from windrow.sources.scratch import written

MIN_COVAR, MAX_STEPS, TOLERANCE = 1e-4, 1000, 1e-2
#: Rows aimed at in one call of the linkage function, and tasks at most.
PER_TASK, MOST_TASKS = 5_000, 4_096


def centroid_tree(x: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges of centroid linkage as (height, node, node); points are nodes 0.. in order of x, each merge makes the next node.

    In one dimension the closest centroids are neighbours in order, so a heap
    of the gaps between neighbours suffices.  Of equal gaps the leftmost goes
    first.  A height is never below those of the parts (inversions settle).
    """
    s = np.sort(x, kind="stable").astype(float)
    n = len(s)
    centre, size, height = s.tolist(), [1] * n, [0.0] * n
    left, right, dead = list(range(-1, n - 1)), [*range(1, n), -1], [False] * n
    heap = [(centre[i + 1] - centre[i], i, i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    place, out = list(range(n)), []
    while heap:
        gap, _, a, b = heapq.heappop(heap)
        if dead[a] or dead[b]:
            continue
        m = size[a] + size[b]
        k = len(centre)
        centre.append((centre[a] * size[a] + centre[b] * size[b]) / m)
        size.append(m)
        height.append(max(gap, height[a], height[b]))
        place.append(place[a])
        left.append(left[a])
        right.append(right[b])
        dead[a] = dead[b] = True
        dead.append(False)
        out.append((height[k], a, b))
        for i, j in ((left[k], k), (k, right[k])):
            if i >= 0 and j >= 0:
                heapq.heappush(heap, (centre[j] - centre[i], place[i], i, j))
        if left[k] >= 0:
            right[left[k]] = k
        if right[k] >= 0:
            left[right[k]] = k
    return out


def centroid_partitions(x: np.ndarray, low: float = 0.2, high: float = 1.5, step: float = 0.001) -> list[np.ndarray]:
    """Distinct partitions of centroid linkage cut at low, low + step, ... below high.

    A cut takes the maximal subtrees whose highest merge is not above it.
    Merges join neighbouring stretches in order of x, so a partition is the
    set of borders that are left, and a cut only removes borders.
    """
    order = np.argsort(x, kind="stable")
    n = len(x)
    end = list(range(n))  # last point of a node's stretch
    border = np.full(max(n - 1, 0), np.inf)  # height at which the border after a point goes
    for h, a, b in centroid_tree(x):
        border[end[a]] = h
        end.append(end[b])
    out, last = [], -1
    for cut in np.arange(low, high, step):
        gone = int((border <= cut).sum())
        if gone == last:
            continue
        last = gone
        group = np.empty(n, int)
        group[order] = np.concatenate([[0], np.cumsum(border > cut)])
        # groups are numbered by their first member in the rows' own order
        kinds, first, inverse = np.unique(group, return_index=True, return_inverse=True)
        rank = np.empty(len(kinds), int)
        rank[np.argsort(first)] = np.arange(len(kinds))
        out.append(rank[inverse])
    return out


def log_densities(x: np.ndarray, mean: np.ndarray, var: np.ndarray, weight: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(weight) - 0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)


def _total(logs: np.ndarray) -> np.ndarray:
    top = logs.max(1)
    return top + np.log(np.exp(logs - top[:, None]).sum(1))


def start_of(x: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = np.unique(groups)
    part = [x[groups == g] for g in kinds]
    return np.array([p.mean() for p in part]), np.array([p.var() for p in part]), np.array([len(p) / len(x) for p in part])


def fit(x: np.ndarray, mean: np.ndarray, var: np.ndarray, weight: np.ndarray) -> dict:
    """EM from the given start: means, variances, weights, labels, log-likelihood, AIC (three parameters a component)."""
    var, before = np.maximum(var, MIN_COVAR), None
    for _ in range(MAX_STEPS):
        logs = log_densities(x, mean, var, weight)
        total = _total(logs)
        if before is not None and abs(total.sum() - before) < TOLERANCE:
            break
        before = total.sum()
        r = np.exp(logs - total[:, None])
        n = r.sum(0) + 1e-300
        weight, mean = n / n.sum(), (r * x[:, None]).sum(0) / n
        var = np.maximum((r * (x[:, None] - mean) ** 2).sum(0) / n, 0) + MIN_COVAR
    logs = log_densities(x, mean, var, weight)
    ll = float(_total(logs).sum())
    return {"mean": mean, "var": var, "weight": weight, "labels": logs.argmax(1), "ll": ll, "aic": -2 * ll + 6 * len(mean)}


def adjacent_overlaps(model: dict) -> list[tuple[float, float, int, int]]:
    """(largest overlap share, distance of means, component, next component) in order of means."""
    order = np.argsort(model["mean"], kind="stable")
    m, v, w = model["mean"], model["var"], model["weight"]
    return [(max(gaussian_overlap(m[a], v[a], w[a], m[b], v[b], w[b])), float(m[b] - m[a]), int(a), int(b)) for a, b in pairwise(order)]


def _join(x: np.ndarray, model: dict, a: int, b: int) -> dict:
    labels = np.where(model["labels"] == b, a, model["labels"])
    return fit(x, *start_of(x, labels))


def merge_components(x: np.ndarray, model: dict, max_overlap: float = 0.5, min_distance: float = 0.55) -> dict:
    """Merge neighbours that overlap by more than ``max_overlap``, then those closer than ``min_distance``; refit each time."""
    for pick, bad in ((lambda o: max(o), lambda o: o[0] > max_overlap), (lambda o: min(o, key=lambda q: q[1]), lambda o: o[1] < min_distance)):
        while len(np.unique(model["labels"])) > 1 and len(model["mean"]) > 1:
            worst = pick(adjacent_overlaps(model))
            if not bad(worst):
                break
            after = _join(x, model, worst[2], worst[3])
            if len(after["mean"]) >= len(model["mean"]) and np.array_equal(after["labels"], model["labels"]):
                break
            model = after
    return model


def genotype(x: np.ndarray, merge: bool = True, most: int = 30) -> dict:
    """Best mixture by AIC over the partitions of the linkage tree, with close components merged; all fits' AIC by size."""
    fits = []
    for groups in centroid_partitions(x):
        start = start_of(x, groups)
        if len(start[0]) > most and fits:
            continue
        fits.append(fit(x, *start))
    best = min(fits, key=lambda f: f["aic"])
    out = merge_components(x, best) if merge and len(np.unique(best["labels"])) > 1 else best
    return out | {"tried": [(len(f["mean"]), f["aic"]) for f in fits]}


def bic_delta(tried: list[tuple[int, float]], chosen: int) -> float:
    """Least distance of the chosen component number's criterion to that of one more or one fewer; -1 without neighbours."""
    best: dict[int, float] = {}
    for k, ic in tried:
        best[k] = min(ic, best.get(k, np.inf))
    near = [abs(best[k] - best[chosen]) for k in (chosen - 1, chosen + 1) if k in best and chosen in best]
    return float(min(near)) if near else -1.0


def rounded(x: np.ndarray) -> dict:
    """Components at the rounded values, for loci of copy numbers too high for a mixture."""
    kinds, labels = np.unique(np.floor(x + 0.5), return_inverse=True)
    share = np.bincount(labels) / len(x)
    return {"mean": kinds, "var": np.full(len(kinds), MIN_COVAR), "weight": share, "labels": labels, "aic": float("nan"), "tried": []}


def genotypes(obs: DataFrame, keys: list[str], merge: bool = True, high: float | None = None) -> DataFrame:
    """Mixture labels of obs(keys, sample, mu): adds label, post, comp_mean, comp_var, comp_weight, n_comp, aic, aic_delta.

    A locus with a value above ``high`` is rounded instead of fitted.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in obs.select(*keys).schema)
    schema += ", sample string, mu double, label int, post double, comp_mean double, comp_var double, comp_weight double, n_comp int, aic double, aic_delta double"

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["mu"]).sort_values("sample").reset_index(drop=True)
        names = [*keys, "sample", "mu", "label", "post", "comp_mean", "comp_var", "comp_weight", "n_comp", "aic", "aic_delta"]
        if pdf.empty:
            return pd.DataFrame({n: [] for n in names})
        x = pdf.mu.to_numpy(float)
        g = rounded(x) if high is not None and x.max() > high else genotype(x, merge)
        # labels count components in order of their means
        order = np.argsort(g["mean"], kind="stable")
        rank = np.empty(len(order), int)
        rank[order] = np.arange(len(order))
        logs = log_densities(x, g["mean"], g["var"], g["weight"])
        mine = g["labels"]
        pdf["label"], pdf["post"] = rank[mine], np.exp(logs[np.arange(len(x)), mine] - _total(logs))
        pdf["comp_mean"], pdf["comp_var"], pdf["comp_weight"] = g["mean"][mine], g["var"][mine], g["weight"][mine]
        pdf["n_comp"], pdf["aic"], pdf["aic_delta"] = len(g["mean"]), g["aic"], bic_delta(g["tried"], len(g["mean"]))
        return pdf[names]

    return obs.select(*keys, "sample", "mu").groupBy(*keys).applyInPandas(of, schema)


def complete_linkage(distance: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers of complete linkage at ``cut``, numbered by their first member; ties take the first pair.

    The nearest cluster after each one is kept, so a merge costs a row and
    not the matrix.
    """
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    nearest = np.array([i + 1 + int(d[i, i + 1 :].argmin()) if i + 1 < n else i for i in range(n)])
    best = d[np.arange(n), nearest] if n else np.zeros(0)
    group = np.arange(n)
    while n > 1:
        i = int(best.argmin())
        if best[i] > cut or not np.isfinite(best[i]):
            break
        j = int(nearest[i])
        far = np.maximum(d[i], d[j])
        d[i], d[:, i] = far, far
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        alive[j], best[j] = False, np.inf
        group[group == j] = i
        for k in np.flatnonzero(alive & ((nearest == i) | (nearest == j) | (np.arange(n) == i))):
            if k + 1 < n:
                nearest[k] = k + 1 + int(d[k, k + 1 :].argmin())
                best[k] = d[k, nearest[k]]
    return np.unique(group, return_inverse=True)[1]


def reciprocal_distance(start: np.ndarray, end: np.ndarray, max_dif: float | None = None, max_frac_uniq: float | None = None, other_start: np.ndarray | None = None, other_end: np.ndarray | None = None) -> np.ndarray:
    """1 - reciprocal overlap of all pairs, or of all with each of the others."""
    z, e = (start, end) if other_start is None else (other_start, other_end)
    o = np.maximum(np.minimum(end[:, None], e) - np.maximum(start[:, None], z), 0)
    # the longer one's share is the lesser; without an overlap any length will do
    longer = np.maximum((end - start)[:, None], e - z)
    r = o / np.maximum(longer, 1)
    if max_dif is not None:
        r[longer - o > max_dif] = 0.0
    if max_frac_uniq is not None:
        r[1 - r >= max_frac_uniq] = 0.0
    return 1 - r


#: Distinct intervals from which on a cluster's linkage sweeps instead of holding one matrix, intervals that the sweep takes at a time, and pairs looked at at once.
DENSE, BLOCK, PAIRS_AT_ONCE = 1_500, 256, 1 << 18
#: Points of a tile of a large overlap cluster, and neighbouring tiles whose borders meet in the next round.
TILE_POINTS, FAN_IN = 40_000, 8


def neighbour_pairs(start: np.ndarray, end: np.ndarray, cut: float, max_dif: float | None = None, max_frac_uniq: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j of intervals (in order of start) that are at most ``cut`` apart, with their distances.

    Intervals that do not overlap are 1 apart; those are left to the caller.
    What a pair of rows overlaps follows from a search among the starts, so
    only overlapping pairs are looked at, PAIRS_AT_ONCE of them at a time.
    """
    last = np.searchsorted(start, end, "left")
    count = np.maximum(last - np.arange(len(start)) - 1, 0)
    total, found, lo = np.append(0, np.cumsum(count)), [], 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS_AT_ONCE, "right")) - 1)
        i = np.repeat(np.arange(lo, hi), count[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(total[lo:hi] - total[lo], count[lo:hi])
        o = np.minimum(end[i], end[j]) - np.maximum(start[i], start[j])
        a, b = (end - start)[i].astype(float), (end - start)[j].astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(o > 0, np.minimum(o / a, o / b), 0.0)
        if max_dif is not None:
            r[np.maximum(a - o, b - o) > max_dif] = 0.0
        if max_frac_uniq is not None:
            r[1 - r >= max_frac_uniq] = 0.0
        near = 1 - r <= cut
        found.append((i[near], j[near], 1 - r[near]))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def sparse_linkage(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, cut: float) -> np.ndarray:
    """Complete linkage of ``n`` points of which only pairs within ``cut`` are given, numbered like :func:`complete_linkage`.

    A cluster keeps the distances to those clusters all of whose members are
    near all of its own; a merge keeps what both have.  Lists only shrink, so
    memory is that of the given pairs.
    """
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, x in zip(i.tolist(), j.tolist(), d.tolist(), strict=True):
        near[a][b] = near[b][a] = x
    queue = [(x, a, b) for a, b, x in zip(i.tolist(), j.tolist(), d.tolist(), strict=True)]
    heapq.heapify(queue)
    into = list(range(n))
    while queue:
        x, a, b = heapq.heappop(queue)
        if x > cut:
            break
        if near[a].get(b) != x or into[a] != a or into[b] != b:
            continue
        gone, mine = near[b], near[a]
        into[b], near[b] = a, {}
        for k in gone:
            near[k].pop(b, None)
        mine.pop(b, None)
        for k in list(mine):
            other = gone.get(k)
            if other is None:
                del mine[k], near[k][a]
            elif other > mine[k]:
                mine[k] = near[k][a] = other
                heapq.heappush(queue, (other, min(a, k), max(a, k)))
    for k in range(n):
        into[k] = into[into[k]]
    return np.unique(into, return_inverse=True)[1]


def cluster_distances(start: np.ndarray, end: np.ndarray, rows: list[np.ndarray], cols: list[np.ndarray], max_dif: float | None = None, max_frac_uniq: float | None = None) -> np.ndarray:
    """The largest distance between members of any of ``rows`` and any of ``cols``, lists of members; PAIRS_AT_ONCE pairs at a time."""
    held, here = np.concatenate(rows), np.concatenate(cols)
    step, out = max(1, PAIRS_AT_ONCE // len(held)), []
    first = np.cumsum([0] + [len(m) for m in rows[:-1]])
    for lo in range(0, len(here), step):
        some = here[lo : lo + step]
        d = reciprocal_distance(start[held], end[held], max_dif, max_frac_uniq, start[some], end[some])
        out.append(d if len(rows) == len(held) else np.maximum.reduceat(d, first, axis=0))
    wide = np.concatenate(out, axis=1)
    return wide if len(cols) == len(here) else np.maximum.reduceat(wide, np.cumsum([0] + [len(m) for m in cols[:-1]]), axis=1)


def partial_linkage(
    start: np.ndarray, end: np.ndarray, cut: float, max_dif: float | None = None, max_frac_uniq: float | None = None, block: int = BLOCK, group: np.ndarray | None = None, low: float = -np.inf, high: float = np.inf
) -> tuple[np.ndarray, np.ndarray]:
    """Complete linkage of distinct intervals in order of (start, end), ``cut`` below 1, as far as it goes without those that are not here.

    Gives each interval its cluster's first member, and whether that cluster
    is final.  Those not here end by ``low`` or begin from ``high`` on;
    ``group`` has the first members of clusters that are known already.

    Clusters that are nearest to each other (by distance, then by first
    members) merge in the one merged order or any other: a merge brings no
    cluster nearer to a third one.  So about ``block`` intervals are taken at a
    time, and two such clusters merge once all that can overlap them is there.
    A cluster that has nothing near is settled and leaves; memory is the square
    of those that overlap the place reached, not the pairs of the whole.
    """
    n = len(start)
    into, final = np.arange(n) if group is None else group.copy(), np.zeros(n, bool)
    order = np.argsort(into, kind="stable")
    firsts, begin = np.unique(into[order], return_index=True)
    parts, sizes = np.split(order, begin[1:]), np.append(begin, n)
    rep = nearest = np.zeros(0, int)
    least = reach = np.zeros(0, end.dtype)
    members: list[np.ndarray] = []
    d, gap, stuck = np.zeros((0, 0)), np.zeros(0), np.zeros(0, bool)
    lo = 0
    while lo < len(firsts):
        old = len(rep)
        # more at a time where many are held, whose square is copied
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + max(block, old // 6), "right")) - 1)
        new = parts[lo:hi]
        rep, members = np.concatenate([rep, firsts[lo:hi]]), [*members, *new]
        k = np.arange(len(rep))
        least = np.concatenate([least, [end[m].min() for m in new]])
        # a cluster with a member that ends before all of the new ones is 1 apart from them
        meets = np.flatnonzero(least > start[firsts[lo]])
        wide = np.ones((len(rep), hi - lo))
        if len(meets):
            wide[meets] = cluster_distances(start, end, [members[a] for a in meets.tolist()], new, max_dif, max_frac_uniq)
        wide[k[old:], k[old:] - old] = np.inf
        grown = np.empty((len(rep), len(rep)))
        grown[:old, :old], grown[:, old:], grown[old:, :old] = d, wide, wide[:old].T
        d = grown
        # of equal distances the first: what was here before stays nearest
        far = wide.argmin(1)
        nearer = wide[k, far]
        nearest = np.concatenate([np.where(nearer[:old] < gap, far[:old] + old, nearest), d[old:].argmin(1)])
        gap = d[k, nearest]
        reach = np.concatenate([reach, [end[m].max() for m in new]])
        ahead = start[firsts[hi]] if hi < len(firsts) else high
        known, alive = start[rep] >= low, np.ones(len(rep), bool)
        stuck = np.concatenate([stuck, ~known[old:]])
        while True:
            # what is at most as far as the cut and has all its neighbours here
            ready = (gap <= cut) & ~stuck & (reach <= ahead) & alive
            i = np.flatnonzero(ready & ready[nearest] & (nearest[nearest] == k) & (k < nearest))
            if not len(i):
                break
            j = nearest[i]
            both = np.maximum(d[i], d[j])
            both[:, i] = np.maximum(both[:, i], both[:, j])
            d[i], d[:, i] = both, both.T
            d[j], d[:, j], d[i, i], alive[j] = np.inf, np.inf, np.inf, False
            reach[i], least[i] = np.maximum(reach[i], reach[j]), np.minimum(least[i], least[j])
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                members[a] = np.concatenate([members[a], members[b]])
            touched = np.zeros(len(rep), bool)
            touched[i] = touched[j] = True
            again = np.flatnonzero(alive & (touched | touched[nearest]))
            nearest[again] = d[again].argmin(1)
            gap[again] = d[again, nearest[again]]
        here = alive & (reach <= ahead)
        # what is nearest to one that may have a nearer one elsewhere waits with it, and leaves once nothing else is near
        while (more := here & (gap <= cut) & stuck[nearest] & ~stuck).any():
            stuck |= more
        settled = here & (gap > cut) & ~stuck
        gone = here & stuck
        gone[gone] = ~(d[np.ix_(gone, alive & ~stuck & ~settled)] <= cut).any(1)
        for a in np.flatnonzero(settled | gone).tolist():
            into[members[a]], final[members[a]] = rep[a], settled[a]
        stay = np.flatnonzero(alive & ~settled & ~gone)
        place = np.zeros(len(rep), int)
        place[stay] = np.arange(len(stay))
        # what lay nearest to one that stays may have left, if it is beyond the cut or that one waits
        rep, members, d = rep[stay], [members[a] for a in stay.tolist()], d[np.ix_(stay, stay)]
        lost = (settled | gone)[nearest[stay]]
        least, reach, stuck = least[stay], reach[stay], stuck[stay]
        nearest, gap = place[nearest[stay]], gap[stay]
        if lost.any():
            nearest[lost] = d[lost].argmin(1)
            gap = d[np.arange(len(rep)), nearest]
        lo = hi
    for a, m in zip(rep.tolist(), members, strict=True):
        into[m] = a
    return into, final


def swept_linkage(start: np.ndarray, end: np.ndarray, cut: float, max_dif: float | None = None, max_frac_uniq: float | None = None, block: int = BLOCK) -> np.ndarray:
    """Complete linkage of distinct intervals in order of (start, end), ``cut`` below 1, numbered like :func:`complete_linkage`; see :func:`partial_linkage`."""
    return np.unique(partial_linkage(start, end, cut, max_dif, max_frac_uniq, block)[0], return_inverse=True)[1]


def interval_linkage(start: np.ndarray, end: np.ndarray, cut: float, max_dif: float | None = None, max_frac_uniq: float | None = None) -> np.ndarray:
    """Complete linkage of distinct intervals in order of start by reciprocal overlap: on one matrix for few of them, by a sweep for many."""
    if len(start) <= DENSE or cut >= 1:
        return complete_linkage(reciprocal_distance(start, end, max_dif, max_frac_uniq), cut)
    return swept_linkage(start, end, cut, max_dif, max_frac_uniq)


def tiled_linkage(points: DataFrame, own: list[str], cut: float, max_dif: float | None = None, max_frac_uniq: float | None = None) -> DataFrame:
    """``own, start, end, sub`` of the distinct intervals of large overlap clusters ``own``: no task holds a whole one.

    A tile of TILE_POINTS is linked by :func:`partial_linkage` as far as it
    goes alone.  What is not final, at the borders, meets that of FAN_IN
    neighbouring tiles in the next round, and so on up to the whole cluster.
    """
    at = [*own, "start", "end"]
    numbered = running_count(points, own, ["start", "end"], "start", F.lit(True), "_rank")
    tile = F.floor((F.col("_rank") - 1) / TILE_POINTS).alias("_tile")
    left = written(numbered.select(*at, tile, F.col("start").alias("_s"), F.col("end").alias("_e")), "tiles")
    bounds = written(left.groupBy(*own, "_tile").agg(F.min("start").alias("_from"), F.max("end").alias("_to")), "bounds")
    tiles, longest = bounds.agg(F.count("*"), F.max("_tile") + 1).first()
    types = {f.name: f.dataType.simpleString() for f in left.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in [*at, "_tile", "_s", "_e"]) + ", _final boolean"

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end"], kind="stable").reset_index(drop=True)
        start, end = pdf["start"].to_numpy(np.int64), pdf["end"].to_numpy(np.int64)
        # (_s, _e) is the first member of the cluster that a point is in so far, and is here with it
        group = pd.Series(np.arange(len(pdf))).groupby([pdf["_s"], pdf["_e"]], sort=False).transform("min").to_numpy()
        into, final = partial_linkage(start, end, cut, max_dif, max_frac_uniq, group=group, low=int(pdf["_low"][0]), high=int(pdf["_high"][0]))
        return pdf.assign(_s=start[into], _e=end[into], _final=final)[[*at, "_tile", "_s", "_e", "_final"]]

    width, found = 1, None
    order = Window.partitionBy(*own).orderBy("_group")
    before, lowest, highest = order.rowsBetween(Window.unboundedPreceding, -1), F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    while True:
        group = F.floor(F.col("_tile") / width).alias("_group")
        b = bounds.groupBy(*own, group).agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
        b = b.select(*own, "_group", F.coalesce(F.max("_to").over(before), lowest).alias("_low"), F.coalesce(F.lead("_from").over(order), highest).alias("_high"))
        meeting = left.withColumn("_group", group).join(b, [*own, "_group"]).repartition(max(1, min(MOST_TASKS, tiles // width)), *own, "_group")
        linked = written(meeting.groupBy(*own, "_group").applyInPandas(of, schema), "linked")
        final = linked.where("_final").select(*at, "_s", "_e")
        found = final if found is None else found.unionByName(final)
        if width >= longest:
            break
        left, width = linked.where("NOT _final").drop("_final"), width * FAN_IN
    firsts = found.where((F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e"))).select(*at)
    number = running_count(firsts, own, ["start", "end"], "start", F.lit(True), "_no").select(*own, F.col("start").alias("_s"), F.col("end").alias("_e"), (F.col("_no") - 1).cast("int").alias("sub"))
    return found.join(number, [*own, "_s", "_e"]).select(*at, "sub")


def linkage_clusters(clustered: DataFrame, keys: list[str], cut: float = 0.85, max_dif: float | None = None, max_frac_uniq: float | None = None, carried: tuple[str, ...] = ("call_id",)) -> DataFrame:
    """Sub-clusters (``sub``) of each overlap cluster by complete linkage on reciprocal overlap; columns ``carried`` come through.

    Equal intervals are one point of the linkage (their distance is 0), and
    only points go to its tasks.  A cluster of up to DENSE points costs their
    square, a larger one is swept by :func:`swept_linkage`, and one of more
    than TILE_POINTS is dealt over tasks by :func:`tiled_linkage`.
    """
    own = [*keys, "cluster_no"]
    cols, at = [*own, *carried, "start", "end"], [*own, "start", "end"]
    c = written(clustered.select(*cols).dropna(subset=at), "clustered")  # read several times
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.select(*at).schema) + ", sub int"
    points = written(c.select(*at).distinct(), "points")
    sizes = written(points.groupBy(*own).agg(F.count("*").alias("_size")), "sizes")
    large = F.col("_size") > TILE_POINTS if cut < 1 else F.lit(False)
    sized = points.join(sizes, own)
    alone = sized.where("_size = 1").select(*at, F.lit(0).alias("sub"))
    # small clusters share a task call: a bucket holds about PER_TASK points unless one cluster is larger
    n, most = sizes.agg(F.sum("_size"), F.max("_size")).first()
    buckets = max(1, (n or 0) // PER_TASK)
    many = sized.where((F.col("_size") > 1) & ~large).select(*at, F.pmod(F.xxhash64(*own), F.lit(buckets)).alias("_bucket"))

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable").reset_index(drop=True)
        number = pdf.groupby(own, sort=False).ngroup().to_numpy()
        cuts = np.flatnonzero(np.diff(number)) + 1
        spans = pdf[["start", "end"]].to_numpy(np.int64)
        sub = [interval_linkage(p[:, 0], p[:, 1], cut, max_dif, max_frac_uniq) for p in np.split(spans, cuts)]
        return pdf.assign(sub=np.concatenate(sub).astype(np.int32))[[*at, "sub"]]

    # dealt by number, else a few small partitions would be put into one task
    found = alone.unionByName(many.repartition(min(buckets, MOST_TASKS), "_bucket").groupBy("_bucket").applyInPandas(of, schema))
    if cut < 1 and (most or 0) > TILE_POINTS:
        found = found.unionByName(tiled_linkage(sized.where(large).select(*at), own, cut, max_dif, max_frac_uniq))
    return c.join(found, at).select(*cols, "sub")


def correlated_breaks(wide: np.ndarray, w: np.ndarray, at: list[int], cutoff=None) -> list[int]:
    """Breakpoints that are left when neighbouring segments of samples x windows merge as long as any pair correlates beyond the cut-off.

    ``cutoff`` takes the smaller mean of each pair; NaN correlations never
    merge.  The outer breakpoints stay.
    """
    cutoff = cutoff or (lambda x: np.minimum(0.9 / x**0.6 + 0.5, 0.9))
    # sums and counts from one break to the next: segments of later rounds add up
    first = np.searchsorted(w, at)
    known = np.isfinite(wide)
    total = np.stack([np.where(known[:, a:z], wide[:, a:z], 0).sum(1) for a, z in pairwise(first)]) if len(at) > 1 else np.zeros((0, len(wide)))
    n = np.stack([known[:, a:z].sum(1) for a, z in pairwise(first)]) if len(at) > 1 else np.zeros((0, len(wide)))
    return merged_breaks(total, n, at, cutoff)


def merged_breaks(total: np.ndarray, n: np.ndarray, at: list[int], cutoff) -> list[int]:
    """The same from each segment's sums and counts by sample (segments x samples)."""
    at = list(at)
    while len(at) > 2:
        with np.errstate(all="ignore"):
            m = np.where(n > 0, total / n, np.nan)
            r = np.array([np.corrcoef(p, q)[0, 1] for p, q in pairwise(m)])
            x = np.array([np.nanmean(row) if np.isfinite(row).any() else np.nan for row in m])
            cut = cutoff(np.minimum(x[:-1], x[1:]))
            go, drop = r > cut, np.abs(r) >= cut
        if not go.any():
            break
        starts = np.concatenate([[0], np.flatnonzero(~drop) + 1])
        total, n = np.add.reduceat(total, starts), np.add.reduceat(n, starts)
        at = [at[i] for i in starts] + [at[-1]]
    return at


def correlated_segments(cells: DataFrame, breaks: DataFrame) -> DataFrame:
    """Repeat correlated merging until no neighbouring segments exceed the cut-off: ``locus, w0, w1``.

    ``cells(locus, sample, w, cp)``, ``breaks(locus, at)`` with at an array of
    window ordinals.  Windows are summed by segment and sample where they
    are; a locus' task gets segments x samples only.
    """
    b = breaks.select("locus", F.array_sort(F.array_distinct("at")).alias("at"))
    spans = b.select("locus", F.posexplode(F.arrays_zip(F.slice("at", F.lit(1), F.size("at") - 1).alias("a"), F.slice("at", F.lit(2), F.size("at") - 1).alias("z"))).alias("i", "s"))
    spans = spans.select("locus", "i", F.col("s.a").cast("long").alias("a"), F.col("s.z").cast("long").alias("z"))
    windows = spans.select(F.col("locus").alias("_locus"), F.col("i").alias("seg"), F.explode(F.sequence("a", F.col("z") - 1)).alias("_w"))
    held = cells.select("locus", "sample", "w", "cp").join(windows, (F.col("locus") == F.col("_locus")) & (F.col("w") == F.col("_w")))
    sums = held.groupBy("locus", "seg", "sample").agg(F.sum("cp").alias("total"), F.count("cp").alias("n"))

    def of(key, s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if s.empty or p.empty:
            return pd.DataFrame({"locus": [], "w0": [], "w1": []})
        p = p.sort_values("i")
        names = np.sort(s["sample"].unique())
        at = [*p.a.tolist(), int(p.z.iat[-1])]
        total, n = np.zeros((len(p), len(names))), np.zeros((len(p), len(names)))
        row, col = s.seg.to_numpy(), np.searchsorted(names, s["sample"].to_numpy())
        total[row, col], n[row, col] = s.total, s.n
        at = merged_breaks(total, n, at, lambda x: np.minimum(0.9 / x**0.6 + 0.5, 0.9))
        return pd.DataFrame({"locus": key[0], "w0": at[:-1], "w1": at[1:]})

    named = spans.select(F.col("locus").alias("of_locus"), F.col("i").alias("i"), F.col("a").alias("a"), F.col("z").alias("z"))
    return sums.groupBy("locus").cogroup(named.groupBy("of_locus")).applyInPandas(of, "locus string, w0 long, w1 long")
