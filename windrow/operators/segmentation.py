"""Multi-scale segmentation of tracks, one grouped Arrow task per contig and sample.

Contour tracing visits cells destructively and merging always takes the
globally smallest step, so both are sequential within a contig; everything
before and after them is relational.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.operators.tracks import gaussian_kernel


def mirrored(x: np.ndarray, r: int) -> np.ndarray:
    """Edge reflection (d c b a | a b c d | d c b a), folded as often as needed."""
    n = len(x)
    i = np.arange(-r, n + r) % (2 * n)
    return x[np.where(i < n, i, 2 * n - 1 - i)]


def derivatives(x: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second Gaussian derivative."""
    _, _, k1, k2 = (np.array(c, float) for c in zip(*gaussian_kernel(sigma), strict=True))
    y = mirrored(x, len(k1) // 2)
    return np.correlate(y, k1, "valid"), np.correlate(y, k2, "valid")


def edge_positions(g1: np.ndarray, g2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of kept sign changes; see :func:`windrow.operators.tracks.edges`."""
    n, s = len(g2), np.sign(g2)
    cut = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1, [n - 1]]))
    keep = len(cut) if len(cut) == n else min(len(cut), n - len(cut))
    best = cut[np.lexsort((cut, -np.abs(g1[cut])))[:keep]]
    best = np.sort(best[s[best] != 0])
    return best, s[best].astype(int)


class _Level:
    """Unvisited cells of one scale by sign, in order."""

    def __init__(self, where: np.ndarray, sign: np.ndarray):
        self.by = {q: where[sign == q].tolist() for q in (-1, 1)}

    def nearest(self, sign: int, x: int) -> tuple[int, int]:
        """Distance to the nearest cell at or left of x, and at or right of it."""
        cells, far = self.by[sign], 1 << 60
        i = bisect_left(cells, x)
        right = cells[i] - x if i < len(cells) else far
        if right == 0:
            return 0, 0
        return (x - cells[i - 1] if i else far), right

    def visit(self, sign: int, x: int) -> None:
        cells = self.by[sign]
        i = bisect_left(cells, x)
        if i < len(cells) and cells[i] == x:
            del cells[i]


def contours(levels: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """(position at scale 0, largest scale index that leads there) of every contour.

    From each cell of the scales above index 1, largest first and left to
    right, the nearest cell of the same sign one scale below follows (left
    before right), down to scale 0; reaching a border of the track first ends
    the contour there.  Cells are used once.
    """
    state = [_Level(np.asarray(w), np.asarray(s)) for w, s in levels]
    seen: dict[int, int] = {}
    for top in range(len(state) - 1, 1, -1):
        for x0, sign in sorted([(x, q) for q in (-1, 1) for x in state[top].by[q]]):
            if x0 not in state[top].by[sign]:
                continue
            x, scale = x0, top
            while scale:
                state[scale].visit(sign, x)
                left, right = state[scale - 1].nearest(sign, x)
                step = min(left, right, x, n - 1 - x)
                if step == x:
                    x, scale = 0, 0
                elif step == n - 1 - x:
                    x, scale = n - 1, 0
                else:
                    x += -left if left == step else right
                    scale -= 1
            seen.setdefault(x, top)
    return sorted(seen.items())


def merged_segments(x: np.ndarray, edges: np.ndarray, max_merge: float = 0.5, use_means: bool = False) -> list[tuple[int, int, float]]:
    """(start, end, value) after dropping, smallest first, inner edges whose sides differ by less than ``max_merge``.

    The value is the median (or mean) between two edges; of equal steps the
    leftmost edge goes first.  Stale heap entries are skipped.
    """
    stat = np.mean if use_means else np.median
    edges = np.unique(edges).astype(int)
    if len(edges) < 2:
        return []
    k = len(edges)
    value = [float(stat(x[a:b])) if b > a else float("nan") for a, b in zip(edges[:-1], edges[1:], strict=True)]
    before, after, alive, version = list(range(-1, k - 1)), list(range(1, k + 1)), [True] * k, [0] * k
    heap = [(abs(value[i] - value[i - 1]), int(edges[i]), i, 0) for i in range(1, k - 1)]
    heapq.heapify(heap)
    while heap and heap[0][0] < max_merge:
        _, _, i, v = heapq.heappop(heap)
        if not alive[i] or v != version[i]:
            continue
        a, b = before[i], after[i]
        alive[i] = False
        after[a], before[b] = b, a
        value[a] = float(stat(x[edges[a] : edges[b]]))
        for j in (a, b):
            if 0 < j < k - 1:
                version[j] += 1
                heapq.heappush(heap, (abs(value[j] - value[before[j]]), int(edges[j]), j, version[j]))
    out, i = [], 0
    while after[i] < k:
        out.append((int(edges[i]), int(edges[after[i]]), value[i]))
        i = after[i]
    return out


def smoothed(x: np.ndarray, times: int) -> np.ndarray:
    """Binomial smoothing [1, 2, 1] / 4, mirrored at the edges."""
    for _ in range(times):
        y = mirrored(x, 1)
        x = (y[:-2] + 2 * y[1:-1] + y[2:]) / 4
    return x


def scale_space(x: np.ndarray, n_scales: int = 51, scale_width: float = 1.0, collapsed: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (positions, signs) at every scale; the sign is -1 throughout if ``collapsed``."""
    out = []
    for k in range(1, n_scales):
        where, sign = edge_positions(*derivatives(x, k * scale_width))
        out.append((where, np.full(len(where), -1) if collapsed else sign))
    return out


def segment_signal(x: np.ndarray, n_scales: int = 51, scale_width: float = 1.0, cutoff_scale: int = 5, max_merge: float = 0.5, use_means: bool = False, smoothings: int = 0, collapsed: bool = True) -> list[tuple[int, int, float]]:
    """Segments of one signal: scale space, contours that reach ``cutoff_scale``, hierarchical merge."""
    if len(x) < 3:
        return [(0, len(x), float(np.median(x)))] if len(x) else []
    levels = scale_space(smoothed(x, smoothings), n_scales, scale_width, collapsed)
    kept = [p for p, top in contours(levels, len(x)) if top >= cutoff_scale]
    return merged_segments(x, np.array([0, *kept, len(x)]), max_merge, use_means)


def contour_rows(track: DataFrame, keys: list[str], n_scales: int = 21, collapsed: bool = True) -> DataFrame:
    """``keys, w, scale``: contour ends and the largest scale that leads to each."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in track.select(*keys).schema) + ", w long, scale int"

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("w")
        found = contours(scale_space(pdf.cp.to_numpy(float), n_scales, 1.0, collapsed), len(pdf))
        out = pd.DataFrame({"w": [pdf.w.iat[p] for p, _ in found], "scale": [s for _, s in found]})
        for k in keys:
            out[k] = pdf[k].iat[0]
        return out[[*keys, "w", "scale"]]

    return track.groupBy(*keys).applyInPandas(of, schema)


def segments(track: DataFrame, keys: list[str], **options) -> DataFrame:
    """``keys, w0, w1, start, end, value, n``: segments of each track; options as :func:`segment_signal`."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in track.select(*keys).schema) + ", w0 long, w1 long, start long, end long, value double, n long"

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("w")
        s = segment_signal(pdf.cp.to_numpy(float), **options)
        out = pd.DataFrame(
            {
                "w0": [pdf.w.iat[a] for a, b, _ in s], "w1": [pdf.w.iat[b - 1] + 1 for a, b, _ in s], "start": [pdf.start.iat[a] for a, b, _ in s],
                "end": [pdf.end.iat[b - 1] for a, b, _ in s], "value": [x for *_, x in s], "n": [b - a for a, b, _ in s],
            }
        )
        for k in keys:
            out[k] = pdf[k].iat[0]
        return out[[*keys, "w0", "w1", "start", "end", "value", "n"]]

    return track.groupBy(*keys).applyInPandas(of, schema)


def greedy_merge(x: np.ndarray, edges: np.ndarray, max_merge: float = 0.5) -> list[tuple[int, int, float]]:
    """Left to right: a segment joins the current one while the medians differ by less than ``max_merge``."""
    edges = np.unique(edges).astype(int)
    out: list[tuple[int, int, float]] = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        m = float(np.median(x[a:b]))
        if out and abs(out[-1][2] - m) < max_merge:
            out[-1] = (out[-1][0], int(b), float(np.median(x[out[-1][0] : b])))
        else:
            out.append((int(a), int(b), m))
    return out


def iterative_merge(x: np.ndarray, edges: np.ndarray, max_merge: float) -> np.ndarray:
    """Edges that are left when, over and over, the first inner edge of least difference of medians goes, while that is below ``max_merge``.

    All medians are taken anew each time: the plain form of
    :func:`merged_segments`, for short signals.
    """
    edges = np.unique(edges).astype(int)
    while len(edges) > 2:
        medians = np.array([np.median(x[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        step = np.abs(np.diff(medians))
        i = int(step.argmin())
        if not step[i] < max_merge:
            break
        edges = np.delete(edges, i + 1)
    return edges


def merged_tracks(track: DataFrame, breaks: DataFrame, keys: list[str], max_merge: float, how: str = "heap") -> DataFrame:
    """``keys, w0, w1, value``: segments between given breaks(keys, at) of each track after merging by ``how``: heap, iterative or greedy."""
    types = {f.name: f.dataType.simpleString() for f in track.select(*keys).schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", w0 long, w1 long, value double"
    cols = [*keys, "w0", "w1", "value"]

    def of(key, t: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if t.empty:
            return pd.DataFrame({c: [] for c in cols})
        t = t.sort_values("w")
        x, w = t.cp.to_numpy(float), t.w.to_numpy()
        inner = np.searchsorted(w, [p for at in b["at"] for p in at])
        edges = np.unique(np.concatenate([[0], inner[(inner > 0) & (inner < len(x))], [len(x)]])).astype(int)
        if how == "iterative":
            left = iterative_merge(x, edges, max_merge)
            s = [(a, e, float(np.median(x[a:e]))) for a, e in zip(left[:-1], left[1:], strict=True)]
        else:
            s = (merged_segments if how == "heap" else greedy_merge)(x, edges, max_merge)
        out = pd.DataFrame({"w0": [w[a] for a, *_ in s], "w1": [w[e - 1] + 1 for _, e, _ in s], "value": [v for *_, v in s]})
        for k, v in zip(keys, key, strict=True):
            out[k] = v
        return out[cols]

    b = breaks.select(*(F.col(k).alias(f"_{k}") for k in keys), "at")
    return track.select(*keys, "w", "cp").groupBy(*keys).cogroup(b.groupBy(*(f"_{k}" for k in keys))).applyInPandas(of, schema)


def segment_stats(segs: DataFrame, track: DataFrame, keys: list[str]) -> DataFrame:
    """Adds mean, median and population variance of the windows of each segment."""
    cells = segs.withColumn("w", F.explode(F.sequence("w0", F.col("w1") - 1))).join(track.select(*keys, "w", "cp"), [*keys, "w"])
    return cells.groupBy(*keys, "w0", "w1").agg(F.count("*").alias("n"), F.avg("cp").alias("mean"), F.median("cp").alias("median"), F.var_pop("cp").alias("var"))
