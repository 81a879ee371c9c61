"""Best path through overlapping calls: of each key, the calls of the largest total score of which no two overlap.

The axis is cut into tiles.  Only calls that cross a border tie tiles together:
a path enters a tile where such a call ends (or at the border) and leaves it
where one starts (or at the next border).  Every tile finds, by dynamic
programming over its own calls and for all entries at once, the best score
between each entry and each exit.  These few numbers and the crossing calls
are a small graph for each key, in which the frontier is carried from tile to
tile; the path found there tells each tile its entry and exit, between which
it then names its calls.  No task holds a whole cluster's calls.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.operators.scan import tile_width

#: Entries of a tile that are followed at once.
ENTRIES = 64
INNER, ENTRY, EXIT = 0, 1, 2


def _table(p: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Starts, ends, scores and ids of a tile's own calls, by end."""
    p = p[p.kind == INNER].sort_values(["b", "a"], kind="stable")
    return p.a.to_numpy(np.int64), p.b.to_numpy(np.int64), p.score.to_numpy(float), p.call_id.to_numpy()


def reached(a: np.ndarray, b: np.ndarray, score: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Best score by number of calls looked at (rows, by end) of paths that begin at each entry (columns) or later."""
    before = np.searchsorted(b, a, "right")
    v = np.zeros((len(a) + 1, len(entries)))
    for i in range(len(a)):
        v[i + 1] = np.maximum(v[i], np.where(a[i] >= entries, score[i] + v[before[i]], -np.inf))
    return v


def _transfer(tile: int) -> callable:
    def of(key, p: pd.DataFrame) -> pd.DataFrame:
        a, b, score, _ = _table(p)
        ends = (int(key[-1]) * tile, int(key[-1]) * tile + tile)
        entries = np.append(ends[0], np.unique(p.a[p.kind == ENTRY].to_numpy(np.int64)))
        exits = np.append(np.unique(p.a[p.kind == EXIT].to_numpy(np.int64)), ends[1])
        rows = np.searchsorted(b, exits, "right")
        best = np.concatenate([reached(a, b, score, entries[i : i + ENTRIES])[rows] for i in range(0, len(entries), ENTRIES)], 1)
        x, y = np.meshgrid(entries, exits)
        ok = x <= y
        return pd.DataFrame({**{c: [k] * int(ok.sum()) for c, k in zip(p.columns, key, strict=False)}, "x": x[ok], "y": y[ok], "best": best[ok]})

    return of


def _carry(names: list[str], tile: int) -> callable:
    """Entry and exit of the path in each tile, and the crossing calls it takes."""

    def of(key, edges: pd.DataFrame, cross: pd.DataFrame) -> pd.DataFrame:
        arrivals: dict[int, list[tuple[int, float, object]]] = {}
        for s, e, w, i in zip(cross.start, cross.end, cross.score, cross.call_id, strict=True):
            arrivals.setdefault(int(e), []).append((int(s), float(w), i))
        left, came, entry, border = {}, {}, {}, 0.0
        tiles = sorted(edges.tile.unique())
        for t, group in edges.groupby("tile", sort=True):
            first, last = int(t) * tile, int(t) * tile + tile
            value = {first: border}
            for x in group.x.unique():
                if x != first:
                    # the calls that end here started in earlier tiles, where their starts are exits
                    s, w, i = max(arrivals[int(x)], key=lambda c: (left[c[0]] + c[1], -c[0]))
                    value[int(x)], came[int(t), int(x)] = left[s] + w, (s, i)
            for x, y, best in zip(group.x, group.y, group.best, strict=True):
                total = value[int(x)] + best
                at = int(y) if y != last else ("border", int(t))
                if at not in left or total > left[at]:
                    left[at], entry[at] = total, int(x)
            border = left["border", int(t)]
        parts, taken = [], []
        previous = {int(b): int(a) for a, b in pairwise(tiles)}
        at = ("border", int(tiles[-1])) if tiles else None
        while at is not None:
            t = at[1] if isinstance(at, tuple) else at // tile
            x, y = entry[at], t * tile + tile if isinstance(at, tuple) else at
            parts.append((t, x, y))
            if (t, x) in came:
                at, call = came[t, x]
                taken.append(call)
            else:
                at = ("border", previous[t]) if t in previous else None
        n = len(parts) + len(taken)
        rows = {k: [v] * n for k, v in zip(names, key, strict=True)}
        filler = cross.call_id.iloc[0] if len(cross) else None
        cols = list(zip(*parts, strict=True)) or [(), (), ()]
        none = [-1] * len(taken)
        return pd.DataFrame({**rows, "tile": [*cols[0], *none], "x": [*cols[1], *none], "y": [*cols[2], *none], "call_id": [filler] * len(parts) + taken, "whole": [False] * len(parts) + [True] * len(taken)}, dtype=object)

    return of


def _named(names: list[str]) -> callable:
    """The calls of a tile on the path from its entry to its exit."""

    def of(key, p: pd.DataFrame, route: pd.DataFrame) -> pd.DataFrame:
        chosen = []
        if len(route):
            a, b, score, ids = _table(p)
            x, y = int(route.x.iloc[0]), int(route.y.iloc[0])
            v = reached(a, b, score, np.array([x]))[:, 0]
            i = int(np.searchsorted(b, y, "right"))
            while i > 0:
                if v[i] > v[i - 1]:
                    chosen.append(ids[i - 1])
                    i = int(np.searchsorted(b, a[i - 1], "right"))
                else:
                    i -= 1
        return pd.DataFrame({**{k: [v] * len(chosen) for k, v in zip(names, key, strict=False)}, "call_id": chosen}, dtype=object)

    return of


def best_path(calls: DataFrame, keys: list[str], tile: int | None = None) -> DataFrame:
    """``keys, call_id`` of the calls ``(keys, call_id, start, end, score)`` on the best path of each key.

    Half-open intervals that touch do not overlap.  Calls of no length,
    without a positive score or with a null in start, end or score are never
    taken; of calls with equal bounds the one of the larger score counts (then
    of the smaller id).  Of paths of equal score any one is given.  An overlap
    cluster's share of the result is its own best path, as clusters do not
    overlap each other.
    """
    types = {f.name: f.dataType.simpleString() for f in calls.schema}
    of_keys, kind_of_id = ", ".join(f"`{k}` {types[k]}" for k in keys), types["call_id"]
    usable = calls.where("`end` > start and score > 0").groupBy(*keys, "start", "end").agg(F.min(F.struct((-F.col("score")).cast("double").alias("m"), F.col("call_id"))).alias("b"))
    c = usable.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (-F.col("b.m")).alias("score"), F.col("b.call_id").alias("call_id")).persist()
    tile = tile or tile_width(c, keys, "start")
    first, last = F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile)
    cross = c.where(first < last)
    no_call, zero = F.lit("0").cast(kind_of_id).alias("call_id"), F.lit(0).cast("long")
    port = lambda t, at, kind: cross.select(*keys, t.cast("long").alias("tile"), F.lit(kind).alias("kind"), F.col(at).alias("a"), zero.alias("b"), F.lit(0.0).alias("score"), no_call).distinct()
    rows = c.where(first == last).select(*keys, first.cast("long").alias("tile"), F.lit(INNER).alias("kind"), F.col("start").alias("a"), F.col("end").alias("b"), "score", "call_id")
    rows = rows.union(port(last, "end", ENTRY)).union(port(first, "start", EXIT))
    edges = rows.groupBy(*keys, "tile").applyInPandas(_transfer(tile), f"{of_keys}, tile long, x long, y long, best double")
    route = edges.groupBy(*keys).cogroup(cross.groupBy(*keys)).applyInPandas(_carry(keys, tile), f"{of_keys}, tile long, x long, y long, call_id {kind_of_id}, whole boolean").persist()
    inner = rows.groupBy(*keys, "tile").cogroup(route.where("not whole").groupBy(*keys, "tile")).applyInPandas(_named(keys), f"{of_keys}, call_id {kind_of_id}")
    return inner.union(route.where("whole").select(*keys, "call_id"))
