"""Many Gaussian scales of a track in one pass.

A tile with its halo is transformed once; each scale's smoothed value and
derivatives are products in the frequency domain, so the work for a window and
scale does not grow with the scale's width.  The kernels are the sampled,
truncated ones of :func:`windrow.operators.tracks.gaussian_kernel`, not
approximations: what differs from the sums of products is rounding, less than
``ERROR`` times the tile's largest value times the kernel's absolute sum times
the binary logarithm of the tile's length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from windrow.operators.tracks import gaussian_kernel, mirrored_tiles

#: Places of a tile at least, and the bound on rounding.
TILE, ERROR = 8_192, 1e-13


def correlations(x: np.ndarray, kernels: list[np.ndarray]) -> list[np.ndarray]:
    """Valid correlations of ``x`` with kernels of odd length, all from one transform of ``x``."""
    longest = max(len(k) for k in kernels)
    size = 1 << (len(x) + longest - 1).bit_length()
    f = np.fft.rfft(x, size)
    return [np.fft.irfft(f * np.conj(np.fft.rfft(k, size)), size)[: len(x) - len(k) + 1] for k in kernels]


def scale_space(track: DataFrame, keys: list[str], sigmas: list[float], tile: int = TILE) -> DataFrame:
    """``keys, sigma, w, g0, g1, g2`` of a dense ``track(keys, w, cp)``: smoothed value and first two derivatives at every scale, mirrored at the edges.

    One exchange serves all scales: a window travels to its own tile and to
    those whose halo, the radius of the widest kernel, it is in.  Tiles have
    at least four such radii, so at most half as many rows again are copied.
    """
    kernels = [(float(s), [np.array(c, float) for c in zip(*gaussian_kernel(s), strict=True)][1:]) for s in sigmas]
    radius = max(len(k[0]) // 2 for _, k in kernels)
    tile = max(tile, 4 * radius)
    placed = mirrored_tiles(track, keys, radius, tile)

    def of(key, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("at")
        x, first, n = p.cp.to_numpy(float), int(p["at"].iloc[0]), int(p._n.iloc[0])
        lo, hi = max(0, int(key[-1]) * tile), min(n, (int(key[-1]) + 1) * tile)
        if lo >= hi:
            return pd.DataFrame({c: [] for c in names}, dtype=object)
        found = correlations(x, [k for _, own in kernels for k in own])
        out = []
        for i, (sigma, own) in enumerate(kernels):
            at = lo - first - len(own[0]) // 2
            g = [found[3 * i + j][at : at + hi - lo] for j in range(3)]
            out.append(pd.DataFrame({**{k: [v] * (hi - lo) for k, v in zip(keys, key, strict=False)}, "sigma": sigma, "w": np.arange(lo, hi), "g0": g[0], "g1": g[1], "g2": g[2]}))
        return pd.concat(out, ignore_index=True)

    types = {f.name: f.dataType.simpleString() for f in track.schema}
    names = [*keys, "sigma", "w", "g0", "g1", "g2"]
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "sigma double, w long, g0 double, g1 double, g2 double"])
    return placed.select(*keys, "_tile", "_n", "at", "cp").groupBy(*keys, "_tile").applyInPandas(of, schema)
