"""Embedding near-dedup: spherical k-means cells, blocked cosine products.

Vectors are normalised in double precision and copies are collapsed.  A
bounded sample fits the centroids of each label; every vector has its home in
the cell of its nearest centroid.  Partners in two cells are on either side of the
plane between the centroids and at most the threshold's chord apart, so one of
them is within half the chord of that plane; a vector that is so near is sent
to the other cell as a guest.  Half the chord is the bound that always holds;
for differences that are spread over many dimensions a bound of ``SIGMAS``
standard deviations is far smaller, and the smaller one is used.

Vectors within half the threshold's angle of their centroid, the core of a
cell, are all linked to each other by the triangle inequality, so a dense
group costs no products within itself: its links are a count.  All other
pairs are compared in blocks of bounded size, block against block, so no task
holds a whole cell; what leaves a block is a number of links for each vector
and a spanning set of edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.shared import connected_components, drop_stored, stored, table

COSINE = 0.93
#: Bytes of the sample that fits the centroids of all labels, and spherical k-means rounds.
SAMPLE_BYTES, ROUNDS = 32 << 20, 8
#: Vectors aimed at in a cell, vectors of a block, and centroids of all labels at most.
CELL, BLOCK, CENTROIDS = 512, 1_024, 4_096
#: Labels that are cut into cells, the largest first; a smaller one is a cell of its own.
LABELS = 1_024
#: Standard deviations of a partner's direction that the bound for guests allows.
SIGMAS = 3.0
#: Allowance for rounding in the bounds on angles.
SLACK = 1e-6
#: Roles in a cell: at home, at home in its core, guest.
HOME, CORE, GUEST = 0, 1, 2


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and cosine of the nearest centroid, over bounded pieces of ``x``."""
    cell, cosine = np.zeros(len(x), np.int64), np.zeros(len(x))
    for at in range(0, len(x), 4_096):
        part = x[at : at + 4_096] @ c.T
        cell[at : at + 4_096], cosine[at : at + 4_096] = part.argmax(1), part.max(1)
    return cell, cosine


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centroids of unit vectors; cells that run empty keep their old centroid."""
    pick = np.random.Generator(np.random.PCG64(seed)).choice(len(x), k, replace=False)
    return _refined(x, x[np.sort(pick)].copy(), rounds)


def _refined(x: np.ndarray, c: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        cell, _ = _nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, cell, x)
        size = np.sqrt((total * total).sum(1))
        ok = size > 1e-12
        c[ok] = total[ok] / size[ok, None]
    return c


def thinned(c: np.ndarray, angle: float) -> np.ndarray:
    """Centroids of which no two are within ``angle``: a dense group shall be one cell, not many that all visit each other."""
    kept: list[int] = []
    for i in range(len(c)):
        if not kept or (c[kept] @ c[i]).max() < np.cos(angle):
            kept.append(i)
    return c[kept].copy()


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes of unit doubles; vectors that link with nothing have null."""
    for batch in batches:
        out = []
        for v, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist(), strict=True):
            x = None if v is None or label is None or not v or any(e is None for e in v) else np.array(v, np.float64)
            if x is not None:
                # one scale first: squares of very large or small components stay finite
                top = np.abs(x).max()
                x = unit((x / top)[None])[0] if np.isfinite(x).all() and top > 0 else None
            out.append(None if x is None else x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "x"])


def _matrix(column) -> np.ndarray:
    rows = [np.frombuffer(b.as_buffer() if hasattr(b, "as_buffer") else b, np.float64) for b in column]
    return np.stack(rows) if rows else np.zeros((0, 1))


def _fit(reps: DataFrame, theta: float) -> dict[tuple[int, int], tuple[np.ndarray, float]]:
    """Centroids by (label, dimension), and how near a plane between two of them guests are."""
    large = reps.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > CELL).orderBy(F.desc("n"), "label", "dim").limit(LABELS).collect()
    total = sum(r["n"] for r in large)
    rows = int(SAMPLE_BYTES // (8 * max((r["dim"] for r in large), default=1)))
    out = {}
    if not large:
        return out
    share = min(1.0, rows / total)
    draw = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    names = reps.sparkSession.createDataFrame([(r["label"], r["dim"]) for r in large], "label long, dim long")
    picked = reps.where(draw).join(F.broadcast(names), ["label", "dim"]).select("label", "dim", "x").limit(2 * rows).toArrow()  # LABELS names; twice the sample at most
    label, dim = (np.asarray(picked[c].to_pylist(), np.int64) for c in ("label", "dim"))
    per = max(CELL, -(-total // CENTROIDS))
    for r in large:
        mine = np.flatnonzero((label == r["label"]) & (dim == r["dim"]))
        k = min(-(-r["n"] // per), len(mine) // 4)
        if k < 2:
            continue
        x = _matrix(picked["x"].take(pa.array(mine)))
        c = _refined(x, thinned(spherical_kmeans(x, k), theta / 3), 2)
        spread = np.linalg.eigvalsh(np.cov(x, rowvar=False))
        held = spread.sum() ** 2 / max((spread * spread).sum(), 1e-300)  # dimensions that the vectors fill
        out[r["label"], r["dim"]] = c, float(np.sin(theta / 2) * min(1.0, SIGMAS / np.sqrt(held))) + SLACK
    return out


def _placed(model, theta: float) -> callable:
    """Each vector at home and in the cells that it visits; ``visits`` names those."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = (np.asarray(batch.column(c).to_pylist(), np.int64) for c in ("label", "dim"))
            home, role = np.zeros(len(label), np.int64), np.zeros(len(label), np.int32)
            visits = [np.zeros(0, np.int64)] * len(label)
            for key, (c, reach) in model.value.items():
                mine = np.flatnonzero((label == key[0]) & (dim == key[1]))
                if not len(mine):
                    continue
                cosine = _matrix(batch.column("x").take(pa.array(mine))) @ c.T
                own = cosine.argmax(1)
                home[mine] = own
                best = cosine[np.arange(len(mine)), own]
                role[mine] = np.where(np.arccos(np.clip(best, -1, 1)) <= theta / 2 - SLACK, CORE, HOME)
                apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-18))
                near = best[:, None] - cosine <= reach * apart[own]
                near[np.arange(len(mine)), own] = False
                for at, row in zip(mine, near, strict=True):
                    visits[at] = np.flatnonzero(row)
            n = np.array([len(v) for v in visits])
            at = np.concatenate([np.arange(len(label)), np.repeat(np.arange(len(label)), n)])
            cell = np.concatenate([home, *visits])
            roles = np.concatenate([role, np.full(n.sum(), GUEST, np.int32)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate([*visits, np.zeros(0, np.int64)]), pa.int64()))
            cols = [batch.column(c).take(pa.array(at)) for c in ("rep", "label", "dim", "copies", "x")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cell), pa.array(home[at]), pa.array(roles), lists.take(pa.array(at))], names=["rep", "label", "dim", "copies", "x", "cell", "home", "role", "visits"])

    return of


_NONE = {"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)}


def _compare(limit: float):
    """Homes outside the core and guests (side 0) against homes (side 1)."""

    def of(block: pd.DataFrame) -> pd.DataFrame:
        left, right = block[block.side == 0].sort_values("rep"), block[block.side == 1].sort_values("rep")
        if left.empty or right.empty:
            return pd.DataFrame(_NONE)
        a, b = left.rep.to_numpy(), right.rep.to_numpy()
        near = _matrix(left.x) @ _matrix(right.x).T >= limit
        near &= a[:, None] != b[None, :]
        rows, cols = near.any(1), near.any(0)
        left, right, a, b, near = left[rows], right[cols], a[rows], b[cols], near[np.ix_(rows, cols)]
        if not len(a):
            return pd.DataFrame(_NONE)
        # a pair that visits both ways is counted in the cell of the smaller number
        counted, cell, guest = near.copy(), int(block.cell.iloc[0]), left.role.to_numpy() == GUEST
        came = np.where(guest, left.home.to_numpy(), cell)
        for other in np.unique(came[came < cell]):
            there = np.array([other in v for v in right.visits])
            counted[np.ix_(came == other, there)] = False
        counted = counted.astype(np.float64)
        n_left, n_right = (z.copies.to_numpy().astype(np.float64) for z in (left, right))
        to_left = counted @ n_right
        # two homes outside the core meet twice, once on either side; all others meet once
        to_right = n_left[guest] @ counted[guest] + np.where(right.role.to_numpy() == CORE, n_left[~guest] @ counted[~guest], 0)
        # spanning edges of the block's bipartite graph: least partner of each side, and through shared partners
        name_l, name_r = a.copy(), b.copy()
        big = np.iinfo(np.int64).max
        while True:
            new_l = np.minimum(name_l, np.where(near, name_r[None, :], big).min(1))
            new_r = np.minimum(name_r, np.where(near, new_l[:, None], big).min(0))
            if (new_l == name_l).all() and (new_r == name_r).all():
                break
            name_l, name_r = new_l, new_r
        return pd.DataFrame({"rep": np.concatenate([a, b]), "links": np.rint(np.concatenate([to_left, to_right])).astype(np.int64), "other": np.concatenate([name_l, name_r])})

    return of


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors link when their labels are equal and not null and their cosine in
    double precision reaches ``cosine``; a partner in another cell whose
    direction is beyond ``SIGMAS`` may be missed.  A vector that is null, empty, zero,
    or holds null or non-finite components links with nothing, and neither
    does a row with a null vec_id.  Vectors of different lengths do not link.
    Rows with one vec_id are separate vectors of one node.  Other columns are
    not read.
    """
    sc = vectors.sparkSession.sparkContext
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    clean = stored(plain.mapInArrow(_clean, "vec_id long, label long, x binary"), "vectors")
    same = ["label", "x"]
    usable = clean.where("x is not null and vec_id is not null")
    reps = stored(usable.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", (F.length("x") / 8).cast("long")), "reps")
    theta = float(np.arccos(np.clip(cosine, -1, 1)))
    model = sc.broadcast(_fit(reps, theta))  # CENTROIDS and one more for each of LABELS at most
    schema = "rep long, label long, dim long, copies long, x binary, cell long, home long, role int, visits array<long>"
    placed = stored(reps.withColumn("dim", F.col("dim").cast("long")).mapInArrow(_placed(model, theta), schema), "placed")
    key = ["label", "dim", "cell"]
    blocks = lambda of: F.ceil(F.count_if(of) / BLOCK).cast("long")
    sizes = placed.groupBy(*key).agg(blocks(F.col("role") != CORE).alias("lefts"), blocks(F.col("role") != GUEST).alias("rights")).where("lefts > 0 and rights > 0")
    spread = F.xxhash64("rep")
    rows = placed.join(stored(sizes, "cells"), key)
    left = rows.where(F.col("role") != CORE).withColumn("i", F.pmod(spread, "lefts")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rights") - 1))).withColumn("side", F.lit(0))
    right = rows.where(F.col("role") != GUEST).withColumn("j", F.pmod(spread, "rights")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1))).withColumn("side", F.lit(1))
    cols = [*key, "i", "j", "side", "rep", "copies", "x", "home", "role", "visits"]
    pairs = left.select(cols).union(right.select(cols)).groupBy(*key, "i", "j").applyInPandas(_compare(cosine), "rep long, links long, other long")
    core = placed.where(F.col("role") == CORE)
    centre = core.groupBy(*key).agg(F.sum("copies").alias("all"), F.min("rep").alias("other"))
    dense = core.select(*key, "rep", "copies").join(centre, key).select("rep", (F.col("all") - F.col("copies")).alias("links"), "other")
    found = stored(pairs.union(dense), "found")
    drop_stored(placed)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = connected_components(found.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    whole = reps.select(*same, "rep", "copies").join(links, "rep", "left").join(named, F.col("rep") == F.col("node"), "left")
    whole = whole.select(*same, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = clean.join(whole, same, "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    n = F.when(F.col("vec_id").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("vec_id", n.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op5_embeddings(spark, sf_dir: str) -> DataFrame:
    """Contract query: all vectors at cosine 0.93."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
