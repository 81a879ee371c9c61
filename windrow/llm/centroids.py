"""Centroid clustering in exact integers, screened by block norms.

Components become integers once.  Distances do not change under a common
shift and rotation, so each vector is also compressed once: in axes that the
first centroids span it keeps its first ``HEAD`` coordinates and, of the others,
the norm of every segment of ``SEGMENT``.  By the inequality of Cauchy and
Schwarz two compressed vectors bound their scalar product from above, segment
by segment, and with it the distance from below; that holds whatever the axes.  The centroid of the least bound is measured exactly, and after it
only those whose bound does not exceed that distance.

A round is one pass over the stored vectors; partial sums (not vectors) are
shuffled, and the new centroids, ``CLUSTERS`` rows of integers, are all that
the driver sees.  Sums are exact whatever the components' size: they travel
in digits of ``DIGIT`` bits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.shared import drop_stored, stored, table

DIM, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64.0
#: Coordinates kept as they are, and components of a segment among the others.
HEAD, SEGMENT = 16, 8
#: Components below this bound give distances that fit 64 bits; vectors with larger ones are kept as doubles and handled as Python integers.
SMALL = 1 << 26
DIGIT = 30
#: Rounding allowed for in the bounds, as a share of both squared norms.
SLACK = 1e-9
_LONG_MAX = (1 << 63) - 1


def spanned_axes(starts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """A shift and orthonormal axes (columns), of which the first hold the starts without a large component."""
    c = np.array([v for v in starts if max(map(abs, v)) < SMALL], np.float64).reshape(-1, DIM)
    mean = c.mean(0) if len(c) else np.zeros(DIM)
    return mean, np.linalg.qr(np.hstack([(c - mean).T, np.eye(DIM)]))[0]


def compressed(x: np.ndarray, axes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """First HEAD coordinates and the norms of the other segments: their squares add up to the squared norm around the mean."""
    turned = (x - axes[0]) @ axes[1]
    rest = turned[:, HEAD:].reshape(len(x), -1, SEGMENT)
    return np.hstack([turned[:, :HEAD], np.sqrt((rest * rest).sum(2))])


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and components of the vectors of DIM finite components."""
    for batch in batches:
        lists = batch.column("embedding")
        fits = pc.fill_null(pc.equal(pc.list_value_length(lists), DIM), False)
        ids, lists = batch.column("vec_id").filter(fits), lists.filter(fits)
        x = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan), np.float64).reshape(-1, DIM)
        finite = np.isfinite(x).all(1)
        yield ids.filter(pa.array(finite)), x[finite]


def _floors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer components (zeros for vectors with a large one), and which vectors have a large one."""
    large = (np.abs(x) >= SMALL / SCALE).any(1)
    return np.floor(SCALE * np.where(large[:, None], 0.0, x)).astype("<i4"), large


def _held(whole: np.ndarray, x: np.ndarray, large: np.ndarray) -> pa.Array:
    """DIM int32 for each vector, or its doubles if it has a large component."""
    return pa.array([(d if big else w).tobytes() for d, w, big in zip(x, whole, large, strict=True)], pa.binary())


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, x in _usable(batches):
        whole, large = _floors(x)
        yield pa.RecordBatch.from_arrays([ids, _held(whole, x, large)], names=["vec_id", "x"])


def _integers(axes: tuple[np.ndarray, np.ndarray]) -> callable:
    """Usable vectors and their compressed form."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _usable(batches):
            whole, large = _floors(x)
            yield pa.RecordBatch.from_arrays([ids, _held(whole, x, large), pa.array([r.tobytes() for r in compressed(whole, axes)], pa.binary())], names=["vec_id", "x", "bounds"])

    return of


def _exact(raw: bytes) -> list[int]:
    """Components of a stored vector as Python integers."""
    if len(raw) == 4 * DIM:
        return np.frombuffer(raw, "<i4").tolist()
    # a double of 2^53 or more is an integer, so that the product is exact there; below, floor of the product is
    return [int(v) * int(SCALE) if abs(v) >= 1 << 53 else int(np.floor(SCALE * v)) for v in np.frombuffer(raw, np.float64).tolist()]


def _square(a: list[int], b: list[int]) -> int:
    return sum((p - q) ** 2 for p, q in zip(a, b, strict=True))


def nearest(x: np.ndarray, bounds: np.ndarray, centroids: list[list[int]], axes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of small vectors, and how many exact distances that took."""
    small = np.array([all(abs(v) < SMALL for v in c) for c in centroids])
    c = np.array([c if s else [0] * DIM for c, s in zip(centroids, small, strict=True)], np.int64)
    of_c = compressed(c, axes)
    both = (bounds * bounds).sum(1)[:, None] + (of_c * of_c).sum(1)
    least = both - 2 * (bounds @ of_c.T) - SLACK * (both + (axes[0] ** 2).sum()) - 1
    least[:, ~small] = np.inf  # a centroid with a large component: measured in Python integers where it may still be the nearest
    rows = np.arange(len(x))
    if small.any():
        cluster = least.argmin(1)
        far = x - c[cluster]
        distance, work = (far * far).sum(1), len(x)
        least[rows, cluster] = np.inf
        for k in np.flatnonzero(small):
            at = np.flatnonzero(least[:, k] <= distance)
            far = x[at] - c[k]
            d = (far * far).sum(1)
            work += len(at)
            closer = (d < distance[at]) | (d == distance[at]) & (k < cluster[at])
            cluster[at[closer]], distance[at[closer]] = k, d[closer]
    else:
        cluster, distance, work = np.zeros(len(x), np.int64), np.array([_square(v, centroids[0]) for v in x.tolist()], object), len(x)
    for k in np.flatnonzero(~small):
        # one component alone may be too far already
        j = int(np.argmax([abs(v) for v in centroids[k]]))
        off = np.abs(x[:, j].astype(np.float64) - float(max(-1e300, min(1e300, centroids[k][j]))))
        for i in np.flatnonzero(off * off * (1 - SLACK) <= distance.astype(np.float64) + 1):
            d = _square(x[i].tolist(), centroids[k])
            work += 1
            if (d, k) < (int(distance[i]), int(cluster[i])):
                cluster[i] = k
                distance = distance.astype(object) if d > _LONG_MAX else distance
                distance[i] = d
    return cluster, distance, work


def _assigned(batch: pa.RecordBatch, centroids: list[list[int]], axes) -> tuple[np.ndarray, list[int], np.ndarray, list[tuple[int, list[int]]]]:
    """Clusters and distances of a batch; its small vectors as a matrix, the others as (row, integers)."""
    n, raw = batch.num_rows, batch.column("x")
    small = np.asarray(pc.equal(pc.binary_length(raw), 4 * DIM), bool)
    joined = lambda column, kind: np.frombuffer(b"".join(column.filter(pa.array(small)).to_pylist()), kind)
    x = joined(raw, "<i4").reshape(-1, DIM).astype(np.int64)
    cluster, distance = np.zeros(n, np.int64), np.zeros(n, object)
    if len(x):
        cluster[small], distance[small], _ = nearest(x, joined(batch.column("bounds"), np.float64).reshape(len(x), -1), centroids, axes)
    others = [(int(i), _exact(raw[int(i)].as_py())) for i in np.flatnonzero(~small)]
    for i, v in others:
        distance[i], cluster[i] = min((_square(v, c), k) for k, c in enumerate(centroids))
    return cluster, distance.tolist(), x, others


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """Non-zero digits of DIGIT bits, with the value's sign."""
    sign, rest, at = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        if low := rest & ((1 << DIGIT) - 1):
            yield at, sign * low
        rest >>= DIGIT
        at += 1


def _partial_sums(centroids: list[list[int]], axes) -> callable:
    """Digits of the componentwise sums of each cluster's vectors in a partition; component DIM counts them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = defaultdict(int)
        for batch in batches:
            cluster, _, x, others = _assigned(batch, centroids, axes)
            small = np.ones(batch.num_rows, bool)
            small[[i for i, _ in others]] = False
            order = np.argsort(cluster[small], kind="stable")
            found, start = np.unique(cluster[small][order], return_index=True)
            sums = np.add.reduceat(x[order], start) if len(x) else x
            for k, row in zip(found.tolist(), sums.tolist(), strict=True):
                for j, v in enumerate(row):
                    total[k, j] += v
            for i, v in others:
                for j, e in enumerate(v):
                    total[int(cluster[i]), j] += e
            for k, n in zip(*np.unique(cluster, return_counts=True), strict=True):
                total[int(k), DIM] += int(n)
        rows = [(k, j, at, d) for (k, j), v in total.items() for at, d in _digits(v)]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols[:3]] + [pa.array(cols[3], pa.int64())], names=["cluster", "at", "digit", "value"])

    return of


def moved(vectors: DataFrame, centroids: list[list[int]], axes) -> list[list[int]]:
    """Centroids after a round: componentwise floor of the mean; those without vectors stay."""
    sums = vectors.mapInArrow(_partial_sums(centroids, axes), "cluster int, at int, digit int, value long").groupBy("cluster", "at", "digit").agg(F.sum("value").alias("value"))
    total = defaultdict(int)
    for r in sums.collect():  # CLUSTERS x (DIM + 1) numbers of a few digits
        total[r["cluster"], r["at"]] += r["value"] << (DIGIT * r["digit"])
    return [[total[k, j] // total[k, DIM] for j in range(DIM)] if total[k, DIM] else c for k, c in enumerate(centroids)]


def clustered(vectors: DataFrame) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of the usable rows of ``vectors(vec_id, embedding)``.

    Rows whose embedding is null, has another number of components than DIM,
    or holds a null or non-finite one are left out.  Repeated rows and
    vec_ids are vectors of their own; of equal start hashes the smaller stored
    bytes come first, rows without a vec_id come last.  With fewer than
    CLUSTERS vectors there are as many centroids as vectors; an empty table
    gives no rows.  Distances and inertias beyond 64 bits are null (they are
    compared exactly all the same).  Other columns are not read.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    start = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = plain.mapInArrow(_plain, "vec_id long, x binary").select(start.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(CLUSTERS)
    centroids = [_exact(bytes(r["x"])) for r in first.collect()]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    axes = spanned_axes(centroids)
    kept = stored(plain.mapInArrow(_integers(axes), "vec_id long, x binary, bounds binary"), "vectors")
    for _ in range(ROUNDS):
        centroids = moved(kept, centroids, axes)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _, _ = _assigned(batch, centroids, axes)
            fits = [d if d <= _LONG_MAX else None for d in distance]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    out = stored(kept.mapInArrow(of, "vec_id long, cluster int, distance long"), "assigned")
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count_if(F.col("distance").isNull()).alias("unknown")).collect()
    drop_stored(kept)
    fits = lambda v: int(v) if v is not None and v <= _LONG_MAX else None
    total = fits(sum(int(r["d"] or 0) for r in sums)) if not any(r["unknown"] for r in sums) else None
    rows = [(r["cluster"], fits(r["d"]) if not r["unknown"] else None, total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in sums]
    sizes = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(sizes), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # CLUSTERS rows


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """Contract query: clusters of all embeddings."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    square = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    assign = f"SELECT v.n, min(struct_pack(d := {square}, k := c.k)) AS best FROM v, c{{i}} c GROUP BY v.n"
    move = """SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
  SELECT k, list(CAST(s AS BIGINT) ORDER BY j) AS x FROM (
    SELECT best.k AS k, j, floor(CAST(sum(v.x[j]) AS DOUBLE) / count(*)) AS s FROM a{i} JOIN v USING (n), range(1, 65) r(j) GROUP BY 1, 2
  ) GROUP BY 1) m ON m.k = c.k"""
    steps = [
        "v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        "c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS k, x FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h LIMIT 16))",
    ]
    for i in range(ROUNDS):
        steps += [f"a{i} AS (" + assign.format(i=i) + ")", f"c{i + 1} AS (" + move.format(i=i) + ")"]
    steps.append(f"a{ROUNDS} AS (" + assign.format(i=ROUNDS) + ")")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(best.k AS INT) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (n) JOIN c{ROUNDS} c ON c.k = best.k"""


OP12_SQL = _sql()
