"""Shared-folder tables, set reconciliation and other plumbing of the text operators.

Everything that has to outlive an executor is a Parquet table below the folder
named by ``spark.checkpoint.dir``.  The setting is read from the session; only
in local mode, where driver and workers are one machine, is a private folder
chosen if it is unset.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.kernel import mix

_LOCAL: dict[str, str] = {}

#: Bits for each id in a bitmap of ids, and its bounds.
BITS_PER_ID, MIN_BITS, MAX_BITS = 16, 1 << 16, 1 << 27


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="windrow-"))
    return base.rstrip("/") + "/windrow"


def _path(spark: SparkSession, uri: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The table is removed when the application ends; :func:`drop_stored`
    removes it sooner once nothing reads it any more.
    """
    spark = df.sparkSession
    uri = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(uri)
    path, fs = _path(spark, uri)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(uri)
    out._windrow_uri = uri
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that no pending plan reads."""
    for df in tables:
        uri = getattr(df, "_windrow_uri", None)
        if uri:
            path, fs = _path(df.sparkSession, uri)
            fs.delete(path, True)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores added as it takes to be none of ``taken``."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def id_bitmap(ids: DataFrame) -> np.ndarray | None:
    """Bitmap over the hashes of ``ids(id)``; None if it would need more than MAX_BITS.

    Partial bitmaps are merged by a bit-or aggregation; MAX_BITS / 64 words
    at most reach the driver.
    """
    n = ids.count()
    if n * BITS_PER_ID > MAX_BITS:
        return None
    bits = MIN_BITS
    while bits < n * BITS_PER_ID:
        bits *= 2

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(mix(np.asarray(batch.column("id")).astype(np.int64).view(np.uint64)) & np.uint64(bits - 1))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            held = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(held.view(np.int64))], names=["word", "held"])

    got = ids.select(F.col("id").cast("long").alias("id")).where("id is not null").mapInArrow(of, "word long, held long").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[np.asarray(got["word"], np.int64)] = np.asarray(got["held"], np.int64).view(np.uint64)
    return out


def maybe_held(bitmap: np.ndarray, column: pa.Array) -> np.ndarray:
    """True where an id may be in the bitmap: always for those that are, never for nulls."""
    at = mix(np.asarray(column.fill_null(0)).astype(np.int64).view(np.uint64)) & np.uint64(len(bitmap) * 64 - 1)
    return ((bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0) & np.asarray(column.is_valid())


def _only(bitmap, column: str, held: bool) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = maybe_held(bitmap.value, batch.column(column)) == held
            if keep.any():
                yield batch.filter(pa.array(keep))

    return of


def without_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``df`` without the rows whose ``column`` is among ``ids(id)``; rows with a null there stay.

    Rows that a bitmap of the ids rules out pass without a shuffle; only the
    others are joined with the ids, which decides exactly.  If there are too
    many ids for a bitmap, all rows are joined.
    """
    (gone,) = free_names(df.columns, "_out_id")
    out = ids.select(F.col("id").cast("long").alias(gone)).distinct()
    bitmap = id_bitmap(ids)
    if bitmap is None:
        return df.hint("merge").join(out, df[column] == out[gone], "left_anti")
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    free = df.mapInArrow(_only(shared, column, False), df.schema)
    maybe = df.mapInArrow(_only(shared, column, True), df.schema)
    return free.union(maybe.hint("merge").join(out, maybe[column] == out[gone], "left_anti"))


def named(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of every row; a row without a doc_id is named by its text, by a number from 2^62 on."""
    return docs.select(_name(docs).alias("doc_id"), F.col("text").cast("string").alias("text"))


def _name(docs: DataFrame) -> Column:
    by_text = F.shiftrightunsigned(F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))), 2).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(docs["doc_id"].cast("long"), by_text)


def without(docs: DataFrame, ids: DataFrame, once: bool = False) -> DataFrame:
    """``docs`` without the rows that :func:`named` gives a name among ``ids(id)``.

    Rows that share a doc_id go together; ``once`` keeps one of the rows
    that have no doc_id and the same text.
    """
    name, gone = free_names(docs.columns, "_name", "_out_id")
    nameless = docs.where("doc_id is null").withColumn(name, _name(docs))
    out = ids.select(F.col("id").cast("long").alias(gone)).distinct()
    nameless = nameless.hint("merge").join(out, F.col(name) == F.col(gone), "left_anti")
    nameless = nameless.dropDuplicates([name]) if once else nameless
    return without_ids(docs.where("doc_id is not null"), "doc_id", ids).union(nameless.drop(name))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of ``edges(a, b)``, as ``(node, component)``.

    Alternates the large-star and small-star contractions on distributed edge
    tables; each round is written to the shared folder, so a lost executor
    costs one round at most.  Minima are partially aggregated before the
    shuffle and the joins are plain equi-joins, which adaptive execution may
    split, so a star around one hot node is no single task.  Nothing is
    collected.  Self-loops, repeated and null edges are allowed; a node that
    only has self-loops is its own component.
    """
    spark = edges.sparkSession
    clean = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    nodes = stored(clean.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    work = clean.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    work = stored(work, "edges")
    while True:
        both = work.select("u", "v").union(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # large-star: every larger neighbour of u moves to the least of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small-star: every smaller neighbour of u, and u itself, moves to the least smaller one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = stored(small.where("u <> v").distinct(), "edges")
        same = work.count() == after.count() and is_empty(after.join(work, ["u", "v"], "left_anti"))
        drop_stored(work)
        work = after
        if same:
            break
    roots = work.groupBy("u").agg(F.min("v").alias("component"))
    out = nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
    return stored(out, "components")
