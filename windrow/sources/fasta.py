"""Reference sequences in FASTA files, read by an offset index in splits.

The index (contig, length, offset of the first base, bases and bytes of a line)
is made by scanning byte ranges of the files apart; what a range says about a
contig that began in an earlier one is put together by order of place.  With
it any stretch of a contig is a byte range, so sequences are fetched by
seeking: tasks get regions, not files.  Executors open files with pyarrow's
file systems (local, HDFS, S3, GCS); compressed files cannot be sought in and
are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a scanned range, bases of a chunk, and bases of an output batch.
SPLIT, CHUNK, BATCH = 64 << 20, 1 << 16, 1 << 22

_FRAGMENT = "file string, lo long, seq int, header string, offset long, lines long, bases long, per_line long, per_line_bytes long, even boolean, tail long"


def _open(uri: str):
    store, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return store.open_input_file(path)


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files at a path, folder or glob, with their sizes."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for top in store.globStatus(p) or []:
        for s in store.listStatus(top.getPath()) if top.isDirectory() else [top]:
            name = s.getPath().getName()
            if s.isFile() and not name.startswith(("_", ".")):
                if name.endswith((".gz", ".bz2", ".zst")):
                    raise ValueError(f"{name} is compressed")
                out.append((s.getPath().toString(), s.getLen()))
    return sorted(out)


def _fragments(lo: int, hi: int, size: int, handle) -> list[tuple]:
    """What the lines that begin in bytes [lo, hi) hold of each contig, in order."""
    begin = max(0, lo - 1)
    handle.seek(begin)
    raw = handle.read(hi - begin)
    while begin + len(raw) < size and not raw.endswith(b"\n"):
        more = handle.read(4096)
        end = more.find(b"\n")
        raw += more if end < 0 else more[: end + 1]
    data = np.frombuffer(raw, np.uint8)
    stops = np.append(np.flatnonzero(data == 10), len(data)) if len(data) and data[-1] != 10 else np.flatnonzero(data == 10)
    starts = np.append(0, stops[:-1] + 1) if len(stops) else np.zeros(0, np.int64)
    # the byte before the range says whether a line begins with it
    first = 0 if lo == 0 else 1
    mine = (starts >= first) & (starts + begin < hi)
    starts, stops = starts[mine], stops[mine]
    width = stops - starts
    filled = width > 0
    bases = width - (filled & (data[np.maximum(stops - 1, 0)] == 13))
    head = filled & (data[np.minimum(starts, max(len(data) - 1, 0))] == ord(">")) if len(data) else filled
    out, marks = [], np.flatnonzero(head)
    for seq, (a, b) in enumerate(zip(np.append(-1, marks), np.append(marks, len(starts)), strict=True)):
        own = np.arange(a + 1, b)
        own = own[bases[own] > 0]
        name = None if a < 0 else (raw[starts[a] + 1 : starts[a] + bases[a]].split() or [b""])[0].decode()
        if a < 0 and not len(own):
            continue
        if len(own):
            per, bytes_ = int(bases[own[0]]), int(width[own[0]] + 1)
            even = bool((bases[own[:-1]] == per).all() and (width[own[:-1]] + 1 == bytes_).all() and (np.diff(own) == 1).all())
            out.append((seq, name, int(starts[own[0]] + begin), len(own), int(bases[own].sum()), per, bytes_, even, int(bases[own[-1]])))
        else:
            out.append((seq, name, None, 0, 0, None, None, True, None))
    return out


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _FRAGMENT.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in _FRAGMENT.split(", ")]
    for batch in batches:
        for file, lo, hi, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with _open(file) as handle:
                rows = [(file, lo, *f) for f in _fragments(lo, hi, size, handle)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)


def fasta_index(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """``file, contig, length, offset, line_bases, line_bytes`` of every contig below ``path``.

    Lines of a contig have to be of one length but for the last, without empty
    ones between, else reading fails.  A contig without bases has length 0 and a null offset.
    """
    ranges = [(f, lo, min(lo + split, size), size) for f, size in _files(spark, path) for lo in range(0, size, split)]
    parts = spark.createDataFrame(ranges, "file string, lo long, hi long, size long").repartition(max(1, len(ranges))).mapInArrow(_scanned, _FRAGMENT)
    # from here on a row for each contig and range
    order = Window.partitionBy("file").orderBy("lo", "seq")
    begun = F.sum(F.col("header").isNotNull().cast("long")).over(order)
    p = parts.withColumn("contig_no", begun).where("contig_no > 0").withColumn("place", F.struct("lo", "seq"))
    has = F.col("lines") > 0
    whole = p.groupBy("file", "contig_no").agg(
        F.max("header").alias("contig"), F.sum("bases").alias("length"), F.min("offset").alias("offset"), F.min_by("per_line", F.when(has, F.col("place"))).alias("line_bases"),
        F.min_by("per_line_bytes", F.when(has, F.col("place"))).alias("line_bytes"), F.max(F.when(has, F.col("place"))).alias("last"),
    )
    checked = p.where(has).join(whole.select("file", "contig_no", "line_bases", "line_bytes", "last"), ["file", "contig_no"])
    b = F.col("line_bases")
    fits = F.col("even") & ((F.col("lines") == 1) | (F.col("per_line") == b)) & F.when(F.col("place") == F.col("last"), F.col("tail") <= b).otherwise(F.col("tail") == b)
    odd = checked.groupBy("file", "contig_no").agg(F.bool_and(fits).alias("fits"))
    out = whole.join(odd, ["file", "contig_no"], "left")
    said = F.when(F.coalesce("fits", F.lit(True)), F.col("length")).otherwise(F.raise_error(F.concat(F.lit("lines of unequal length in contig "), F.col("contig"))).cast("long"))
    return out.select("file", "contig", said.alias("length"), "offset", "line_bases", "line_bytes")


def index_lines(index: DataFrame) -> DataFrame:
    """The index as tab-separated lines: contig, length, offset, bases and bytes of a line."""
    return index.select(F.struct("file", "offset").alias("order"), F.concat_ws("\t", "contig", *(F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("length", "offset", "line_bases", "line_bytes"))).alias("value"))


def _read(names: list[str]) -> callable:
    """Regions' bases by seeking; a task keeps one file open."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle, at = None, None
        for batch in batches:
            lo, held, bases = 0, 0, []
            where = [batch.column(c).to_pylist() for c in ("file", "_at", "_bytes")]
            for i, (file, offset, n) in enumerate(zip(*where, strict=True)):
                if n:
                    if file != at:
                        handle, at = _open(file), file
                    handle.seek(offset)
                    bases.append(handle.read(n).translate(None, b"\r\n").decode())
                else:
                    bases.append("")
                held += n
                if held >= BATCH or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, i + 1 - lo) for c in names), pa.array(bases, pa.string())], names=[*names, "bases"])
                    lo, held, bases = i + 1, 0, []

    return of


def fetched_bases(index: DataFrame, regions: DataFrame) -> DataFrame:
    """``regions(contig, start, end, ...)`` with their ``bases``: the part of [start, end) that the contig has.

    Regions of contigs that the index lacks are left out; those beyond a
    contig's end, or empty, have empty bases.
    """
    i = index.select("contig", "file", F.col("length").alias("_n"), F.col("offset").alias("_o"), F.col("line_bases").alias("_b"), F.col("line_bytes").alias("_w"))
    r = regions.join(i, "contig")
    lo, hi = F.greatest(F.col("start"), F.lit(0)), F.least(F.col("end"), F.col("_n"))
    byte = lambda p: F.col("_o") + F.floor(p / F.col("_b")) * F.col("_w") + p % F.col("_b")
    # up to behind the last base, so that no line end at the region's end is read
    r = r.withColumn("_at", F.when(lo < hi, byte(lo)).cast("long")).withColumn("_bytes", F.when(lo < hi, byte(hi - 1) + 1 - byte(lo)).otherwise(0).cast("long"))
    schema = r.select(*regions.columns).schema.add("bases", "string")
    return r.select(*regions.columns, "file", "_at", "_bytes").mapInArrow(_read(regions.columns), schema)


def chunks(index: DataFrame, size: int = CHUNK) -> DataFrame:
    """``contig, chunk, start, end`` of all contigs in chunks."""
    return index.where("length > 0").select("contig", F.col("length"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("chunk")).select("contig", "chunk", (F.col("chunk") * size).alias("start"), F.least(F.col("chunk") * size + size, F.col("length")).alias("end"))


def with_reference(loci: DataFrame, index: DataFrame, size: int = CHUNK) -> DataFrame:
    """Adds ``ref``, the base after the start, to ``loci(contig, start, ...)``; N where there is none.  Each chunk that holds a locus is read once."""
    at = loci.withColumn("_chunk", F.floor(F.col("start") / size))
    wanted = chunks(index, size).join(at.select("contig", F.col("_chunk").alias("chunk")).distinct(), ["contig", "chunk"], "left_semi")
    held = fetched_bases(index, wanted).select("contig", F.col("chunk").alias("_chunk"), F.col("start").alias("_start"), F.col("bases").alias("_bases"))
    base = F.substring(F.col("_bases"), (F.col("start") - F.col("_start") + 1).cast("int"), F.lit(1))
    return at.join(held, ["contig", "_chunk"], "left").withColumn("ref", F.when(F.length(base) == 1, base).otherwise(F.lit("N"))).select(*loci.columns, "ref")


def window_gc(axis: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``gc``, the share of G and C among the known bases, to windows ``axis(contig, start, end, ...)``; null without known bases."""
    s = fetched_bases(index, axis)
    count = lambda letters: F.length("bases") - F.length(F.translate(F.col("bases"), letters, ""))
    known = count("ACGTacgt")
    return s.withColumn("gc", F.when(known > 0, count("CGcg") / known)).drop("bases")


def fasta_lines(sequences: DataFrame, width: int = 60) -> DataFrame:
    """``contig, line, value`` of pieces ``sequences(contig, start, bases)``: line -1 is the header; places that no piece covers are N, pieces may not overlap."""
    s = sequences.where("length(bases) > 0").withColumn("end", F.col("start") + F.length("bases"))
    cut = s.withColumn("line", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    first = F.greatest(F.col("start"), F.col("line") * width)
    last = F.least(F.col("end"), F.col("line") * width + width)
    cut = cut.select("contig", "line", (first - F.col("line") * width).cast("int").alias("at"), F.expr(f"substring(bases, cast(greatest(start, line * {width}) - start + 1 as int), cast({width} as int))").alias("piece"), (last - first).cast("int").alias("n"))
    cut = cut.withColumn("piece", F.expr("substring(piece, 1, n)"))
    filled = cut.groupBy("contig", "line").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))  # a line's pieces: width at most
    text = F.aggregate("p", F.lit(""), lambda t, x: F.concat(F.rpad(t, x["at"], "N"), x["piece"]))
    lengths = s.groupBy("contig").agg(F.max("end").alias("n"))
    every = lengths.select("contig", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / width))).alias("line"))
    size = F.least(F.col("n") - F.col("line") * width, F.lit(width)).cast("int")
    lines = every.join(filled.select("contig", "line", text.alias("value")), ["contig", "line"], "left").select("contig", "line", F.rpad(F.coalesce("value", F.lit("")), size, "N").alias("value"))
    return lengths.select("contig", F.lit(-1).cast("long").alias("line"), F.concat(F.lit(">"), F.col("contig")).alias("value")).union(lines)


def write_fasta(sequences: DataFrame, path: str, width: int = 60) -> None:
    """FASTA files below ``path``.  The format wants a contig's lines one after the other, so a contig is one task's sorted stream of short lines."""
    lines = fasta_lines(sequences, width)
    lines.repartition("contig").sortWithinPartitions("contig", "line").select("value").write.mode("overwrite").text(path)
