"""N-gram Jaccard join through parity sketches.

A document's set holds its distinct k-word shingles (a shorter text is one
shingle as a whole, an empty or null text has none).  Every shingle flips one
bit of a long bit sketch, so the Hamming distance of two sketches never
exceeds the symmetric difference of the sets.  Sets that reach the Jaccard
threshold have a bounded symmetric difference D; a sketch that is cut into
more than D parts therefore has at least one equal part (pigeonhole).  Sets
are banded by size, since D depends on it; a part travels as the XOR of the
codes of its odd bits.  Pairs that share a part are held against a
parity sketch of two bits or more a member, and then verified on the sets.

No pair is lost and no group of copies is expanded into all pairs:

* equal sets are collapsed first;
* buckets with equal members count once;
* buckets of at most ``SMALL`` members give their pairs, larger ones a star
  around the member that shares most parts with others;
* what the stars leave in different components is then compared in blocks
  of bounded size, and only pairs that the sketches admit are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm import kernel
from windrow.llm.shared import connected_components, drop_stored, id_bitmap, is_empty, maybe_held, named, stored, table, without, without_ids

#: Least bits of a set's own parity sketch.
MIN_BITS = 256
#: Buckets of at most so many members give all their pairs.
SMALL = 16
#: Rows of a block in the comparison of what stars leave over.
BLOCK = 512
#: Sizes of a band differ by this factor at most.
BAND = 1.6
#: Range partitions hold about so many sketch parts.
PARTS_PER_TASK = 2_000_000


def _band_starts() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out, np.int64)


_STARTS = _band_starts()
_I64 = np.int64


def most_apart(total: int, num: int, den: int) -> int:
    """Largest symmetric difference of two linked sets whose sizes sum to ``total``."""
    return total * (den - num) // (den + num)


def band_parts(band: int, num: int, den: int) -> int:
    """Parts of a sketch in a size band: more than the largest difference there."""
    apart = most_apart(2 * int(_STARTS[band + 1] - 1), num, den)
    return apart + 1 + (2 + apart // 32 if apart else 0)


def sketch_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the sketch parts of a sorted set of shingle hashes, over all bands it can meet a partner in."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    code, out = kernel.mix(s ^ np.uint64(0x5851F42D4C957F2D)), []
    most = n * den // num
    first, last = np.searchsorted(_STARTS, [n, most], "right") - 1
    for band in range(first, last + 1):
        p = band_parts(band, num, den)
        cut = np.searchsorted(s >> np.uint64(32), (np.arange(p, dtype=np.uint64) << np.uint64(32)) // np.uint64(p) + (np.arange(p, dtype=np.uint64) > 0))
        size = np.diff(np.append(cut, n))
        full = np.flatnonzero(size)
        role = kernel.mix(np.arange(p, dtype=np.uint64) + (np.uint64(band) << np.uint64(48)))
        out.append(kernel.mix(np.bitwise_xor.reduceat(code, cut[full]) ^ role[full]))
        partner = min(most, int(_STARTS[band + 1] - 1))
        if len(full) <= most_apart(n + partner, num, den):  # may agree with a partner in empty parts only
            out.append(kernel.mix(role[size == 0] + np.uint64(1)))
    return np.unique(np.concatenate(out)).view(np.int64)


def dense_sketch(s: np.ndarray) -> np.ndarray:
    """Parity bits of a set as uint64 words: a power of two of bits, at least two for each member."""
    bits = MIN_BITS
    while bits < 2 * len(s):
        bits *= 2
    odd = np.bincount((kernel.mix(s + np.uint64(77)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """The sketch in ``size`` words, a smaller power of two: parities of bits that fall together add up."""
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _within_reach(x: np.ndarray, y: np.ndarray, total: np.ndarray | int, num: int, den: int):
    """Whether sketches differ in few enough bits for sets whose sizes sum to ``total``."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64) * (den + num) <= total * (den - num)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted shingle hashes of every row's text."""
    data, off = kernel.buffers(batch.column("text"))
    for lo, hi in kernel.spans(off):
        h, first, _ = kernel.words(data, off[lo : hi + 1])
        for i in range(lo, hi):
            yield i, np.unique(kernel.shingles(h[first[i - lo] : first[i - lo + 1]], k))


def _list_array(parts: list[np.ndarray], kind=pa.int64()) -> pa.Array:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))


SKETCH_SCHEMA = "doc_id long, n_shingles long, sig0 long, sig1 long, sketch binary, parts array<long>"


def sketches(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Set size, 128-bit set signature, dense sketch and part keys of each row's text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, bits, parts = np.zeros((batch.num_rows, 3), np.int64), [], []
            for i, s in _sets(batch, k):
                rows[i, 0] = len(s)
                rows[i, 1] = np.add.reduce(s).view(_I64) if len(s) else 0
                rows[i, 2] = np.bitwise_xor.reduce(kernel.mix(s)).view(_I64) if len(s) else 0
                bits.append(dense_sketch(s).tobytes())
                parts.append(sketch_keys(s, num, den))
            cols = [batch.column("doc_id").cast(pa.int64()), *(pa.array(rows[:, j]) for j in range(3)), pa.array(bits, pa.binary()), _list_array(parts)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "sig0", "sig1", "sketch", "parts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, SKETCH_SCHEMA)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and doc, each once, those whose key repeats; a partition's first and last row always pass, as their key may go on next door."""
    held, same = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc = (np.asarray(batch.column(c)) for c in ("key", "doc"))
        if held is not None:
            key, doc = np.append(held[0], key), np.append(held[1], doc)
        new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))  # a doc_id of several rows counts once
        key, doc = key[new], doc[new]
        like = np.empty(len(key), bool)
        like[0], like[1:] = same, key[1:] == key[:-1]
        emit = like[:-1] | like[1:]
        yield pa.RecordBatch.from_arrays([pa.array(key[:-1][emit]), pa.array(doc[:-1][emit])], names=["key", "doc"])
        held, same = (key[-1], doc[-1]), bool(like[-1])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], names=["key", "doc"])


def _admitted(pairs: DataFrame, meta: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sizes and parity sketches allow a link."""
    for side in "ab":
        pairs = pairs.join(meta.select(F.col("doc").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    sized = pairs.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b", (F.col("na") + F.col("nb")).alias("total"), "sa", "sb")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            total, sa, sb = (batch.column(c) for c in ("total", "sa", "sb"))
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(m[i].as_buffer(), np.uint64) for m in (sa, sb))
                size = min(len(x), len(y))
                keep[i] = _within_reach(folded(x, size), folded(y, size), total[i].as_py(), num, den)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return sized.mapInArrow(of, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs whose sets reach the threshold; only the texts that occur in a pair are read again."""
    need = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "need")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    bitmap = id_bitmap(need)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    if bitmap is None:  # too many for a bitmap: the texts meet the ids by a join
        plain = plain.hint("merge").join(need, F.col("doc_id") == F.col("id"), "left_semi")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is not None:
                batch = batch.filter(pa.array(maybe_held(shared.value, batch.column("doc_id"))))
            sets = [s.tobytes() for _, s in _sets(batch, k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["doc", "members"])

    found = plain.mapInArrow(of, "doc long, members binary")
    sets = stored(found.join(need, F.col("doc") == F.col("id"), "left_semi"), "sets")
    # the end with fewer pairs travels with the pair: a star ships its centre's set once for each of its partitions, not once a pair
    degree = pairs.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("n"))
    turned = pairs
    for side in "ab":
        turned = turned.join(degree.select(F.col("doc").alias(side), F.col("n").alias(f"n{side}")), side)
    turned = turned.select(F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("b"))
    both = turned.join(sets.select(F.col("doc").alias("a"), F.col("members").alias("ma")).hint("merge"), "a").join(sets.select(F.col("doc").alias("b"), F.col("members").alias("mb")).hint("merge"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            ma, mb = batch.column("ma"), batch.column("mb")
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(m[i].as_buffer(), np.uint64) for m in (ma, mb))
                if len(x) and len(y):
                    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    keep[i] = den * common >= num * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    links = stored(both.select("a", "b", "ma", "mb").mapInArrow(check, "a long, b long"), "links")
    drop_stored(sets, need)
    return links


def _left_over(large: DataFrame, labels: DataFrame, meta: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of one bucket that the stars left in different components, compared in blocks of bounded size; ``large(doc, keys)`` has a row a document."""
    # labels and sketches meet a document's row, not each of its buckets: as many rows as documents come out of both joins
    labelled = large.join(labels, large["doc"] == labels["node"], "left").select("doc", "keys", F.coalesce("component", "doc").alias("label"))
    named = labelled.select(F.explode("keys").alias("key"), "doc", "label")
    # counted before the rows meet by key: a hot bucket is as many rows here as it has labels
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("c"), F.count("*").alias("labels")).where("labels > 1")
    main = stored(main.select("key", F.col("top.label").alias("main"), "c", (F.col("c") - F.col("top.m")).alias("others")), "main")
    spread = F.xxhash64("doc")
    held = named.join(main, "key").select("doc", "label", F.struct("key", (F.col("label") != F.col("main")).alias("out"), F.ceil(F.col("c") / BLOCK).alias("blocks"), F.ceil(F.col("others") / BLOCK).alias("outs")).alias("at"))
    held = held.groupBy("doc", "label").agg(F.collect_list("at").alias("at")).join(meta, "doc").withColumn("at", F.explode("at")).select("*", "at.*")
    left = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.pmod(spread, "outs").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    right = F.transform(F.sequence(F.lit(0).cast("long"), F.col("outs") - 1), lambda i: F.struct(i.alias("i"), F.pmod(spread, "blocks").alias("j"), F.lit(1).alias("side")))
    placed = held.withColumn("block", F.explode(F.when(F.col("out"), F.concat(left, right)).otherwise(right))).select("*", "block.*")
    cols = ["key", "i", "j", "side", "doc", "label", "n_shingles", "sketch"]

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        x, y = block[block.side == 0], block[block.side == 1]
        if x.empty or y.empty:
            return pd.DataFrame({"a": np.zeros(0, _I64), "b": np.zeros(0, _I64)})
        xs, ys = ([np.frombuffer(m, np.uint64) for m in z.sketch] for z in (x, y))
        size = min(map(len, xs + ys))  # the sizes of a bucket differ little
        xs, ys = (np.stack([folded(m, size) for m in z]) for z in (xs, ys))
        nx, ny = x.n_shingles.to_numpy(), y.n_shingles.to_numpy()
        fit = np.stack([_within_reach(ys, m, n + ny, num, den) for m, n in zip(xs, nx, strict=True)])
        fit &= np.minimum(nx[:, None], ny) * den >= np.maximum(nx[:, None], ny) * num
        fit &= x.label.to_numpy()[:, None] != y.label.to_numpy()[None, :]
        p, q = np.nonzero(fit)
        dx, dy = x.doc.to_numpy()[p], y.doc.to_numpy()[q]
        return pd.DataFrame({"a": np.minimum(dx, dy), "b": np.maximum(dx, dy)})

    return placed.select(cols).groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Components of documents linked by Jaccard >= num/den on k-word shingles.

    One row per input row: ``doc_id, n_shingles, component_id``.  Null or
    empty texts link with nothing; rows that share a doc_id are one node
    whose texts link on their own; a row with a null doc_id takes the
    component of an equal set, else null.  Other columns of ``docs``,
    whatever their names, are not read.
    """
    per_task = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = stored(sketches(docs, k, num, den), "sketches")
    sig = ["n_shingles", "sig0", "sig1"]
    classes = stored(f.where("n_shingles > 0").groupBy(*sig).agg(F.min("doc_id").alias("rep")), "classes")
    # copies are few beside their representatives, so it is they that are looked up
    whole = f.where("n_shingles > 0 and doc_id is not null")
    copies = whole.select("doc_id", *sig).join(classes, sig).where("doc_id <> rep").select(F.col("doc_id").alias("id"))
    own = whole.select("doc_id", *sig).join(classes, sig).where("doc_id = rep").select(F.col("doc_id").alias("_own"))
    copies = stored(copies.join(own, F.col("id") == F.col("_own"), "left_anti").distinct(), "copies")  # a doc_id that also names a representative stays
    fr = without_ids(whole, "doc_id", copies).withColumnRenamed("doc_id", "doc")
    meta = stored(fr.select("doc", "n_shingles", "sketch").distinct(), "meta")
    total = f.agg(F.sum(F.size("parts"))).first()[0] or 0
    parts = max(per_task, int(total // PARTS_PER_TASK) + 1)
    rows = fr.select(F.explode("parts").alias("key"), "doc").repartitionByRange(parts, "key", "doc").sortWithinPartitions("key", "doc")
    rows = stored(rows.mapInArrow(_repeated, "key long, doc long"), "rows")
    names = stored(f.select("doc_id", *sig), "names")
    drop_stored(f, copies)  # the parts are not needed any more
    seen = F.xxhash64("doc")
    kept = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.bit_xor(seen).alias("x")).where("lo < hi")
    kept = kept.groupBy("c", "lo", "hi", "x").agg(F.min("key").alias("key"))
    buckets = stored(rows.join(kept.select("key", "c"), "key"), "buckets")
    drop_stored(rows)
    couple = "flatten(transform(ds, a -> transform(filter(ds, b -> b > a), b -> struct(a as a, b as b))))"
    pairs = buckets.where(F.col("c") <= SMALL).groupBy("key").agg(F.collect_set("doc").alias("ds")).select(F.explode(F.expr(couple)).alias("p")).select("p.a", "p.b").distinct()
    # a row a document, with as many keys as its texts have sketch parts at most
    large = stored(buckets.where(F.col("c") > SMALL).groupBy("doc").agg(F.sum("c").alias("w"), F.collect_list("key").alias("keys")), "large")
    has_large = not is_empty(large)
    if has_large:
        crowded = large.select(F.explode("keys").alias("key"), "doc", "w")
        centre = crowded.groupBy("key").agg(F.max(F.struct(F.col("w"), (-F.col("doc")).alias("d"))).alias("top")).select("key", (-F.col("top.d")).alias("centre"))
        centre = stored(centre, "centres")  # stored, so that the join below has plain sides and a hot bucket may be split
        star = crowded.join(centre, "key").where("doc <> centre").select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct()
        pairs = pairs.union(star)
    pairs = stored(_admitted(pairs, meta, num, den), "pairs")
    links = _verified(pairs, docs, k, num, den)
    labels = connected_components(links)
    if has_large:
        more = stored(_admitted(_left_over(large, labels, meta, num, den), meta, num, den).join(pairs, ["a", "b"], "left_anti"), "pairs")
        if not is_empty(more):
            links = links.union(_verified(more, docs, k, num, den))
            labels = connected_components(links)
        drop_stored(more)
    drop_stored(pairs, buckets, large, meta)
    out = names.join(classes, sig, "left").join(labels, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Contract query: 3-word shingles, 100 * intersection >= 90 * union."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


def one_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one whose doc_id names the component.

    Documents without words stay; rows that share a doc_id go or stay
    together.  Rows without a doc_id are named by their text, after all
    others: they go if a document with an id is like them, and of those with
    one text one stays.
    """
    c = near_duplicates(named(docs), k, num, den)
    gone = stored(c.where("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct(), "gone")
    return without(docs, gone, once=True)
