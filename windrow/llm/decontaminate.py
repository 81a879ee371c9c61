"""Benchmark decontamination by spaced seeds.

A seed hashes the words of a text at the kept positions of a fixed mask, so
substitutions at ignored positions do not disturb it.  Seeds of the benchmark
items and of the training texts are joined on their hash; around a hit both
word sequences are laid against each other, and the longest ungapped stretch
with enough equal words decides.  As many words as the longest item has are
looked at on either side of a hit, so no overlap is cut short.

Before the join, training seeds pass a bitmap of the benchmark's seeds.  It
is built by a bit-or aggregation and has ``MAX_BITS`` bits at most whatever
the benchmark's size, so what is broadcast is bounded; it has no false
negatives, and its false positives find no partner in the join.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm import kernel
from windrow.llm.shared import drop_stored, named, stored, table, without

#: Fixed masks: 1 keeps a word, 0 ignores it.
MASKS = ("11101001011", "11011100101", "10110011101", "1111111", "1110111", "11011011")
SPAN = 11
#: Items of fewer words than SPAN, the longest mask, have masks of their own length (:func:`covers`); those below SHORTEST are not sought, those below TOLERANT only as they are.
SHORTEST, TOLERANT = 3, 6
#: An overlap counts from so many words (or the whole item, if shorter) and this share of equal words.
MIN_WORDS, MIN_EQUAL = 12, 0.8
#: Score of an unequal word against 1 of an equal one: MIN_EQUAL / (1 - MIN_EQUAL).
UNEQUAL_COST = 4
MIN_BITS, MAX_BITS, BITS_PER_SEED = 1 << 16, 1 << 27, 1024


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and word hashes, case folded, ASCII punctuation parting words."""
    column = batch.column("text").fill_null("").cast(pa.large_string())
    data, off = kernel.buffers(pc.utf8_lower(column))
    for lo, hi in kernel.spans(off):
        h, first, _ = kernel.words(data, off[lo : hi + 1], kernel.NON_WORD)
        for i in range(lo, hi):
            yield i, h[first[i - lo] : first[i - lo + 1]]


def _masked(h: np.ndarray, mask: str, role: int) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, keep in enumerate(mask):
        if keep == "1":
            out += h[j : j + n] * kernel._ROLE[j]
    return kernel.mix(out + np.uint64(role))


def covers(n: int) -> tuple[str, ...]:
    """Masks for an item of ``n`` < SPAN words: whatever words it may have unequal, one mask ignores them all.

    Blocks of words are ignored one or two at a time, as many as words may be
    unequal; five words or more are kept.
    """
    if n < TOLERANT:
        return ("1" * n,)
    unequal = n - -(-n * 4 // 5)
    blocks = np.array_split(np.arange(n), 5 if unequal > 1 else -(-n // max(1, n - 6)))
    out = []
    for ignored in itertools.combinations(blocks, unequal):
        gone = set(np.concatenate(ignored).tolist())
        out.append("".join("0" if j in gone else "1" for j in range(n)))
    return tuple(out)


def seeds(h: np.ndarray, lengths: tuple[int, ...], whole: bool) -> Iterator[tuple[np.ndarray, int]]:
    """(hashes by start word, span) for each mask; ``whole`` texts below SPAN words give the seeds of their own length only."""
    short = whole and len(h) < SPAN
    if not short:
        for role, mask in enumerate(MASKS):
            yield _masked(h, mask, role), len(mask)
    for n in lengths if not whole else (len(h),) if short and len(h) in lengths else ():
        for j, mask in enumerate(covers(n)):
            yield _masked(h, mask, 100 + 16 * n + j), n


def _item_words(benchmark: DataFrame) -> DataFrame:
    def of(batches):
        for batch in batches:
            found = [h.tobytes() for _, h in _words(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.binary()), pa.array([len(b) // 8 for b in found], pa.int32())], names=["item_id", "item_words", "n_item"])

    plain = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    return plain.mapInArrow(of, "item_id long, item_words binary, n_item int").where(F.col("n_item") >= SHORTEST)


def _item_seeds(items: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    def of(batches):
        for batch in batches:
            out = [[], [], []]
            for item, words in zip(batch.column("item_id").to_pylist(), batch.column("item_words").to_pylist(), strict=True):
                for g, _ in seeds(np.frombuffer(words, np.uint64), lengths, whole=True):
                    out[0].append(g.view(np.int64))
                    out[1].append(np.full(len(g), item, np.int64))
                    out[2].append(np.arange(len(g), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out], names=["seed", "item_id", "item_at"])

    return items.mapInArrow(of, "seed long, item_id long, item_at long").distinct()


def _bitmap(seed_rows: DataFrame) -> np.ndarray:
    """Bits at both hash positions of every seed; MAX_BITS bits at most reach the driver."""
    n = seed_rows.count()
    bits = MIN_BITS
    while bits < min(MAX_BITS, n * BITS_PER_SEED):
        bits *= 2
    at = F.explode(F.array(F.col("seed"), F.shiftrightunsigned("seed", 32))).alias("at")
    at_bit = seed_rows.select(at).select(F.col("at").bitwiseAND(F.lit(bits - 1)).alias("at"))
    words = at_bit.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("set"))
    out = np.zeros(bits // 64, np.uint64)
    got = words.toArrow() if hasattr(words, "toArrow") else pa.Table.from_pandas(words.toPandas())
    out[np.asarray(got["word"], np.int64)] = np.asarray(got["set"], np.int64).view(np.uint64)
    return out


def _regions(docs: DataFrame, bitmap, lengths: tuple[int, ...], reach: int) -> DataFrame:
    """Stretches of training texts around seeds that pass the bitmap: ``reach`` words, the longest item's, on either side.

    ``hits`` are the region's distinct seeds, ``at`` their places.
    """

    def of(batches):
        bits = bitmap.value
        low = np.uint64(len(bits) * 64 - 1)

        def has(g):
            at = g & low
            return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0

        for batch in batches:
            ids, base, words, hit, at = [], [], [], [], []
            names = batch.column("doc_id")
            for i, h in _words(batch):
                found = []
                for g, _ in seeds(h, lengths, whole=False):
                    p = np.flatnonzero(has(g))
                    if len(p) and len(p := p[has(g[p] >> np.uint64(32))]):
                        found.append((p, g[p]))
                if not found:
                    continue
                p, g = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(p, kind="stable")
                p, g = p[order], g[order]
                for q in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p) > 2 * reach) + 1):
                    b = max(0, int(p[q[0]]) - reach)
                    ids.append(names[i])
                    base.append(b)
                    words.append(h[b : int(p[q[-1]]) + SPAN + reach].tobytes())
                    by = q[np.argsort(g[q], kind="stable")]
                    first = np.flatnonzero(np.append(True, g[by][1:] != g[by][:-1]))
                    hit.append(g[by][first].view(np.int64))
                    at.append(np.split(p[by].astype(np.int64) - b, first[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(base, pa.int64()), pa.array(words, pa.binary()), pa.array(hit, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.list_(pa.int64())))],
                names=["doc_id", "base", "doc_words", "hits", "at"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return plain.mapInArrow(of, "doc_id long, base long, doc_words binary, hits array<long>, at array<array<long>>")


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal words) of the longest stretch with MIN_EQUAL equal words that begins and ends with one, the first of several.

    With +1 for an equal word and -4 for another a stretch qualifies if its
    sum is not negative; the earliest start of each end follows from running
    minima of the prefix sums.
    """
    score = np.concatenate([[0], np.cumsum(np.where(equal, 1, -UNEQUAL_COST))])
    low = np.minimum.accumulate(score)
    first = np.searchsorted(-low, -score, "left")
    end = int(np.argmax(np.arange(len(score)) - first))
    hit = np.flatnonzero(equal[int(first[end]) : end]) + int(first[end])
    if not len(hit):
        return 0, 0, 0
    return int(hit[0]), int(hit[-1]) + 1, len(hit)


def _best(x: np.ndarray, y: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(equal words, words, -first word) of the overlap of a text's words and an item's laid at ``shift``, if it counts."""
    lo, hi = max(0, shift), min(len(x), shift + len(y))
    if lo >= hi:
        return None
    equal = x[lo:hi] == y[lo - shift : hi - shift]
    if len(y) <= MIN_WORDS:
        # a short item counts as a whole, wherever its unequal words are
        at = np.flatnonzero(equal)
        if len(at) < (len(y) if len(y) < TOLERANT else MIN_EQUAL * len(y)):
            return None
        return len(at), int(at[-1]) + 1 - int(at[0]), -(lo + int(at[0]))
    start, end, same = best_stretch(equal)
    n = end - start
    return (same, n, -(lo + start)) if n >= MIN_WORDS and same >= MIN_EQUAL * n else None


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best overlap of each (region, item): all shifts that a pair of equal seeds gives are tried, each once."""
    for batch in batches:
        rows = []
        for doc, base, item, places, dw, iw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "base", "item_id", "places", "doc_words", "item_words")), strict=True):
            x, y = np.frombuffer(dw, np.uint64), np.frombuffer(iw, np.uint64)
            tried = np.zeros(len(x) + len(y) + 1, bool)
            for p in places:
                at = np.asarray(p["at"], np.int64)
                for j in p["item_at"]:
                    tried[at - j + len(y)] = True
            found = [r for shift in np.flatnonzero(tried) - len(y) if (r := _best(x, y, int(shift)))]
            if found:
                same, n, at = max(found)
                rows.append((doc, item, base - at, n, same))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "first_word", "n_words", "n_equal"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps: ``doc_id, item_id, first_word, n_words, n_equal``, the longest for each pair.

    Words are case-folded runs of ASCII letters and digits and of all
    non-ASCII characters.  Null or empty texts overlap with nothing; a row
    with a null doc_id or item_id cannot be named and gives no row; equal
    rows give one row.  Other columns of either table are not read.
    """
    spark = docs.sparkSession
    items = stored(_item_words(benchmark), "items")
    lengths = tuple(r[0] for r in items.where(F.col("n_item") < SPAN).select("n_item").distinct().orderBy("n_item").collect())  # SPAN - SHORTEST values at most
    reach = items.agg(F.max("n_item")).first()[0] or 0
    seed_rows = stored(_item_seeds(items, lengths), "seeds")
    bitmap = spark.sparkContext.broadcast(_bitmap(seed_rows))
    regions = stored(_regions(docs, bitmap, lengths, reach), "regions")
    hits = regions.select("doc_id", "base", F.explode(F.arrays_zip("hits", "at")).alias("h")).select("doc_id", "base", F.col("h.hits").alias("seed"), F.col("h.at").alias("at"))
    held = seed_rows.groupBy("seed", "item_id").agg(F.collect_list("item_at").alias("item_at"))  # an item's places of one seed
    # the words are attached once for each region and item, however often their seeds repeat
    lines = hits.join(held, "seed").groupBy("doc_id", "base", "item_id").agg(F.collect_set(F.struct("at", "item_at")).alias("places"))
    aligned = lines.join(regions.select("doc_id", "base", "doc_words"), ["doc_id", "base"]).join(items, "item_id")
    found = aligned.select("doc_id", "base", "item_id", "places", "doc_words", "item_words").mapInArrow(_check, "doc_id long, item_id long, first_word long, n_words long, n_equal long")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", "n_words", (-F.col("first_word")).alias("at"))).alias("top"))
    out = stored(best.select("doc_id", "item_id", (-F.col("top.at")).alias("first_word"), F.col("top.n_words").alias("n_words"), F.col("top.n_equal").alias("n_equal")), "overlaps")
    drop_stored(items, seed_rows, regions)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that overlap with a benchmark item, with or without a doc_id; rows that share a doc_id go together."""
    return without(docs, overlaps(named(docs), benchmark).select(F.col("doc_id").alias("id")).distinct())


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that overlap."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
