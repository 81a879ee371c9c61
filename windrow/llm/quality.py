"""Text quality by a generalised additive model with pairwise interactions.

1. Every whole text becomes ``FEATURES`` numbers (shares of kinds of
   characters, of words and of repetitions, over the text and over its most
   extreme ``BLOCK`` bytes), computed from Arrow buffers, a few counting
   passes a batch.
2. On a bounded sample of labelled training rows each number is cut into bins
   at quantiles.  Shallow trees of one feature are boosted in turn, feature
   after feature, so that each feature's trees add up to one lookup table;
   then the pairs of features that explain most of what is left get tables of
   their own, boosted in turn by trees of one cut in either direction.
3. A text's score is the logistic of the sum of its table entries.

Labels are read for training rows only (crc32 of the doc_id's text is not
divisible by ``FOLDS``); no column but ``text`` is ever an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm import kernel
from windrow.llm.shared import stored, table
from windrow.llm.toxicity import held_out

#: Labelled rows that the model is fitted to at most.
FIT_ROWS = 20_000
#: Bytes of the stretches of which the most extreme one counts.
BLOCK = 256
#: Bins of a feature, and of a feature in a pair; pairs.
BINS, COARSE, PAIRS = 32, 8, 10
#: Turns over all features and over all pairs, step of a tree, leaves' ridge and least weight.
TURNS, PAIR_TURNS, RATE, RIDGE, LEAST = 120, 40, 0.1, 1.0, 1.0
#: Score from which a text counts as good.
CUT = 0.3

#: Kinds of bytes.
KINDS = ("other", "lower", "upper", "digit", "space", "newline", "stop", "mark", "bar", "symbol", "high")
LOWER, UPPER, DIGIT, NEWLINE, STOP, MARK, BAR, SYMBOL, HIGH = 1, 2, 3, 5, 6, 7, 8, 9, 10


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    for code, chars in ((3, b"0123456789"), (4, b" \t\v\f\r"), (5, b"\n"), (6, b".,;:'\"()-"), (7, b"!?"), (8, b"|"), (9, b"#$%&*+/<=>@[\\]^_`{}~")):
        kind[list(chars)] = code
    kind[97:123], kind[65:91], kind[128:] = LOWER, UPPER, HIGH
    return kind


_KIND = _kinds()
#: Kinds whose share over the whole text and whose largest share of a block are features.
SHARES, EXTREMES = (LOWER, UPPER, DIGIT, NEWLINE, STOP, MARK, BAR, SYMBOL, HIGH), (UPPER, DIGIT, STOP, MARK, BAR, SYMBOL)
_LINE = np.zeros(256, bool)
_LINE[10] = True
FEATURES = (
    "log_bytes", "log_words", "mean_word", "long_words", *(f"share_{KINDS[k]}" for k in SHARES), *(f"block_{KINDS[k]}" for k in EXTREMES),
    "capital_words", "symbol_words", "distinct_words", "commonest_word", "stutter", "log_lines", "mean_line", "distinct_lines", "commonest_line",
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _variety(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the commonest one in each row of values ``h[first[i]:first[i + 1]]``."""
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    start = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row[start], np.diff(np.append(start, len(h))))
    return np.bincount(row[start], minlength=rows), most


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """FEATURES of the texts ``data[off[i]:off[i + 1]]``; an empty text has zeros."""
    text, rel, rows = data[off[0] : off[-1]], off - off[0], len(off) - 1
    size = np.diff(rel)
    blocks = np.maximum(1, -(-size // BLOCK))
    block_row = np.repeat(np.arange(rows), blocks)
    block_first = np.append(0, np.cumsum(blocks))
    begin = rel[block_row] + (np.arange(len(block_row)) - block_first[block_row]) * BLOCK
    length = np.diff(np.append(begin, len(text)))
    kind = _KIND[text]
    of_block = np.bincount(np.repeat(np.arange(len(begin)) * len(KINDS), length) + kind, minlength=len(begin) * len(KINDS)).reshape(-1, len(KINDS))
    total = np.add.reduceat(of_block, block_first[:-1], 0)
    # a last stretch of a few bytes says little: shares are of BLOCK / 4 bytes at least
    extreme = np.maximum.reduceat(of_block / np.maximum(length, BLOCK // 4)[:, None], block_first[:-1], 0)
    h, first, at = kernel.words(data, off, kernel.SPACE, lower=False)
    n = np.diff(first)
    inside = np.append(0, np.cumsum(~kernel.SPACE[text]))
    bounds = np.append(inside[at], inside[-1])
    width = np.diff(bounds)
    row = np.repeat(np.arange(rows), n)
    within = lambda k: np.diff(np.append((c := np.append(0, np.cumsum(kind == k)))[at], c[-1]))  # noqa: E731  of each word: nothing but blanks parts it from the next one
    capital = (within(LOWER) == 0) & (within(UPPER) >= 2)
    symbol = within(SYMBOL) > 0
    per = lambda flag: np.bincount(row, flag, rows)
    again = np.append(False, (h[1:] == h[:-1]) & (row[1:] == row[:-1])) if len(h) else np.zeros(0, bool)
    kinds_of, most = _variety(h, first)
    line, line_first, _ = kernel.words(data, off, _LINE, lower=False)
    lines = np.diff(line_first)
    line_kinds, line_most = _variety(line, line_first)
    return np.stack([
        np.log1p(size), np.log1p(n), _share(per(width), n), _share(per(width > 15), n), *(_share(total[:, k], size) for k in SHARES), *(extreme[:, k] for k in EXTREMES),
        _share(per(capital), n), _share(per(symbol), n), _share(kinds_of, n), _share(most, n), _share(per(again), n), np.log1p(lines), _share(size, lines), _share(line_kinds, lines), _share(line_most, lines),
    ], 1)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = kernel.buffers(batch.column("text"))
        rows = np.vstack([features(data, off[lo : hi + 1]) for lo, hi in kernel.spans(off)] or [np.zeros((0, len(FEATURES)))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "held_out", "numbers"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, len(FEATURES))


def _best_cut(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """Gain and place of the best cut of the bins ``lo`` to ``hi``; gain 0 if none helps."""
    if hi - lo < 2:
        return 0.0, lo
    gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
    gs, hs = g[lo:hi].sum(), h[lo:hi].sum()
    gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
    gain[(hl < LEAST) | (hs - hl < LEAST)] = 0
    at = int(gain.argmax())
    return float(gain[at]), lo + at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Step of each bin by a tree of depth 2 over sums of gradients and weights."""
    cuts = [0, len(g)]
    for _ in range(2):
        found = [_best_cut(g, h, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        cuts = sorted(cuts + [c for gain, c in found if gain > 0])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _corners(x: np.ndarray) -> tuple:
    """Sum of a table, and of its four corners for every cut behind a row and a column."""
    s = np.cumsum(np.cumsum(x, 0), 1)
    a, top, left = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1]
    return s[-1, -1], a, top - a, left - a, s[-1, -1] - top - left + a


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best pair of cuts, one in either direction, of a table of sums."""
    # sums of the four corners for every pair of cuts
    (gs, *_), (hs, *_) = corners = _corners(g), _corners(h)
    a, b, c, d = zip(*(x[1:] for x in corners), strict=True)
    gain = sum(p**2 / (q + RIDGE) for p, q in (a, b, c, d)) - gs**2 / (hs + RIDGE)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros(g.shape)
    for part, (p, q) in zip((np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :]), (a, b, c, d), strict=True):
        out[part] = -p[i, j] / (q[i, j] + RIDGE)
    return float(gain[i, j]), out


class Additive:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        q = lambda bins: [np.unique(np.quantile(c, np.arange(1, bins) / bins)) if len(c) else np.zeros(0) for c in x.T]
        self.edges, self.coarse = q(BINS), q(COARSE)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.bias = float(np.log(rate / (1 - rate)))
        if 0 < y.sum() < len(y):
            self._boost(x, y)

    def _boost(self, x: np.ndarray, y: np.ndarray) -> None:
        bins = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)]
        margin = np.full(len(y), self.bias)

        def step(at: np.ndarray, size: int, fit):
            p = 1 / (1 + np.exp(-margin))
            return fit(np.bincount(at, p - y, size), np.bincount(at, p * (1 - p), size)) * RATE

        for _ in range(TURNS):
            for f, at in enumerate(bins):
                if len(self.edges[f]):
                    move = step(at, len(self.tables[f]), _tree)
                    self.tables[f] += move
                    margin += move[at]
        bins = [np.searchsorted(e, c, "right") for e, c in zip(self.coarse, x.T, strict=True)]
        at_pair, p = {}, 1 / (1 + np.exp(-margin))
        gains = []
        for i, j in combinations([f for f, e in enumerate(self.coarse) if len(e)], 2):
            shape = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
            at_pair[i, j] = at = bins[i] * shape[1] + bins[j]
            g, h = (np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (p - y, p * (1 - p)))
            gains.append((-_quadrants(g, h)[0], i, j))
        chosen = [(i, j) for _, i, j in sorted(gains)[:PAIRS]]
        self.pairs = [(i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))) for i, j in chosen]
        for _ in range(PAIR_TURNS):
            for i, j, t in self.pairs:
                move = step(at_pair[i, j], t.size, lambda g, h, s=t.shape: _quadrants(g.reshape(s), h.reshape(s))[1].ravel())
                t += move.reshape(t.shape)
                margin += move[at_pair[i, j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.bias)
        for e, t, c in zip(self.edges, self.tables, x.T, strict=True):
            margin += t[np.searchsorted(e, c, "right")]
        for i, j, t in self.pairs:
            margin += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-margin))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null and empty texts have features of zero and are scored by their table
    entries like any other.  Rows of ``labels`` with a null doc_id or label are
    not learnt from; of several labels of a doc_id the largest counts.
    Without usable labels every score is 0.5, with labels of one kind only
    their smoothed rate.  Repeated rows and null doc_ids are kept; other
    columns of either table are not read.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    seen = stored(plain.mapInArrow(_described, "doc_id long, held_out boolean, numbers binary"), "numbers")
    usable = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    fit = seen.where("not held_out").join(usable, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "numbers").limit(FIT_ROWS).select("numbers", "quality").toArrow()
    model = docs.sparkSession.sparkContext.broadcast(Additive(_matrix(fit["numbers"]), np.asarray(fit["quality"].to_numpy(), float)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.value.score(_matrix(batch.column("numbers"))), pa.float64())], names=["doc_id", "held_out", "score"])

    out = seen.mapInArrow(of, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op13_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document scored."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
