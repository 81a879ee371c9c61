"""URL filter: host and path rules, and the ratio of two character language models.

URLs that a rule decides train one smoothed variable-order Markov model for
accepted and one for rejected URLs.  Contexts of up to ``ORDER`` characters
over ``SYMBOLS`` symbols are interpolated (Witten-Bell) with the next shorter
one, and contexts seen fewer than ``SEEN`` times fall back to it altogether.
A URL's score is the length-normalised difference of the log-likelihoods; the
threshold is calibrated on the score histograms of both classes, over the
``HELD``-th part of the training URLs, by hash, that the models do not see.

The symbol alphabet is fixed, so counts and model have at most
``SYMBOLS ** (ORDER + 1)`` entries a class whatever the corpus, while the
counting covers every URL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.shared import table

ORDER, SYMBOLS, SEEN = 3, 40, 4
BINS, RANGE = 2000, 8.0
#: One training URL in so many calibrates the threshold and is not counted.
HELD = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules as (action, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

_CODE = np.full(256, 38, np.int64)  # 38: any other byte
_CODE[97:123] = _CODE[65:91] = np.arange(26)
_CODE[48:58] = 26
for _j, _c in enumerate(b"./-_?=&#:%~"):
    _CODE[_c] = 27 + _j
_EDGE = 39


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def held_out(url: Column) -> Column:
    """True of training URLs that only calibrate the threshold."""
    return F.pmod(F.crc32(F.coalesce(url, F.lit("")).cast("binary")), F.lit(HELD)) == 0


def rule_of(rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, action) of the longest rule that fits ``host`` and ``path``; of equally long ones the first by text."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def _codes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Symbols of each URL between edges, with ORDER edges before it."""
    for u in batch.column("url"):
        raw = (u.as_py() or "").encode()
        yield np.concatenate([np.full(ORDER, _EDGE), _CODE[np.frombuffer(raw, np.uint8)], [_EDGE]]) if raw else np.zeros(0, np.int64)


def _grams(code: np.ndarray) -> np.ndarray:
    """Number of the ORDER + 1 symbols that end at each symbol."""
    n = len(code) - ORDER
    out = np.zeros(max(0, n), np.int64)
    for j in range(ORDER + 1):
        out = out * SYMBOLS + code[j : j + n] if n > 0 else out
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = {}
    for batch in batches:
        accepted = np.asarray(batch.column("accepted").to_pylist(), bool)
        codes = [_grams(c) for c in _codes(batch)]
        for label in (True, False):
            mine = [c for c, a in zip(codes, accepted, strict=True) if a == label]
            if mine:
                gram, n = np.unique(np.concatenate(mine), return_counts=True)
                if label in total:
                    both, where = np.unique(np.concatenate([total[label][0], gram]), return_inverse=True)
                    n = np.bincount(where, np.concatenate([total[label][1], n])).astype(np.int64)
                    gram = both
                total[label] = gram, n
    for label, (gram, n) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(gram)), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["accepted", "gram", "n"])


def log_model(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log P(symbol | ORDER symbols before it) for every context."""
    full = np.bincount(gram, n, SYMBOLS ** (ORDER + 1)).reshape((SYMBOLS,) * (ORDER + 1))
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(ORDER + 1):
        count = full.sum(axis=tuple(range(ORDER - order)))
        seen = count.sum(-1, keepdims=True)
        kinds = (count > 0).sum(-1, keepdims=True)
        finer = (count + kinds * p) / np.maximum(seen + kinds, 1)
        p = np.where(seen >= SEEN, finer, np.broadcast_to(p, count.shape))
    return np.log(p)


def _scores(model) -> callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = model.value
        for batch in batches:
            score = [float(ratio[g].mean()) if len(g := _grams(c)) else 0.0 for c in _codes(batch)]
            cols = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])

    return of


def threshold_of(histogram: list[tuple[bool, int, int]]) -> float:
    """Score that best balances the errors on accepted and rejected URLs."""
    h = np.zeros((2, BINS))
    for accepted, at, n in histogram:
        h[int(accepted), at] += n
    h /= np.maximum(h.sum(1, keepdims=True), 1)
    error = np.concatenate([[0], np.cumsum(h[1])]) + 1 - np.concatenate([[0], np.cumsum(h[0])])
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float((best[len(best) // 2] / BINS - 0.5) * RANGE)


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row.

    A rule decides where one fits; elsewhere the score does.  A null URL, or
    one without ``://``, has an empty host and path and no rule; a null or
    empty URL has score 0.  Without training URLs of both classes all scores
    are 0 and what no rule decides is allowed.  Repeated rows and null ids
    are kept; other columns are not read.
    """
    sc = pages.sparkSession.sparkContext
    parsed = pages.select("page_id", F.col("url").cast("string").alias("url"))
    parsed = parsed.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    parsed = parsed.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")}).withColumn("hit", rule_of(rules))
    parsed = parsed.withColumn("held", held_out(F.col("url")))
    train = parsed.where("hit is not null").select("url", (F.col("hit.action") == "allow").alias("accepted"), "held")
    counts = train.where("not held").select("url", "accepted").mapInArrow(_count, "accepted boolean, gram long, n long").groupBy("accepted", "gram").agg(F.sum("n").alias("n")).toArrow()
    accepted = np.asarray(counts["accepted"].to_pylist(), bool)
    gram, n = (np.asarray(counts[c], np.int64) for c in ("gram", "n"))
    if accepted.any() and not accepted.all():
        ratio = (log_model(gram[accepted], n[accepted]) - log_model(gram[~accepted], n[~accepted])).astype(np.float32).ravel()
    else:
        ratio = np.zeros(SYMBOLS ** (ORDER + 1), np.float32)
    model = sc.broadcast(ratio)
    scored = parsed.select("page_id", "url", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.action").alias("action"), "held").mapInArrow(
        _scores(model), "page_id long, url string, host string, path string, rule string, action string, held boolean, score double"
    )
    at = F.least(F.greatest(F.floor((F.col("score") / RANGE + 0.5) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    rows = scored.where("action is not null").groupBy((F.col("action") == "allow").alias("accepted"), at.alias("at"), "held").count().collect()  # 4 BINS rows at most
    apart = [(r["accepted"], r["at"], r["count"]) for r in rows if r["held"]]
    if len({accepted for accepted, *_ in apart}) < 2:  # tables of a few URLs: no class may be absent from the calibration
        apart = [(r["accepted"], r["at"], r["count"]) for r in rows]
    cut = threshold_of(apart) if ratio.any() else 0.0
    verdict = F.coalesce("action", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op7_urls(spark, sf_dir: str) -> DataFrame:
    """Contract query: every page's URL judged."""
    return judged(table(spark, sf_dir, "pages"))
