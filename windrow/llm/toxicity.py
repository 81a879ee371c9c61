"""Toxicity by weak supervision.

1. Words and word beginnings that mark toxic texts are induced from all
   labelled training rows (each distinct text once).
2. ``VOTERS`` lexicon and pattern voters vote toxic, clean or not at all on
   every training text.
3. A generative label model is fitted by EM to the counts of vote patterns:
   class-conditional vote probabilities (the voters' accuracies), and residual
   correlations, by which voters that repeat each other share their weight.
4. A logistic classifier over the induced features and the pattern counts is
   trained on the model's posterior labels, and its margin is cut where the
   labelled training rows are split with the fewest errors.

Labels are read for training rows only (crc32 of the doc_id's text is not
divisible by ``FOLDS``); neither labels nor any column but ``text`` is ever an
input of a score.  Corpus counts cover all training rows; only the final fit
uses a bounded sample (``FIT_ROWS``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm import kernel
from windrow.llm.shared import drop_stored, named, stored, table, without

FOLDS = 5
#: Largest margin, and bins of the histograms that calibrate the cut.
MARGIN, BINS = 20.0, 2_000
#: Rows of the classifier's sample, and features kept by the induction.
FIT_ROWS, FEATURES = 20_000, 2_048
#: Features that a worker holds before it counts them.
HELD_FEATURES = 1 << 20
#: Byte lengths of word beginnings that are features beside whole words.
STEMS = (4, 5, 6)
MIN_DOCS, MIN_LOG_ODDS = 3, 2.5
#: Share of toxic texts among the texts with a feature (smoothed by two clean ones).
MIN_PRECISION = 0.6

#: Fixed word list: English insults and abuse of common public lists.
LEXICON = (
    "idiot", "idiots", "moron", "morons", "stupid", "trash", "garbage", "scum", "loser", "losers", "clown", "clowns", "pathetic", "worthless",
    "disgusting", "dumb", "dumbass", "imbecile", "retard", "retarded", "bastard", "bitch", "asshole", "fuck", "fucking", "shit", "crap", "cunt",
    "dick", "slut", "whore", "vermin", "filth", "filthy", "jerk", "creep", "freak", "ugly", "hate", "kill", "die", "subhuman", "parasite", "pig",
)
_MASKED = re.compile(rb"\b[a-z]{1,3}[*#@$]{2,}[a-z]{0,3}\b", re.I)
_ADDRESS = re.compile(rb"\byou(?:'re| are)? (?:an? |such an? |all )?(\w+)", re.I)

#: Lists that the induced words and the induced beginnings are dealt into by hash: each list is a voter of its own.
WORD_LISTS, STEM_LISTS = 4, 2
VOTERS = ("lexicon", *(f"words_{j}" for j in range(WORD_LISTS)), *(f"stems_{j}" for j in range(STEM_LISTS)), "masked", "address", "dense", "no_word", "no_stem")


def held_out(doc_id: Column) -> Column:
    """True of rows that labels are never learnt from; a null doc_id counts as text of no characters."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def _features(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(row, distinct word hashes, distinct stem hashes, words) of every text, case folded."""
    data, off = kernel.buffers(pc.utf8_lower(batch.column("text").fill_null("").cast(pa.large_string())))
    for lo, hi in kernel.spans(off):
        part = off[lo : hi + 1]
        h, first, at = kernel.words(data, part, kernel.NON_WORD, lower=False)
        stems = _stems(data[part[0] : part[-1]], at) if len(at) else None
        for i in range(lo, hi):
            a, b = first[i - lo], first[i - lo + 1]
            s = stems[:, a:b].ravel() if b > a else np.zeros(0, np.uint64)
            yield i, np.unique(h[a:b]), np.unique(s[s > 0]), int(b - a)


def _stems(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the first bytes of each word for every length in STEMS; 0 for words that are not longer."""
    out = np.zeros((len(STEMS), len(at)), np.uint64)
    total, longer = np.zeros(len(at), np.uint64), np.ones(len(at), bool)
    for j in range(max(STEMS) + 1):
        where = np.minimum(at + j, len(text) - 1)
        longer &= (at + j < len(text)) & ~kernel.NON_WORD[text[where]]
        if j in STEMS:
            out[STEMS.index(j)] = np.where(longer, kernel.mix(total + np.uint64(1000 + j)) | np.uint64(1), np.uint64(0))
        total = total + kernel._BYTE[text[where]] * kernel._WEIGHT[j]
    return out


def _lexicon_hashes(lexicon) -> np.ndarray:
    data, off = kernel.buffers(pa.array(list(lexicon), pa.string()))
    return np.sort(kernel.words(data, off, kernel.NON_WORD, lower=False)[0])


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Positions in ``ordered`` of those values that it holds."""
    if not len(ordered) or not len(values):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return at[ordered[at] == values]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clean and toxic texts with each feature, partially counted."""

    def counted(found: tuple[list[np.ndarray], list[np.ndarray]]) -> pa.RecordBatch:
        both = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found]
        f, at = np.unique(np.concatenate(both), return_inverse=True)
        n = [np.bincount(x, minlength=len(f)).astype(np.int64) for x in np.split(at, [len(both[0])])]
        return pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(n[0]), pa.array(n[1])], names=["feature", "clean", "toxic"])

    found, held = ([], []), 0
    for batch in batches:
        toxic = np.asarray(batch.column("toxic"), np.int64)
        for i, w, s, _ in _features(batch):
            found[toxic[i]].append(np.unique(np.concatenate([w, s])))
            held += len(w) + len(s)
            if held > HELD_FEATURES:
                yield counted(found)
                found, held = ([], []), 0
    if held:
        yield counted(found)


def induced(train: DataFrame) -> np.ndarray:
    """Hashes, in order, of the words and word beginnings that mark toxic texts in ``train(doc_id, text, toxic)``.

    Every labelled row counts; of equal texts one does.  All features are
    counted and held against the bounds where they are; the best FEATURES
    reach the driver.
    """
    once = train.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min("doc_id").alias("one")).select("one")
    rows = train.join(once.distinct(), train["doc_id"] == F.col("one"), "left_semi")
    n = {int(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}
    counts = rows.select("text", "toxic").mapInArrow(_counts, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.3) / (n.get(1, 0) + 1)) - F.log((F.col("clean") + 0.3) / (n.get(0, 0) + 1))
    good = counts.where(F.col("toxic") >= MIN_DOCS).where(F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("clean") + 2)).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
    top = good.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "feature").limit(FEATURES).toArrow()
    return np.sort(np.asarray(top["feature"], np.int64).view(np.uint64))


def _votes(lex: int, words: np.ndarray, stems: np.ndarray, n_words: int, masked: bool, address: bool) -> list[int]:
    """Votes in the order of VOTERS, from the lexicon's hits and the hashes of induced words and beginnings in the text."""
    lists = [len(w) > 0 and bool((w % np.uint64(k) == j).any()) for w, k in ((words, WORD_LISTS), (stems, STEM_LISTS)) for j in range(k)]
    hits = lex + len(words) + len(stems)
    spoken = [lex > 0, *lists, masked, address, hits > 0 and hits >= 0.01 * n_words]
    return [*map(int, spoken), -int(not lex and not len(words)), -int(not len(stems))]


def _observe(model) -> callable:
    """Votes and feature numbers of every text; the last number counts the lexicon's words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = model.value
        lexicon = _lexicon_hashes(LEXICON)
        names = set(w.encode() for w in LEXICON)
        for batch in batches:
            codes, feats = np.zeros(batch.num_rows, np.int32), []
            raw = batch.column("text")
            for i, w, s, n in _features(batch):
                lex, fw, fs = len(_within(w, lexicon)), _within(w, features), _within(s, features)
                text = raw[i].as_buffer() if raw[i].is_valid else b""
                masked = bool(n and _MASKED.search(text))
                address = bool(lex and any(m[1].lower() in names for m in _ADDRESS.finditer(text)))
                code = 0
                for v in _votes(lex, features[fw], features[fs], n, masked, address):
                    code = code * 3 + v + 1
                codes[i] = code
                extra = [len(features)] * bool(lex) + [len(features) + 1] * (lex > 1) + [len(features) + 2] * masked + [len(features) + 3] * address
                feats.append(np.concatenate([fw, fs, np.array(extra, np.int64)]))
            off = np.concatenate([[0], np.cumsum([len(x) for x in feats])]).astype(np.int32)
            flat = np.concatenate(feats) if feats else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(codes), pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int32()))], names=["doc_id", "held_out", "votes", "features"]
            )

    return of


def unpack(codes: np.ndarray) -> np.ndarray:
    """Votes (-1, 0, 1) of each code, a column a voter."""
    out = np.zeros((len(codes), len(VOTERS)), np.int64)
    rest = codes.astype(np.int64)
    for j in reversed(range(len(VOTERS))):
        out[:, j] = rest % 3 - 1
        rest = rest // 3
    return out


class LabelModel:
    """Generative model of votes given the hidden label, with shared weight of correlated voters."""

    def __init__(self, votes: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 4, steps: int = 40):
        self.prior = float(np.clip(prior, 0.005, 0.5))
        n, self.weight = counts.astype(float), np.ones(votes.shape[1])
        # start: toxic voters mostly right when they speak, clean voters likewise
        self.p = np.zeros((2, votes.shape[1], 3))
        spoke = np.stack([(n[:, None] * (votes == v)).sum(0) for v in (-1, 0, 1)], 1) / max(1.0, n.sum())
        for y in (0, 1):
            tilt = np.array([0.15, 1.0, 6.0]) if y else np.array([1.2, 1.0, 0.3])
            self.p[y] = (spoke + 1e-4) * tilt
        self.p /= self.p.sum(-1, keepdims=True)
        self.rho = np.zeros((votes.shape[1],) * 2)
        for _ in range(rounds):
            for _ in range(steps):
                q = self.posterior(votes)
                for y, w in ((0, n * (1 - q)), (1, n * q)):
                    for k, v in enumerate((-1, 0, 1)):
                        self.p[y, :, k] = ((votes == v) * w[:, None]).sum(0) + 0.05
                self.p /= self.p.sum(-1, keepdims=True)
                self.prior = float(np.clip((n * q).sum() / max(1.0, n.sum()), 0.002, 0.6))
            self.rho = self._residual(votes, n)
            self.weight = 1 / (1 + np.clip(self.rho, 0, None).sum(1) - np.clip(np.diag(self.rho), 0, None))

    def log_ratio(self, votes: np.ndarray) -> np.ndarray:
        ratio = np.log(self.p[1]) - np.log(self.p[0])
        return sum(self.weight[j] * ratio[j, votes[:, j] + 1] for j in range(votes.shape[1])) + np.log(self.prior / (1 - self.prior))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_ratio(votes), -40, 40)))

    def _residual(self, votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Correlation of votes that the label does not explain."""
        q, centre = self.posterior(votes), np.array([-1.0, 0.0, 1.0])
        cov = np.zeros((votes.shape[1],) * 2)
        for y, w in ((0, n * (1 - q)), (1, n * q)):
            d = votes - self.p[y] @ centre
            cov += (d * w[:, None]).T @ d
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        return cov / np.outer(sd, sd)


def fit_linear(features: list[np.ndarray], label: np.ndarray, size: int, l2: float = 0.02, steps: int = 300) -> np.ndarray:
    """Weights (the last is the bias) of a logistic classifier on soft labels, by accelerated gradient steps."""
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    col = np.concatenate(features).astype(np.int64) if len(features) else np.zeros(0, np.int64)
    w, v, rate = np.zeros(size + 1), np.zeros(size + 1), 4.0
    w[-1] = v[-1] = np.log((label.mean() + 1e-3) / (1 - label.mean() + 1e-3)) if len(label) else -3.0
    balance = np.where(label >= 0.5, 0.5 / max(1.0, (label >= 0.5).sum()), 0.5 / max(1.0, (label < 0.5).sum()))
    for t in range(steps if len(label) else 0):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[col], len(features)) + v[-1], -40, 40)))
        g = (p - label) * balance
        grad = np.append(np.bincount(col, g[row], size) + l2 * v[:-1] / 20, g.sum())
        new = v - rate * grad
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null and empty texts get the score of a text without any feature.  Rows
    of ``labels`` with a null doc_id or label are not learnt from; without
    usable labels the fixed lexicon and patterns alone speak, and the
    classifier is fitted on FIT_ROWS unlabelled rows.  Repeated rows
    and null doc_ids are kept; other columns of either table are not read.
    """
    sc = docs.sparkSession.sparkContext
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # the labelled training texts move once, by a merge join at every size, and are kept for the passes over them
    train = plain.where(~held_out(F.col("doc_id"))).hint("merge").join(usable, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    train = stored(train, "train")
    model = induced(train)
    drop_stored(train)
    shared = sc.broadcast(model)
    seen = stored(plain.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(_observe(shared), "doc_id long, held_out boolean, votes int, features array<int>"), "votes")
    pattern = seen.where("not held_out").groupBy("votes").count().toArrow()  # 3 ** len(VOTERS) rows at most
    rate = usable.agg(F.avg("toxic")).first()[0]
    votes = unpack(np.asarray(pattern["votes"], np.int64)) if pattern.num_rows else np.zeros((0, len(VOTERS)), np.int64)
    label_model = LabelModel(votes, np.asarray(pattern["count"], np.int64), rate if rate is not None else 0.05)
    sample = seen.where("not held_out").join(usable.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    if rate is None:
        sample = seen.where("not held_out").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    fit = sample.select("votes", "features").toArrow()
    soft = label_model.posterior(unpack(np.asarray(fit["votes"], np.int64))) if fit.num_rows else np.zeros(0)
    size = len(model) + 4
    w = fit_linear([np.asarray(x.as_py(), np.int64) for x in fit["features"]], soft, size)
    weights = sc.broadcast(w)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            lists = batch.column("features")
            flat, off = np.asarray(lists.flatten(), np.int64), np.append(0, np.cumsum(np.asarray(pc.list_value_length(lists), np.int64)))
            total = np.append(0.0, np.cumsum(w[flat]))
            margin = np.clip(total[off[1:]] - total[off[:-1]] + w[-1], -MARGIN, MARGIN)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(margin)], names=["doc_id", "held_out", "margin"])

    out = seen.mapInArrow(of, "doc_id long, held_out boolean, margin double")
    at = F.least(F.floor((F.col("margin") / MARGIN + 1) / 2 * BINS), F.lit(BINS - 1)).cast("int")
    histogram = out.join(usable, "doc_id").groupBy("toxic", at.alias("at")).count().collect()
    cut = _cut(histogram, float(w[-1]))
    done = out.select("doc_id", "held_out", (1 / (1 + F.exp(F.lit(cut) - F.col("margin")))).alias("score"))
    return done.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _cut(histogram, bias: float) -> float:
    """Margin with the fewest wrong training rows, the middle of equally good ones, and above that of a text without features."""
    h = np.zeros((2, BINS))
    for r in histogram:
        h[int(r["toxic"]), r["at"]] += r["count"]
    if not h[1].any():
        return max(0.0, bias + 1e-6)
    missed, alarms = np.concatenate([[0], np.cumsum(h[1])]), h[0].sum() - np.concatenate([[0], np.cumsum(h[0])])
    edges = (np.arange(BINS + 1) / BINS * 2 - 1) * MARGIN
    wrong = np.where(edges > bias, missed + alarms, np.inf)
    best = np.flatnonzero(wrong == wrong.min())
    best = best[: int(np.argmax(np.append(np.diff(best) > 1, True))) + 1]
    return float(edges[best[len(best) // 2]])


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text scores 0.5 or more, with or without a doc_id; rows that share a doc_id go together."""
    bad = scored(named(docs), labels).where("predicted = 1").select(F.col("doc_id").alias("id")).distinct()
    return without(docs, stored(bad, "toxic"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document scored."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
