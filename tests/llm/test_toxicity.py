import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import docs, empty
from windrow.llm import toxicity as tx
from windrow.llm.shared import table


def corpus(spark, n=600):
    r = random.Random(2)
    neutral = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(neutral) for _ in range(r.randint(20, 80))]
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = r.choice(["idiot", "zzgrok" + r.choice("abc"), "zzgrok" + r.choice("def")])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_held_out_accuracy(spark):
    d, labels, truth = corpus(spark)
    rows = tx.scored(d, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_held_out_labels_do_not_matter(spark):
    d, labels, _ = corpus(spark, 200)
    flipped = labels.selectExpr("doc_id", "quality", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, 1 - toxic, toxic) AS toxic")
    a, b = ({r["doc_id"]: r["score"] for r in tx.scored(d, x).collect()} for x in (labels, flipped))
    assert a == b


def test_whole_table(spark, tiny):
    rows = tx.op8_toxicity(spark, tiny).collect()
    assert len(rows) == table(spark, tiny, "documents").count()


def plain_scores(docs, labels):
    """Scores by strings and dictionaries; only the two fits are the module's own."""
    truth = {}
    for i, t in labels:
        if i is not None and t in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            truth[i] = max(t, truth.get(i, 0))

    def features(text):
        words = [w for w in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower().encode()) if w]
        return {("w", w) for w in words}, {("s", w[:n]) for w in words for n in tx.STEMS if len(w) > n}, len(words)

    seen, n, count = set(), [0, 0], defaultdict(lambda: [0, 0])
    for i, t in docs:
        if i in truth and (t or "", truth[i]) not in seen:
            seen.add((t or "", truth[i]))
            n[truth[i]] += 1
            w, s, _ = features(t)
            for f in w | s:
                count[f][truth[i]] += 1
    good = sorted(f for f, (c, x) in count.items() if x >= tx.MIN_DOCS and x >= tx.MIN_PRECISION * (x + c + 2) and math.log((x + 0.3) / (n[1] + 1)) - math.log((c + 0.3) / (n[0] + 1)) >= tx.MIN_LOG_ODDS)
    number = {f: j for j, f in enumerate(good)}

    def hashed(f):
        data = np.frombuffer(f[1] + b"xx", np.uint8)
        return int(tx._lexicon_hashes([f[1].decode()])[0]) if f[0] == "w" else int(tx._stems(data, np.array([0]))[tx.STEMS.index(len(f[1])), 0])

    deal = {f: hashed(f) % (tx.WORD_LISTS if f[0] == "w" else tx.STEM_LISTS) for f in good}
    rows = []
    for i, t in docs:
        w, s, k = features(t)
        lex = sum(("w", x.encode()) in w for x in tx.LEXICON)
        fw, fs = [f for f in w if f in number], [f for f in s if f in number]
        masked = bool(re.search(r"\b[a-z]{1,3}[*#@$]{2,}[a-z]{0,3}\b", t or "", re.I | re.A)) and k > 0
        address = lex > 0 and any(m[1].lower() in tx.LEXICON for m in re.finditer(r"\byou(?:'re| are)? (?:an? |such an? |all )?(\w+)", t or "", re.I | re.A))
        hits = lex + len(fw) + len(fs)
        vote = [lex > 0, *(any(deal[f] == j for f in fw) for j in range(tx.WORD_LISTS)), *(any(deal[f] == j for f in fs) for j in range(tx.STEM_LISTS)), masked, address, hits > 0 and hits >= 0.01 * k]
        vote = (*map(int, vote), -int(not lex and not fw), -int(not fs))
        extra = [len(good)] * (lex > 0) + [len(good) + 1] * (lex > 1) + [len(good) + 2] * masked + [len(good) + 3] * address
        rows.append((i, vote, np.array([number[f] for f in fw + fs] + extra, np.int64), zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0))
    pattern = Counter(v for _, v, _, held in rows if not held)
    model = tx.LabelModel(np.array(list(pattern)), np.array(list(pattern.values())), np.mean(list(truth.values())))
    fit = [(v, f) for i, v, f, _ in rows if i in truth]
    w = tx.fit_linear([f for _, f in fit], model.posterior(np.array([v for v, _ in fit])), len(good) + 4)
    margin = [float(np.clip(w[f].sum() + w[-1], -tx.MARGIN, tx.MARGIN)) for _, _, f, _ in rows]
    bins = Counter((truth[i], min(math.floor((m / tx.MARGIN + 1) / 2 * tx.BINS), tx.BINS - 1)) for (i, *_), m in zip(rows, margin, strict=True) if i in truth)
    cut = tx._cut([{"toxic": t, "at": a, "count": k} for (t, a), k in bins.items()], float(w[-1]))
    return [(i, held, 1 / (1 + math.exp(cut - m))) for (i, _, _, held), m in zip(rows, margin, strict=True)]


def test_whole_table_equals_brute_force(spark, tiny):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, tiny, "documents").collect()]
    want = sorted(plain_scores(docs, [(r["doc_id"], r["toxic"]) for r in table(spark, tiny, "labels").collect()]))
    got = sorted((r["doc_id"], r["held_out"], r["score"]) for r in tx.op8_toxicity(spark, tiny).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-6)


@pytest.mark.parametrize(("sf", "least"), [("sf0.1", 0.97)])
def test_held_out_labels_are_met(spark, sf, least):
    """Accuracy, and recall of toxic documents, over labels that nothing was learnt from."""
    d = f"/root/testdata/{sf}"
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, d, "labels").collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in tx.op8_toxicity(spark, d).collect() if r["held_out"] and r["doc_id"] in truth]
    right = sum(p == t for p, t in held)
    caught = sum(p for p, t in held if t)
    print(sf, len(held), right, sum(t for _, t in held), caught)
    assert right >= least * len(held), (right, len(held), caught)


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None), (4, 0), (6, 0), (1, 0)], "doc_id long, toxic int").selectExpr("*", "1 AS quality", "2 AS text")
    rows = tx.scored(docs(spark), labels).collect()
    assert len(rows) == 12
    kept = tx.without_toxic(docs(spark), labels)
    assert kept.columns == docs(spark).columns
    none = labels.limit(0)
    assert tx.scored(docs(spark), none).count() == 12
    d = spark.createDataFrame([(1, "you are an idiot and a moron"), (2, "a calm day")], "doc_id long, text string")
    assert {r["doc_id"] for r in tx.without_toxic(d, none).collect()} >= {2}
    assert tx.scored(empty(spark), labels).count() == 0


def test_label_model_recovers_accuracies():
    g = np.random.default_rng(5)
    y = g.random(4000) < 0.2
    votes = np.zeros((4000, len(tx.VOTERS)), int)
    for j in range(10):
        speak = g.random(4000) < np.where(y, 0.7, 0.03)
        votes[:, j] = speak
    votes[:, 1] = votes[:, 0]  # a voter that repeats another
    votes[:, 10] = np.where(votes[:, :5].any(1), 0, -1)
    m = tx.LabelModel(votes, np.ones(4000), 0.2)
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.97
    assert m.rho[0, 1] > 0.5
    assert m.weight[0] < m.weight[5]
    assert abs(m.p[1, 5, 2] - 0.7) < 0.06


def test_rare_toxic_words_are_induced_beside_many_frequent_ones(spark):
    common = [f"c{i:05d}" for i in range(24_000)]
    rows = [(j, " ".join(common), t) for j, t in enumerate((1, 1, 1, 1, 0, 0, 0, 0))]
    rows = [(j, f"{text} only{j}", t) for j, text, t in rows]
    rows += [(100 + j, f"zqgrok {j}", 1) for j in range(3)] + [(200 + j, f"calm {j}", 0) for j in range(60)]
    found = tx.induced(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert list(found) == sorted(found)
    assert tx._lexicon_hashes(["zqgrok"])[0] in found
    assert len(found) == 1 + 2  # its stems of 4 and 5 bytes


def test_unpack():
    v = [1, 0, -1, 1, 1, 0, 0, -1, 1, 0, -1, -1]
    code = 0
    for x in v:
        code = code * 3 + x + 1
    assert tx.unpack(np.array([code]))[0].tolist() == v
