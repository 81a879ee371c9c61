"""Quality: features and table sums against plain versions, and held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import helpers
from windrow.llm import kernel, quality

TEXTS = [
    "Plain prose, of a few words. And one more line!\nand one more line",
    "", None, "   \n\t\n ", "x", "STOP!! SHOUTING!! NOW!!", "a | b | c | d", "w### x$$$ y%%%", "word word word word other", "line\nline\nline\nother", "é ü 中文 \U0001f600", "1234 " * 300, "calm " * 200 + "#$%&" * 100 + " calm" * 200,
]


def kind(b):
    c = chr(b)
    if b >= 128:
        return "high"
    for name, pattern in (("lower", "[a-z]"), ("upper", "[A-Z]"), ("digit", "[0-9]"), ("newline", "\n"), ("space", r"[ \t\v\f\r]"), ("stop", "[.,;:'\"()-]"), ("mark", "[!?]"), ("bar", r"\|"), ("symbol", r"[#$%&*+/<=>@\[\\\]^_`{}~]")):
        if re.fullmatch(pattern, c):
            return name
    return "other"


def plain_features(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^ \t\n\v\f\r]+", raw)
    lines = re.findall(rb"[^\n]+", raw)
    share = lambda a, b: a / max(b, 1)
    count = Counter(map(kind, raw))
    most = lambda v: max(Counter(v).values(), default=0)
    blocks = [raw[i : i + 256] for i in range(0, len(raw), 256)] or [b""]
    n = len(words)
    out = [math.log1p(len(raw)), math.log1p(n), share(sum(map(len, words)), n), share(sum(len(w) > 15 for w in words), n)]
    out += [share(count[k], len(raw)) for k in ("lower", "upper", "digit", "newline", "stop", "mark", "bar", "symbol", "high")]
    out += [max(sum(kind(b) == k for b in x) / max(len(x), 64) for x in blocks) for k in ("upper", "digit", "stop", "mark", "bar", "symbol")]
    of = lambda w, k: sum(kind(b) == k for b in w)
    out += [share(sum(of(w, "lower") == 0 and of(w, "upper") >= 2 for w in words), n), share(sum(of(w, "symbol") > 0 for w in words), n)]
    out += [share(len(set(words)), n), share(most(words), n), share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n)]
    return [*out, math.log1p(len(lines)), share(len(raw), len(lines)), share(len(set(lines)), len(lines)), share(most(lines), len(lines))]


def computed(texts):
    data, off = kernel.buffers(pa.array(texts, pa.string()))
    return np.vstack([quality.features(data, off[a : b + 1]) for a, b in kernel.spans(off)])


def test_features_equal_plain_ones():
    assert len(quality.FEATURES) == len(plain_features("a"))
    assert np.allclose(computed(TEXTS), [plain_features(t) for t in TEXTS])
    long = ["prose of words " * 90_000, "short", "JUNK!! " * 200_000]  # spans of their own
    assert np.allclose(computed(long), [plain_features(t) for t in long])


def test_score_is_the_sum_of_table_entries():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)
    m = quality.Additive(x, y)
    for row, score in zip(x[:50], m.score(x[:50]), strict=True):
        total = m.bias + sum(t[sum(e <= v for e in edges)] for edges, t, v in zip(m.edges, m.tables, row, strict=True))
        total += sum(t[sum(e <= row[i] for e in m.coarse[i]), sum(e <= row[j] for e in m.coarse[j])] for i, j, t in m.pairs)
        assert score == pytest.approx(1 / (1 + math.exp(-total)))
    # exclusive or is beyond single features: the pair's table carries it
    assert (0, 1) in [(i, j) for i, j, _ in m.pairs]
    fresh = draw.normal(size=(400, 5))
    truth = (fresh[:, 0] > 0) ^ (fresh[:, 1] > 0) | (fresh[:, 2] > 1)
    assert ((m.score(fresh) >= 0.5) == truth).mean() > 0.85


def plain_quadrants(g, h):
    best = (-1.0, None)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = [(g[a, b].sum(), h[a, b].sum()) for a in (np.s_[:i], np.s_[i:]) for b in (np.s_[:j], np.s_[j:])]
            gain = sum(p**2 / (q + quality.RIDGE) for p, q in parts) - g.sum() ** 2 / (h.sum() + quality.RIDGE)
            if gain > best[0] + 1e-12:
                best = gain, [-p / (q + quality.RIDGE) for p, q in parts]
    return best


def test_trees_take_the_best_cuts():
    draw = np.random.default_rng(4)
    for _ in range(30):
        g, h = draw.normal(size=(6, 7)), draw.uniform(0.5, 3, size=(6, 7))
        gain, move = quality._quadrants(g, h)
        want, steps = plain_quadrants(g, h)
        assert gain == pytest.approx(want)
        assert [move[0, 0], move[0, -1], move[-1, 0], move[-1, -1]] == pytest.approx(steps)
        line, weight = g.sum(0), h.sum(0)
        gain, at = quality._best_cut(line, weight, 0, 7)
        assert gain == pytest.approx(max(line[:i].sum() ** 2 / (weight[:i].sum() + 1) + line[i:].sum() ** 2 / (weight[i:].sum() + 1) - line.sum() ** 2 / (weight.sum() + 1) for i in range(1, 7)))
        assert len(set(quality._tree(line, weight))) <= 4


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_held_out_labels(spark, larger):
    rows = {r["doc_id"]: r for r in quality.op13_quality(spark, larger).collect()}
    docs = [r["doc_id"] for r in spark.read.parquet(f"{larger}/documents.parquet").select("doc_id").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    assert sorted(rows) == sorted(docs)
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [i for i in labels if i in rows and rows[i]["held_out"]]
    assert len(held) > 50
    assert sum(rows[i]["predicted"] == labels[i] for i in held) / len(held) >= 0.95


def test_only_training_labels_count(spark, larger):
    """Turning every held-out label leaves all scores as they are; so does another language, source or length."""
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0 then 1 - quality else quality end as quality", "toxic")
    other = docs.selectExpr("doc_id", "text", "'xx' as lang", "cast(doc_id as string) as source", "0L as n_chars")
    one = {tuple(r) for r in quality.scored(docs, labels).collect()}
    assert one == {tuple(r) for r in quality.scored(other, turned).collect()}


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, None), (77, 1)], "doc_id long, quality int")
    for y in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = quality.scored(helpers.docs(spark), y).collect()
        assert len(rows) == len(helpers.AWKWARD)
        assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.scored(helpers.docs(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.scored(helpers.empty(spark), labels).count() == 0
