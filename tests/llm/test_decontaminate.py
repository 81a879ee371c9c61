import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import LONG, docs, empty
from windrow.llm import decontaminate as dc
from windrow.llm.shared import table


@pytest.fixture(scope="module")
def items(spark, tiny):
    return [(r["item_id"], r["text"]) for r in table(spark, tiny, "benchmark").collect()]


def wrapped(items, rate, seed):
    r, out = random.Random(seed), []
    for i, t in items:
        w = [x if r.random() >= rate else f"zz{r.randint(0, 999)}" for x in t.split()]
        pad = [f"p{r.randint(0, 9999)}" for _ in range(80)]
        out.append((i, " ".join(pad + w + pad)))
    return out


@pytest.mark.parametrize(("rate", "least"), [(0.0, 1.0), (0.05, 0.97), (0.1, 0.95)])
def test_planted_items_are_found(spark, tiny, items, rate, least):
    d = spark.createDataFrame(wrapped(items, rate, 4), "doc_id long, text string")
    got = dc.overlaps(d, table(spark, tiny, "benchmark")).collect()
    assert all(r["doc_id"] == r["item_id"] for r in got)
    assert len({r["doc_id"] for r in got}) >= least * len(items)


def test_clean_texts_stay(spark, tiny, items):
    r = random.Random(1)
    words = [w for _, t in items for w in t.split()]
    d = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(400))) for i in range(60)], "doc_id long, text string")
    assert dc.overlaps(d, table(spark, tiny, "benchmark")).count() == 0
    assert dc.decontaminated(d, table(spark, tiny, "benchmark")).count() == 60


def plain_words(t):
    return "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in (t or "").lower()).split()


def brute(texts, items):
    """Pairs with an overlap that counts: every item laid at every place of every text."""
    number, out = {}, set()
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in plain_words(t)], np.int64)
    known = [(i, code(t)) for i, t in items]
    for doc, t in texts:
        x = code(t)
        for item, y in known:
            if len(y) < dc.SHORTEST:
                continue
            at, where = np.nonzero(x[:, None] == y[None, :]) if len(x) < 30_000 else (np.zeros(0, int),) * 2
            shift, n = np.unique(at - where, return_counts=True)
            least = len(y) if len(y) < dc.TOLERANT else dc.MIN_EQUAL * min(len(y), dc.MIN_WORDS)
            for k in shift[n >= least - 1e-9]:
                lo, hi = max(0, k), min(len(x), k + len(y))
                e = x[lo:hi] == y[lo - k : hi - k]
                if len(y) <= dc.MIN_WORDS:
                    hit = True
                else:
                    a, b, same = dc.best_stretch(e)
                    hit = b - a >= dc.MIN_WORDS and same >= dc.MIN_EQUAL * (b - a)
                if hit:
                    out.add((doc, item))
                    break
    return out


def test_whole_table_against_brute_force(spark, tiny, items):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, tiny, "documents").collect()]
    want = brute(texts, items)
    got = {(r["doc_id"], r["item_id"]) for r in dc.op1_decontaminate(spark, tiny).collect()}
    assert got <= want
    assert len(got) >= 0.97 * len(want) > 0


def test_edited_items_against_brute_force(spark, tiny, items):
    rows = wrapped(items, 0.08, 5) + [(1000 + i, " ".join(t.split()[: len(t.split()) // 2] + ["mid"] * 3 + t.split()[len(t.split()) // 2 :])) for i, t in items]
    want = brute(rows, items)
    got = {(r["doc_id"], r["item_id"]) for r in dc.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), table(spark, tiny, "benchmark")).collect()}
    assert got <= want
    assert len(got) >= 0.97 * len(want)


def test_repetitive_and_long_overlaps(spark):
    """One word thousands of times in both tables, and an overlap that goes on for hundreds of words beyond its last seed."""
    head = [f"h{j}" for j in range(20)]
    tail = [f"t{j}" for j in range(400)]
    other = [w if j % 5 else f"x{j}" for j, w in enumerate(tail)]  # every fifth word differs
    b = spark.createDataFrame([(1, "same " * 300), (2, " ".join(head + tail))], "item_id long, text string")
    d = spark.createDataFrame([(1, "same " * 20_000), (2, "same " * 5), (3, " ".join(["pad"] * 9 + head + other))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["n_words"], r["n_equal"]) for r in dc.overlaps(d, b).collect()}
    assert got == {(1, 1): (0, 300, 300), (3, 2): (9, 420, 340)}


def test_short_items_and_awkward_rows(spark):
    b = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "one"), (3, None), (None, "alpha beta gamma delta epsilon zeta"), (4, ""), (1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string").withColumn("seed", F.lit(1))
    got = sorted((r["doc_id"], r["item_id"], r["first_word"], r["n_words"]) for r in dc.overlaps(docs(spark), b).collect())
    assert got == [(1, 1, 0, 6), (2, 1, 0, 6)]
    left = dc.decontaminated(docs(spark), b)
    assert left.columns == docs(spark).columns
    assert left.where("doc_id in (1, 2)").count() == 0
    assert [r["text"] for r in left.where("doc_id is null").collect()] == [None]  # a row without an id is judged by its text


def test_short_items_with_unequal_words(spark):
    """Every choice of unequal words that an item of 3 to 10 words may have, and one or two of 11 and 12 words at the ends."""
    items, rows, want = [], [], set()
    for n in range(3, 13):
        w = [f"i{n}w{j}" for j in range(n)]
        items.append((n, " ".join(w)))
        may = n - -(-n * 4 // 5) if n >= dc.TOLERANT else 0
        for gone in itertools.combinations(range(n), may) if n < dc.SPAN else [(0,), (n - 1,)]:
            for more in ([], [next(j for j in range(n) if j not in gone)] * (n < dc.SPAN)):
                t = ["zz" if j in gone or j in more else x for j, x in enumerate(w)]
                if not more:
                    want.add((len(rows), n))
                rows.append((len(rows), " ".join(["pad"] * 5 + t + ["pad"] * 5)))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.overlaps(d, b).collect()}
    assert got >= want
    assert all(rows[i][1].count("zz") <= n * 0.2 and n >= dc.SHORTEST for i, n in got)


def test_empty_tables(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    assert dc.overlaps(docs(spark), b).count() == 0
    assert dc.overlaps(empty(spark), spark.createDataFrame([(1, LONG)], "item_id long, text string")).count() == 0


def test_best_stretch_equals_brute_force():
    g = np.random.default_rng(4)
    for _ in range(300):
        e = g.random(int(g.integers(1, 30))) < g.choice([0.3, 0.7, 0.9])
        best = max((b - a for a in range(len(e)) for b in range(a + 1, len(e) + 1) if 5 * e[a:b].sum() >= 4 * (b - a) and e[a] and e[b - 1]), default=0)
        start, end, same = dc.best_stretch(e)
        assert same == e[start:end].sum()
        assert 5 * same >= 4 * (end - start)
        # trimming unequal ends may only lose what the longest stretch had at its ends
        assert best * 0.8 <= end - start <= best or best == end == 0
