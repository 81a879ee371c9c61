import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_jaccard import brute, result
from windrow.llm import decontaminate as dc
from windrow.llm import jaccard, kernel
from windrow.llm import toxicity as tx

FAR = {"word": "x" * 5_000, "spaces": "a" + " " * 5_000 + "b", "rule": "=" * 5_000, "twice": "y" * 9_000 + " " + "y" * 9_000}
PLAIN = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu you are an idiot"


@pytest.mark.parametrize("far", FAR.values(), ids=FAR)
@pytest.mark.parametrize("seps", [kernel.SPACE, kernel.NON_WORD], ids=["space", "non_word"])
def test_equal_words_hash_equally_beside_long_ones(far, seps):
    def words(*texts):
        data, off = kernel.buffers(pa.array(texts))
        h, first, _ = kernel.words(data, off, seps)
        return [h[a:b].tolist() for a, b in zip(first, first[1:], strict=False)]

    assert words(PLAIN, far)[0] == words(PLAIN)[0]
    assert words(PLAIN, far)[1] == words(far)[0] == words(far, "z" * 20_000)[0]


def test_long_words_differ_by_any_byte():
    data, off = kernel.buffers(pa.array(["q" * 9_000, "q" * 8_999 + "r", "r" + "q" * 8_999, "q" * 4_096 + "r" + "q" * 4_903, "q" * 9_001]))
    assert len(np.unique(kernel.words(data, off)[0])) == 5


def test_operators_find_copies_beside_long_words(spark):
    # in a partition of its own the copy is hashed without, in the other one with a long word in its span
    rows = [(1, PLAIN)] + [(10 + i, far) for i, far in enumerate(FAR.values())] + [(2, PLAIN)]
    d = spark.createDataFrame(rows[:1], "doc_id long, text string").coalesce(1).union(spark.createDataFrame(rows[1:], "doc_id long, text string").coalesce(1))
    assert result(jaccard.near_duplicates(d, 3, 9, 10)) == brute(rows, 3, 9, 10)
    b = spark.createDataFrame([(1, PLAIN)], "item_id long, text string")
    assert {r["doc_id"] for r in dc.overlaps(d, b).collect()} == {1, 2}
    batch = pa.RecordBatch.from_pydict({"text": [t for _, t in rows]})
    assert [i for i, w, _, _ in tx._features(batch) if len(tx._within(w, tx._lexicon_hashes(tx.LEXICON)))] == [0, len(rows) - 1]
