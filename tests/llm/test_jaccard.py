import random
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import docs, empty
from windrow.llm import jaccard, shared
from windrow.llm.shared import connected_components, table


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    name = {i: i for i in sets}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    for i, s in sets.items():
        for j, m in Counter(j for g in s for j in by[g] if j > i).items():
            if den * m >= num * (len(s) + len(sets[j]) - m):
                a, b = find(i), find(j)
                name[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_equals_brute_force_on_edited_copies(spark, k, num, den):
    r, rows = random.Random(k), []
    for g in range(12):
        base = [f"w{r.randint(0, 60)}" for _ in range(r.choice([3, 6, 9, 14, 40, 120, 300]))]
        for _ in range(r.randint(1, 6)):
            t = list(base)
            for _ in range(r.randint(0, 1 + len(t) // 25)):
                t[r.randrange(len(t))] = f"x{r.randint(0, 999)}"
            rows.append((len(rows), " ".join(t)))
    assert result(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den)) == brute(rows, k, num, den)


def test_large_groups_go_through_stars_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(r.randint(0, 7)):
            t[r.randrange(150)] = f"x{r.randint(0, 9999)}"
        rows.append((i, " ".join(t)))
    assert result(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10)) == brute(rows, 3, 9, 10)


def joined_on_doc(spark, plan):
    """Rows that each join of doc with doc in an executed plan has made."""
    as_java, name = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava, plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return joined_on_doc(spark, plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return joined_on_doc(spark, plan.plan())
    below = [n for p in as_java(plan.children()) for n in joined_on_doc(spark, p)]
    if name.endswith("JoinExec") and all("(doc#" in k.toString() for k in (plan.leftKeys(), plan.rightKeys())):
        below.append(as_java(plan.metrics())["numOutputRows"].value())
    return below


def test_sketches_meet_a_document_once_and_not_once_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 3)
    plans, of = [], jaccard._left_over

    def left_over(*args):
        out = of(*args)
        out.collect()
        plans.append(out._jdf.queryExecution().executedPlan())
        return out

    monkeypatch.setattr(jaccard, "_left_over", left_over)
    rows = [(i, " ".join([f"w{j}" for j in range(60)] + [f"x{i}_{j}" for j in range(90)])) for i in range(40)]  # one passage, no links
    assert result(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 2, 5)) == brute(rows, 3, 2, 5)
    made = joined_on_doc(spark, plans[0])
    assert made and sum(made) <= len(rows)


def test_whole_table(spark, tiny):
    t = table(spark, tiny, "documents")
    rows = [(r["doc_id"], r["text"]) for r in t.select("doc_id", "text").collect()]
    assert result(jaccard.op3_jaccard_join(spark, tiny)) == brute(rows, 3, 9, 10)


def test_awkward_rows(spark):
    out = jaccard.near_duplicates(docs(spark))
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == 12
    by = {r[0]: r for r in rows if r[0] is not None}
    assert by[2] == (2, 8, 1)
    assert by[3] == (3, 0, 3)
    assert by[5] == (5, 0, 5)
    assert by[8] == (8, 1, 7)
    assert (None, 8, 1) in rows
    kept = jaccard.one_of_each(docs(spark))
    assert kept.columns == docs(spark).columns
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 7, 9]
    assert [r["text"] for r in rows if r["doc_id"] is None] == [None]


def test_rows_without_ids_are_kept_once(spark):
    text = lambda a, b: " ".join(f"w{j}" for j in range(a, b))
    rows = [(None, text(0, 40)), (None, text(0, 40)), (None, text(0, 41)), (None, text(100, 140)), (None, text(100, 140)), (5, text(100, 141)), (None, text(200, 240))]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs(spark, rows)).collect()]
    assert len(kept) == 3
    assert (5, text(100, 141)) in kept
    assert (None, text(200, 240)) in kept


def test_an_id_of_several_rows_does_not_hide_a_link(spark):
    base = [f"w{j}" for j in range(200)]
    rows = [(1, " ".join(base)), (5, "x " + " ".join(base)), (5, "x " + " ".join(base)), (5, "y z"), (7, "q " + " ".join(base)), (7, "q " + " ".join(base)), (9, " ".join(base) + " r")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect()
    assert {r["component_id"] for r in got if r["n_shingles"] > 100} == {1}


def test_empty_table(spark):
    assert jaccard.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (6, 6), (8, 7), (9, 8), (10, 9), (7, 11), (None, 3), (2, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 7, 10: 7, 11: 7}


def test_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r["component"] for r in connected_components(e).collect()} == {0}


def test_sketch_parts_outnumber_differences():
    for band in range(20):
        top = int(jaccard._STARTS[band + 1] - 1)
        assert jaccard.band_parts(band, 9, 10) > jaccard.most_apart(2 * top, 9, 10)


@pytest.mark.parametrize("bits", [1 << 27, 16])
def test_without_ids(spark, monkeypatch, bits):
    monkeypatch.setattr(shared, "MAX_BITS", bits)
    d = spark.createDataFrame([(i if i % 9 else None, str(i)) for i in range(400)], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 400, 7)] + [(None,), (7,)], "id long")
    left = sorted(r["text"] for r in shared.without_ids(d, "doc_id", ids).collect())
    assert left == sorted(str(i) for i in range(400) if not i % 9 or i % 7)
    assert shared.without_ids(d, "doc_id", ids.limit(0)).count() == 400


def test_verified_without_a_bitmap(spark, monkeypatch):
    monkeypatch.setattr(shared, "MAX_BITS", 16)
    rows = [(i, " ".join(f"w{j}" for j in range(60) if j != i)) for i in range(4)]
    assert result(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 9, 10)) == brute(rows, 1, 9, 10)
