import numpy as np
import pytest

from windrow.llm import neardup as nd
from windrow.llm.shared import table


def brute(rows, cosine=0.93):
    out = {}
    usable = []
    for i, v, label in rows:
        ok = v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        out[i] = (0, i, True)
        if ok:
            usable.append((i, label, np.array(v, np.float64) / np.abs(v).max()))
    name = {i: i for i, *_ in usable}
    links = {i: [] for i in name}
    for n, (i, a, x) in enumerate(usable):
        for j, b, y in usable[n + 1 :]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i].append(j)
                links[j].append(i)
    changed = True
    while changed:
        changed = False
        for i, others in links.items():
            low = min([name[i], *(name[j] for j in others)])
            if low < name[i]:
                name[i], changed = low, True
    for i in name:
        out[i] = (len(links[i]), name[i], name[i] == i)
    return out


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize(("cell", "block"), [(2048, 1024), (20, 8)])
def test_equals_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(nd, "CELL", cell)
    monkeypatch.setattr(nd, "BLOCK", block)
    g, rows = np.random.default_rng(7), []
    for c in range(30):
        base = g.normal(size=8)
        for _ in range(int(g.integers(1, 14))):
            v = base + g.normal(size=8) * g.choice([0, 0.1, 0.25])
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], int(c % 3)))
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert result(nd.near_duplicates(d)) == brute(rows)


def test_whole_table(spark, tiny):
    rows = [tuple(r) for r in table(spark, tiny, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert result(nd.op5_embeddings(spark, tiny)) == brute(rows)


def test_awkward_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [float("nan"), 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [float("inf"), 0.0], 1), (13, [1e30, 0.0], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS x", "2 AS rep", "3 AS cell")
    want = {i: (0, i, True) for i, *_ in rows} | {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 13: (3, 1, False)}
    assert result(nd.near_duplicates(d)) == want
    none = spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert [tuple(r) for r in nd.near_duplicates(none).collect()] == [(None, 0, None, True)] * 2
    assert nd.near_duplicates(d.limit(0)).count() == 0


def test_clusters_separate():
    g = np.random.default_rng(0)
    x = nd.unit(np.concatenate([g.normal(size=(50, 5)) * 0.05 + c for c in np.eye(5)[:3]]))
    c = nd.spherical_kmeans(x, 3, rounds=20, seed=3)
    assert np.allclose((c * c).sum(1), 1)


def test_dense_groups_cost_no_products(spark, monkeypatch):
    monkeypatch.setattr(nd, "CELL", 40)
    monkeypatch.setattr(nd, "BLOCK", 16)
    g, rows = np.random.default_rng(3), []
    base = g.normal(size=24)
    for i in range(500):
        v = base + g.normal(size=24) * 0.05 if i % 3 == 0 else g.normal(size=24) if i % 3 == 1 else base + g.normal(size=24) * g.choice([0.2, 0.4])
        rows.append((i, [float(x) for x in v], 1))
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, want = result(nd.near_duplicates(d)), brute(rows)
    assert sum(n for n, *_ in got.values()) >= 0.999 * sum(n for n, *_ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert {i: c for i, (_, c, _) in got.items()} == {i: c for i, (_, c, _) in want.items()}


def test_recall_at_the_threshold(spark, monkeypatch):
    """Pairs whose cosine is just above the threshold, in structureless vectors cut into many cells."""
    monkeypatch.setattr(nd, "CELL", 64)
    g, rows = np.random.default_rng(4), []
    for i in range(1500):
        x = nd.unit(g.normal(size=(1, 64)))[0]
        u = g.normal(size=64)
        u = nd.unit((u - (u @ x) * x)[None])[0]
        rows += [(2 * i, list(map(float, x)), 1), (2 * i + 1, list(map(float, 0.931 * x + np.sqrt(1 - 0.931**2) * u)), 1)]
    out = result(nd.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))
    found = sum(out[2 * i + 1][1] == 2 * i for i in range(1500))
    assert found >= 0.99 * 1500
