"""Best paths: all subsets of small clusters, a plain dynamic program, and tiles of every width."""

import random
from itertools import combinations

import pytest

from tests.oracle import assert_same
from windrow.operators import paths
from windrow.plans import registry

SCHEMA = "chr string, call_id long, start long, end long, score double"


def plain_best(rows):
    """Largest total of each chr by a table over ends."""
    best = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c and None not in r[2:] and r[3] > r[2] and r[4] > 0), key=lambda r: r[3])
        at = [(float("-inf"), 0.0)]
        for _, _, s, e, w in own:
            before = max(v for p, v in at if p <= s)
            at.append((e, max(at[-1][1], before + w)))
        best[c] = at[-1][1]
    return best


def check(spark, rows, tile):
    got = [tuple(r) for r in paths.best_path(spark.createDataFrame(rows, SCHEMA), ["chr"], tile).collect()]
    calls = {(r[0], r[1]): r for r in rows}
    assert len(got) == len(set(got))
    total = {}
    for g in got:
        total[g[0]] = total.get(g[0], 0.0) + calls[g][4]
        for h in got:
            if g != h and g[0] == h[0]:
                assert calls[g][3] <= calls[h][2] or calls[h][3] <= calls[g][2]
    want = {c: v for c, v in plain_best(rows).items() if v > 0}
    assert total == pytest.approx(want)


def drawn(seed, n, span, longest):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        s = draw.randrange(-span // 2, span)
        out.append((draw.choice("abb"), i, s, s + draw.choice((1, 3, draw.randrange(1, longest))), float(draw.randrange(1, 40))))
    return out


@pytest.mark.parametrize("tile", [7, 40, 100_000])
def test_tiles_of_any_width_give_the_best_total(spark, tile):
    check(spark, drawn(1, 150, 400, 60), tile)


def test_calls_over_many_tiles_and_one_dense_cluster(spark):
    rows = drawn(2, 120, 60, 90) + [("b", 900, -30, 200, 90.0), ("b", 901, -200, 260, 55.0), ("a", 902, 0, 1_000, 1.0)]
    check(spark, rows, 10)


def test_unusable_and_equal_calls(spark):
    rows = [("a", 1, 5, 5, 9.0), ("a", 2, 9, 3, 9.0), ("a", 3, 0, 10, -1.0), ("a", 4, 0, 10, None), ("a", 5, None, 10, 2.0), ("a", 6, 0, 10, 2.0), ("a", 7, 0, 10, 3.0), ("a", 8, 10, 20, 3.0), ("b", 9, 0, 1, 0.0)]
    assert {tuple(r) for r in paths.best_path(spark.createDataFrame(rows, SCHEMA), ["chr"], 4).collect()} == {("a", 7), ("a", 8)}
    assert paths.best_path(spark.createDataFrame([], SCHEMA), ["chr"]).count() == 0


def test_string_ids_and_two_keys(spark):
    df = spark.createDataFrame([("x", 1, "p", 0, 10, 1.0), ("x", 1, "q", 5, 30, 5.0), ("x", 2, "r", 5, 30, 5.0)], "g string, h int, call_id string, start long, end long, score double")
    assert {tuple(r) for r in paths.best_path(df, ["g", "h"], 8).collect()} == {("x", 1, "q"), ("x", 2, "r")}


def test_query_equals_every_subset_of_its_clusters(spark, tiny):
    got = {(r["chr"], r["cluster_no"]): r["best"] for r in registry.queries()["best_path"](spark, tiny).collect()}
    clusters = {}
    for r in registry.queries()["overlap_clusters"](spark, tiny).collect():
        clusters.setdefault((r["chr"], r["cluster_no"]), []).append(r["call_id"])
    from windrow.plans import queries_search

    calls = {r["call_id"]: (r["start"], r["end"], r["score"]) for r in queries_search.scored_calls(spark, tiny).collect()}
    assert max(map(len, clusters.values())) >= 3
    for key, ids in clusters.items():
        best = 0
        for k in range(1, len(ids) + 1):
            for some in combinations(ids, k):
                own = sorted(calls[i] for i in some)
                if all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False)):
                    best = max(best, sum(c[2] for c in own))
        assert got[key] == best
    assert set(got) == set(clusters)


def test_query_equals_sql_in_dense_clusters(spark):
    assert_same(registry.queries()["best_path"](spark, "/root/testdata/sf0.01"), registry.oracle_sql()["best_path"], "/root/testdata/sf0.01")
