"""Large overlap clusters by tiles, and calls of equal intervals counted, give what the whole gives."""

import datetime as dt
import random

import numpy as np
import pytest

from tests.oracle import assert_same
from windrow.operators import calls as cl
from windrow.operators import intervals as iv
from windrow.operators import mixture as mx
from windrow.plans import registry

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def events(spark, folder, rows):
    (folder / "data").mkdir()
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(folder / "parts"))
    next((folder / "parts").glob("*.parquet")).rename(folder / "data" / "events.parquet")
    return str(folder / "data")


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("more", [{}, {"max_frac_uniq": 0.6}, {"max_dif": 25}])
def test_parts_in_two_rounds_equal_the_matrix(seed, more):
    """The left and right part go as far as they can alone; what is left of both is linked to the end."""
    r = random.Random(seed)
    p = np.array(sorted({(s := r.randrange(500), s + r.choice((0, 5, 20, 20, 40, 120))) for _ in range(220)}), np.int64)
    for cut in (0.3, 0.5, 0.85):
        want = mx.complete_linkage(mx.reciprocal_distance(p[:, 0], p[:, 1], **more), cut)
        for at in (60, 110):
            into, final = np.zeros(len(p), int), np.zeros(len(p), bool)
            for side, low, high in ((slice(0, at), -np.inf, p[at, 0]), (slice(at, None), p[:at, 1].max(), np.inf)):
                i, final[side] = mx.partial_linkage(p[side, 0], p[side, 1], cut, **more, block=16, low=low, high=high)
                into[side] = i + (side.start or 0)
            assert 0 < final.sum() < len(p)
            rest = np.flatnonzero(~final)
            i, end = mx.partial_linkage(p[rest, 0], p[rest, 1], cut, **more, block=16, group=np.searchsorted(rest, into[rest]))
            assert end.all()
            into[rest] = rest[i]
            assert (np.unique(into, return_inverse=True)[1] == want).all()


def test_tiles_of_large_clusters_equal_one_task(spark, monkeypatch):
    """Two clusters of some 1,000 and 500 points and small ones; tiles of 40 points need three rounds, and no task gets a whole cluster."""
    r = random.Random(4)
    p = sorted({("x", s := r.randrange(20_000), s + r.choice((0, 30, 60, 200, 500))) for _ in range(1_000)} | {("y", s := r.randrange(5_000), s + r.choice((100, 400))) for _ in range(500)} | {("z", k * 1_000, k * 1_000 + 10 + k % 3 * j) for k in range(30) for j in range(3)})
    df = iv.overlap_clusters(spark.createDataFrame([(f"c{k}", *x) for k, x in enumerate(p)], "call_id string, chr string, start long, end long"), ["chr"], ["start", "end"])
    whole = sorted(map(tuple, mx.linkage_clusters(df, ["chr"]).collect()))
    held, linkage = spark.sparkContext.accumulator(0), mx.partial_linkage
    monkeypatch.setattr(mx, "TILE_POINTS", 40)
    monkeypatch.setattr(mx, "interval_linkage", lambda s, *a: held.add(len(s) > 40) or mx.complete_linkage(mx.reciprocal_distance(s, a[0]), a[1]))
    monkeypatch.setattr(mx, "partial_linkage", lambda s, *a, **k: held.add(len(s) > 500) or linkage(s, *a, **k))
    assert sorted(map(tuple, mx.linkage_clusters(df, ["chr"]).collect())) == whole
    assert held.value == 0
    assert len({x[:2] for x in whole}) < len({(*x[:2], x[-1]) for x in whole})


def test_equal_intervals_are_counted(spark):
    rows = [("x", 0, 10, "s1", 0.1)] * 5 + [("x", 0, 10, "s2", 0.01)] * 2 + [("x", 5, 5, "s1", 0.1)] * 3 + [(None, 0, 10, "s1", 0.1), ("x", None, None, "s1", 0.1), ("x", 0, 10, None, 0.1)]
    got = cl.counted(spark.createDataFrame(rows, "chr string, start long, end long, indiv_ref string, p double"), ["chr"]).collect()
    assert sorted((x["start"], x["end"], x["indiv_ref"] or "", x["n"], round(x["ll"], 9)) for x in got) == [(0, 10, "", 1, -1), (0, 10, "s1", 5, -5), (0, 10, "s2", 2, -4)] + [(5, 5, "s1", 1, -1)] * 3


def test_refine_calls_on_repeated_and_odd_rows_equals_sql(spark, tmp_path):
    """Rows with one id, an interval without a length, and a sum of log10 p that is -3 but for its order: 20 + 17.9 + 22.1 hundredths of values."""
    t = dt.datetime(2024, 1, 1)
    rows = [(4 * i, t, i, "view", 99.0) for i in range(3)] * 2 + [(1, t + dt.timedelta(minutes=2), 4, "view", 99.0)] * 3
    rows += [(4 * i + 1, t + dt.timedelta(hours=1), i, "click", x) for i, x in enumerate((0.3, 19.7, 0.7, 9.3, 30.0))]
    rows += [(8, None, 3, "view", 99.0), (12, t, None, "view", 99.0), (16, t, 5, None, 99.0), (17, t + dt.timedelta(hours=2), 5, "view", 99.0), (-1, t + dt.timedelta(hours=3), 5, "view", 99.0)]
    rows += [(400 + i, t + dt.timedelta(hours=5, seconds=i // 2), i, "error", 80.0 + i % 20) for i in range(60)]
    d = events(spark, tmp_path, rows)
    assert_same(registry.queries()["refine_calls"](spark, d), registry.oracle_sql()["refine_calls"], d)


def test_copies_reach_the_linkage_once(spark, tmp_path, monkeypatch):
    """Fifty copies of each of 60 calls: what is clustered and linked has 60 rows."""
    t = dt.datetime(2024, 1, 1)
    d = events(spark, tmp_path, [(4 * i + 400 * k, t + dt.timedelta(minutes=i), i, "view", 99.0) for i in range(60) for k in range(50)])
    seen, linkage = [], mx.linkage_clusters
    monkeypatch.setattr(mx, "linkage_clusters", lambda c, *a, **k: seen.append(c.count()) or linkage(c, *a, **k))
    assert_same(registry.queries()["refine_calls"](spark, d), registry.oracle_sql()["refine_calls"], d)
    assert seen == [60]
