"""Reciprocal overlaps: classes of equal intervals are joined, not their members."""

import datetime as dt
import random

import pytest

from tests.oracle import assert_same
from windrow.operators import intervals as iv
from windrow.plans import registry

SCHEMA = "call_id long, chr string, start long, end long"


def brute(rows):
    out = []
    for i, c, s, e in rows:
        for j, d, t, u in rows:
            if None not in (i, j, c, s, t) and c == d and i < j and s < u and t < e:
                o = min(e, u) - max(s, t)
                out.append((i, j, min(o / (e - s), o / (u - t)) if o > 0 else 0.0))
    return sorted(out)


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_pairs_of_equal_repeated_and_unknown_calls(spark, piece):
    draw = random.Random(5)
    rows = [(draw.randrange(80), draw.choice("xy"), s := draw.randrange(12) * 10, s + draw.randrange(0, 4) * 15) for _ in range(120)]
    rows += [(7, "x", 20, 35)] * 3 + [(200 + i, "x", 40, 55) for i in range(70)]
    rows += [(None, "x", 20, 35), (300, None, 20, 35), (301, "x", None, None), (-3, "x", 20, 35), (1 << 40, "y", 0, 1000)]
    got = iv.reciprocal_pairs(spark.createDataFrame(rows, SCHEMA), ["chr"], 25, piece).collect()
    assert sorted(map(tuple, got)) == [pytest.approx(r) for r in brute(rows)]


def test_no_calls_no_pairs(spark):
    assert iv.reciprocal_pairs(spark.createDataFrame([], SCHEMA), ["chr"], 25).count() == 0


def test_pieces_are_sorted_and_bounded(spark):
    rows = [(i * 7 % 50, "x", 0, 10) for i in range(50)] + [(90, "x", 0, 11)]
    got = [r["ids"] for r in iv.interval_classes(spark.createDataFrame(rows, SCHEMA), ["chr"], 8).collect()]
    assert sorted(x for ids in got for x in ids) == [*range(50), 90]
    assert all(ids == sorted(ids) and len(ids) <= 8 for ids in got) and len(got) == 8


def test_tasks_follow_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(iv, "TASK_PAIRS", 1000)
    few, many = (spark.range(n).selectExpr("id call_id", "'x' chr", "0L start", "10L end") for n in (10, 400))
    assert iv.pair_tasks(few, ["chr"], 25) == spark.sparkContext.defaultParallelism
    assert iv.pair_tasks(many, ["chr"], 25) == 160


def test_query_joins_classes_of_copies(spark, tmp_path, monkeypatch):
    """Three intervals with 128 copies each: at most 9 pairs of classes in 2 by 2 pieces meet, and all pairs come out."""
    at = dt.datetime(2024, 1, 1)
    rows = [(4 * i, at + dt.timedelta(minutes=i % 3), i % 9, "x", 50.0) for i in range(384)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    met, join = [], iv.interval_join
    monkeypatch.setattr(iv, "interval_join", lambda *a, **k: met.append(join(*a, **k)) or met[-1])
    out = registry.queries()["reciprocal_overlap"](spark, str(tmp_path))
    assert out.count() == 384 * 383 // 2
    assert met[0].count() == 36


def test_query_equals_sql_on_copies(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 300").crossJoin(spark.range(5))
    e.selectExpr("event_id + 100000 * id AS event_id", "ts", "user_id", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "parts"))
    d = tmp_path / "data"
    d.mkdir()
    next((tmp_path / "parts").glob("*.parquet")).rename(d / "events.parquet")
    assert_same(registry.queries()["reciprocal_overlap"](spark, str(d)), registry.oracle_sql()["reciprocal_overlap"], str(d))
