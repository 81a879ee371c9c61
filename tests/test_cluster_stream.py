"""Streamed clusters equal the batch operator's, whatever the order and batches in which calls come."""

import random
from datetime import datetime, timedelta

from hypothesis import given
from hypothesis import strategies as st

from tests.oracle import assert_same
from windrow.operators import intervals as iv
from windrow.plans import registry
from windrow.streaming import cluster_stream as cs

BASE = datetime(2020, 1, 1)
SCHEMA = "chr string, call_id long, start long, end long, at timestamp"


def rows_of(calls):
    """Coordinates are milliseconds after BASE."""
    base = int((BASE - datetime(1970, 1, 1)).total_seconds() * 1000)
    return [(c, i, base + s, base + e, BASE + timedelta(milliseconds=s)) for c, i, s, e in calls]


def run(spark, folder, batches, delay):
    """Feeds the batches one after the other, each by a run of its own that goes on from the checkpoint."""
    for k, batch in enumerate(batches):
        spark.createDataFrame(rows_of(batch), SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"file://{folder}/in")
        cs.cluster_stream(stream, ["chr"], "at", delay, f"file://{folder}/out", f"file://{folder}/state", 1).awaitTermination()
        assert k >= 0
    got = spark.read.schema("chr string, cluster_no long, start long, end long, n long").parquet(f"file://{folder}/out").collect()
    assert len(got) == len({(r["chr"], r["cluster_no"]) for r in got})
    return {tuple(r) for r in got}


def batch_clusters(spark, calls):
    df = spark.createDataFrame(rows_of(calls), SCHEMA)
    c = iv.overlap_clusters(df, ["chr"], ["start", "end", "call_id"])
    rows = c.groupBy("chr", "cluster_no").agg({"start": "min", "end": "max", "*": "count"}).select("chr", "cluster_no", "min(start)", "max(end)", "count(1)").collect()
    return {tuple(r) for r in rows}


def test_late_calls_within_the_delay_and_restarts(spark, tmp_path):
    draw = random.Random(3)
    calls = [(draw.choice("ab"), i, s := i * 700 + draw.randrange(-3_000, 3_000), s + draw.choice((0, 400, 1_500, 9_000))) for i in range(90)]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = run(spark, tmp_path, [calls[:30], calls[30:60], calls[60:]], "10 seconds")
    want = batch_clusters(spark, calls)
    base = rows_of([("a", 0, 0, 0)])[0][2]
    mark = base + max(c[2] for c in calls) - 10_000
    assert got == {w for w in want if w[3] <= mark}
    assert len(got) > 10


def test_nulls_are_left_out_and_open_clusters_wait(spark, tmp_path):
    calls = [("a", 1, 0, 100), ("a", 2, 50, 200), ("a", 3, 200, 300), ("b", 4, 0, 60_000), ("a", 5, 30_000, 30_001)]
    rows = spark.createDataFrame([*rows_of(calls), (None, 6, 0, 1, BASE), ("a", 7, None, 1, BASE), ("a", 8, 0, 1, None)], SCHEMA)
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
    cs.cluster_stream(stream, ["chr"], "at", "1 second", f"file://{tmp_path}/out", f"file://{tmp_path}/state", 1).awaitTermination()
    got = spark.read.schema("chr string, cluster_no long, start long, end long, n long").parquet(f"file://{tmp_path}/out").collect()
    base = rows_of([("a", 0, 0, 0)])[0][2]
    assert {(r["chr"], r["cluster_no"], r["start"] - base, r["end"] - base, r["n"]) for r in got} == {("a", 1, 0, 200, 2), ("a", 2, 200, 300, 1)}


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 15)), max_size=25), st.integers(0, 25))
def test_islands_may_be_made_in_any_pieces(spans, at):
    one = [(s, s + n, 1) for s, n in spans]
    reach, want = None, []
    for s, e, _ in sorted(one):
        if reach is None or s >= reach:
            want.append([s, e, 0])
        reach = e if reach is None else max(reach, e)
        want[-1][1] = max(want[-1][1], e)
        want[-1][2] += 1
    assert [list(i) for i in cs.islands(one)] == want
    if all(n for _, n in spans):
        assert [list(i) for i in cs.islands(cs.islands(one[:at]) + one[at:])] == want


def test_query(spark):
    d = "/root/testdata/sf0.01"
    assert_same(registry.queries()["stream_clusters"](spark, d), registry.oracle_sql()["stream_clusters"], d)
