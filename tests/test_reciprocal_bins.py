"""Both sides of the join of reciprocal overlaps read one exchange of the bins."""

import re

from windrow.operators import intervals as iv


def test_bins_are_dealt_once(spark):
    calls = spark.range(400).selectExpr("id call_id", "concat('c', id % 3) chr", "id * 7 % 90 start", "id * 7 % 90 + 1 + id % 40 `end`")
    pairs = iv.reciprocal_pairs(calls, ["chr"], 25)
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = iv.reciprocal_pairs(calls, ["chr"], 25)._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, x in old.items():
            spark.conf.set(c, x)
    # the members of a class meet, then its bins are dealt
    assert len(re.findall(r"[+:]- Exchange hashpartitioning", plan)) == 2
    rows = {(r["call_id"], r["chr"], r["start"], r["end"]) for r in calls.collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3]}
    got = [(r["a_id"], r["b_id"]) for r in pairs.collect()]
    assert len(got) == len(want) and set(got) == want
