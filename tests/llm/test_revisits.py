from pyspark.sql import functions as F

from tests.oracle import assert_same
from windrow.llm import revisits as rv

SCHEMA = "record_id long, url string, ts long, is_full boolean, headers map<string,string>, digest string"


def test_equals_sql(spark, tiny):
    assert_same(rv.op6_revisits(spark, tiny), rv.OP6_SQL, tiny)


def test_canonical_urls(spark):
    same = ["http://www.Example.com/a/?utm_source=x#f", "https://example.com:443/a", "HTTPS://u:p@EXAMPLE.COM/a/", "example.com/a?ref=1&utm_x=2"]
    d = spark.createDataFrame([(u,) for u in [*same, "http://example.com/a?c=2&b=1", None]], "url string")
    got = [r[0] for r in d.select(rv.canonical(F.col("url"))).collect()]
    assert got == ["example.com/a"] * 4 + ["example.com/a?b=1&c=2", None]


def records(spark):
    full = {"etag": 'W/"1"', "date": "d1", "content-type": "text/html"}
    rows = [
        (1, "http://a/", 10, True, full, "x"),
        (2, "http://a", 20, False, {"etag": '"1"', "date": "d2", "content-length": "0"}, None),
        (3, "http://a/#z", 30, True, {"etag": '"2"'}, "y"),
        (4, "http://a/", 40, False, {"etag": '"1"'}, None),
        (5, "http://a/", 50, False, {"last-modified": "never"}, None),
        (6, "http://a/", 60, False, None, "y"),
        (7, "http://a/", 5, False, {"etag": '"1"'}, None),
        (8, "http://b/", 70, False, {"etag": '"1"'}, None),
        (9, None, 80, False, {"etag": '"1"'}, None),
        (10, "http://a/", None, False, {"etag": '"2"'}, None),
        (11, "http://a/", 90, None, {"etag": '"2"'}, None),
        (12, "http://a/", 30, False, {"etag": '"2"'}, None),
        (3, "http://a/", 30, False, {"etag": '"1"'}, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS bucket", "2 AS near", "3 AS merged")


def test_rules(spark):
    out = {}
    for r in rv.resolved(records(spark)).collect():
        out.setdefault(r["record_id"], []).append(r)
    outcome = {k: sorted((r["outcome"], r["resolved_to"]) for r in rs) for k, rs in out.items()}
    assert outcome[2] == [("resolved", 1)]
    assert outcome[4] == [("mismatch", None)]
    assert outcome[5] == [("mismatch", None)]
    assert outcome[6] == [("resolved", 3)]
    assert outcome[7] == outcome[8] == outcome[9] == outcome[10] == [("orphan", None)]
    assert outcome[11] == outcome[12] == [("resolved", 3)]
    assert ("full", None) in outcome[3]
    assert ("resolved", 1) in outcome[3]  # an equal record is not an earlier one
    assert out[2][0]["merged"] == {"etag": '"1"', "date": "d2", "content-type": "text/html"}
    assert out[2][0]["body_digest"] == "x"


def test_bodies_and_empty(spark):
    done = rv.resolved(records(spark))
    bodies = spark.createDataFrame([(1, "X"), (3, "Y")], "record_id long, body string")
    got = {(r["record_id"], r["outcome"]): r["body"] for r in rv.with_bodies(done, bodies).collect()}
    assert got[2, "resolved"] == "X"
    assert got[6, "resolved"] == "Y"
    assert got[4, "mismatch"] is None
    assert rv.resolved(records(spark).limit(0)).count() == 0


def test_ties_do_not_depend_on_partitions(spark):
    full = {"etag": '"1"'}
    rows = [(1, "http://a/", 5, True, full, "x"), (2, "http://a/", 7, True, {"etag": '"2"'}, "y"), (2, "http://a/", 7, False, {"etag": '"1"'}, None), (2, "http://a/", 7, False, {"etag": '"9"'}, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = sorted((r["outcome"], r["resolved_to"]) for r in rv.resolved(spark.createDataFrame(rows, SCHEMA)).collect() if r["record_id"] == 2)
            assert got == [("full", None), ("mismatch", None), ("resolved", 1)], n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
