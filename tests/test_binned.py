"""Binned interval store: fetches equal full scans and open only the bins that they touch."""

import random
import re

import pytest

from tests.oracle import assert_same
from windrow.plans import registry
from windrow.sources import binned


def pairs(rows, requests):
    return sorted((q, i) for q, c, s, e in requests for i, d, a, b in rows if c == d and a < e and s < b)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    draw = random.Random(4)
    rows = [(i, draw.choice(("chr1", "2", "x/y=z")), s := draw.randrange(-500, 5_000), s + draw.choice((0, 1, 10, 300, 4_000))) for i in range(400)]
    path = f"file://{tmp_path_factory.mktemp('binned')}/t"
    binned.write_binned(spark.createDataFrame(rows, "id long, chr string, start long, end long"), path, 50, 4, 3)
    return path, rows


def fetch(spark, path, requests, **more):
    r = spark.createDataFrame(requests, "q long, chr string, r_start long, r_end long")
    return binned.fetched(spark, path, r, **more)


REQUESTS = [(1, "chr1", 100, 160), (2, "2", -500, 9_000), (3, "x/y=z", 777, 778), (4, "chr1", 300, 300), (5, "none", 0, 10), (6, "chr1", 100, 160), (7, "2", -60, -50)]


@pytest.mark.parametrize("most", [10_000, 3])
def test_equal_to_a_full_scan(spark, stored, most):
    path, rows = stored
    got = sorted((r["q"], r["id"]) for r in fetch(spark, path, REQUESTS, max_bins=most).collect())
    assert got == pairs(rows, REQUESTS)
    assert len(got) > 20


def test_scan_is_limited_to_the_bins_that_are_touched(spark, stored):
    path, _ = stored
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        plan = fetch(spark, path, [(1, "chr1", 100, 120)])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = re.search(r"PartitionFilters: \[(.*)\], PushedFilters", plan)[1]
    assert "bin#" in filters and "level#" in filters and "chr#" in filters
    # and of the stored folders these are few
    table, width, fan, levels = binned.binned(spark, path)
    folders = {(r["chr"], r["level"], r["bin"]) for r in table.select("chr", "level", "bin").distinct().collect()}
    touched = {tuple(r) for r in binned._touched(spark.createDataFrame([("chr1", 100, 120)], "chr string, r_start long, r_end long"), width, fan, levels).select("chr", "level", "bin").collect()}
    assert touched == {("chr1", 0, 2), ("chr1", 1, 0), ("chr1", 2, 0), ("chr1", 3, 0)}
    assert len(folders & touched) < len(folders) / 10


def test_every_interval_lies_in_the_lowest_bin_that_holds_it(spark, stored):
    path, rows = stored
    table, width, fan, levels = binned.binned(spark, path)
    assert (width, fan, levels) == (50, 4, 3)
    seen = {r["id"]: (r["level"], r["bin"]) for r in table.collect()}
    assert len(seen) == len(rows)
    for i, _, s, e in rows:
        last = max(e - 1, s)
        want = next(((k, s // (50 * 4**k)) for k in range(3) if s // (50 * 4**k) == last // (50 * 4**k)), (3, 0))
        assert seen[i] == want


def test_nulls_and_reserved_names_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 0, 1)], "id long, chr string, start long, end long")
    with pytest.raises(Exception, match="chr is null"):
        binned.write_binned(df, f"file://{tmp_path}/a", 10)
    with pytest.raises(ValueError, match="stored bins"):
        binned.write_binned(df.withColumnRenamed("id", "bin"), f"file://{tmp_path}/b", 10)


def test_empty_table_and_no_requests(spark, tmp_path, stored):
    path = f"file://{tmp_path}/c"
    binned.write_binned(spark.createDataFrame([], "id long, chr string, start long, end long"), path, 10)
    assert fetch(spark, path, REQUESTS).count() == 0
    assert fetch(spark, stored[0], []).count() == 0


def test_query_over_many_requests(spark):
    d = "/root/testdata/sf0.01"
    assert_same(registry.queries()["binned_fetch"](spark, d), registry.oracle_sql()["binned_fetch"], d)


@pytest.mark.parametrize("max_bins", [0, 10_000])
def test_sums_equal_those_of_the_pairs(spark, tmp_path, max_bins):
    """Shared borders, intervals and requests of no length, repeated requests, contigs that are not stored."""
    r = random.Random(3)
    rows = [(i, r.choice("ab"), s := r.randrange(400), s + r.choice((0, 1, 5, 5, 60, 300))) for i in range(400)]
    at = f"file://{tmp_path}/sums"
    binned.write_binned(spark.createDataFrame(rows, "id long, chr string, start long, end long"), at, 16, 4, 2)
    asked = [(r.choice("abc"), s := r.randrange(400), s + r.choice((0, 1, 5, 40, 200))) for _ in range(150)]
    q = spark.createDataFrame(asked + asked[:9], "chr string, r_start long, r_end long")
    got = {tuple(x) for x in binned.fetched_sums(spark, at, q, "id", max_bins).collect()}
    want = set()
    for c, a, z in set(asked):
        hit = [i for i, k, s, e in rows if k == c and s < z and a < e]
        if hit:
            want.add((c, a, z, len(hit), sum(hit)))
    assert got == want


def test_query_makes_no_pairs(spark):
    df = registry.queries()["binned_fetch"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan
