"""Columns whose names the operators use for themselves come through untouched."""

import pytest

from windrow.llm import linededup, shared

OWN = ("_row", "_text", "_gone", "_lines", "_kept", "_name", "_out_id", "_NAME_", "row_id", "gone")


def clashing(spark, rows, kind):
    value = {"long": "7L", "string": "'mine'", "array": "array(1, 2)"}[kind]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", *(f"{value} AS `{c}`" for c in OWN))


def rest(r):
    return tuple(v for k, v in r.asDict().items() if k not in ("doc_id", "text"))


LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, f"{LONG}\nown line"), (2, f"first\n{LONG}"), (None, f"{LONG}"), (None, None), (3, ""), (4, "x")]


@pytest.mark.parametrize("kind", ["long", "string", "array"])
def test_line_dedup(spark, kind):
    d = clashing(spark, ROWS, kind)
    plain = linededup.cleaned(d.select("doc_id", "text"))
    got = linededup.cleaned(d)
    assert got.columns == d.columns
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(map(key, got.collect())) == sorted(map(key, plain.collect()))
    assert {r["text"] for r in got.collect() if r["doc_id"] == 2} == {"first"}
    want = rest(d.first())
    assert all(rest(r) == want for r in got.collect())


@pytest.mark.parametrize("once", [False, True])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_removal_by_id(spark, kind, once):
    d = clashing(spark, [*ROWS, (None, LONG)], kind)
    ids = shared.named(d.where("doc_id = 2 or text is null")).selectExpr("doc_id as id")
    got = shared.without(d, ids, once)
    assert got.columns == d.columns
    texts = sorted((str(r["doc_id"]), r["text"]) for r in got.collect())
    assert texts == sorted([("1", ROWS[0][1]), ("3", ""), ("4", "x")] + [("None", LONG)] * (1 if once else 2))
    want = rest(d.first())
    assert all(rest(r) == want for r in got.collect())


def test_free_names():
    assert shared.free_names(["a", "A_", "b"], "a", "a", "c") == ["a__", "a___", "c"]
