"""The prefix trie against its SQL and against a plain version that walks every prefix."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from tests.oracle import assert_same
from windrow.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[conv].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    out = []

    def fold(path):
        below = [fold(k) for k in kids[path]]
        leaves = sum(b[0] for b in below) or 1
        saved = sum(b[1] for b in below) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
        ends = ",".join(str(c) for c in sorted(members[path]) if len(built[c]) == len(path))
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(kids[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if built:
        fold(())
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def say(conv, texts, role="user"):
    return [(conv, i, role, t) for i, t in enumerate(texts)]


CASES = {
    "nulls, ties and empty texts": [(1, None, None, "a"), (1, 0, "user", None), (1, 0, "user", "b"), (1, 0, "user", "b"), (None, 1, "user", "lost"), (2, 5, "", ""), (2, None, "user", "é\U0001f600"), (-7, 1, "user", "x"), (-100, 0, "user", "x"), (-100, 1, "user", "y")],
    "turnless": [(c, 0, "user", "only") for c in (101, 102, 103, 104, 105, 106, 107, 108)] + say(200, "ab"),
    "copies of copies": [r for c in range(300, 340) for r in say(c, "abcdefgh"[: 3 + c % 5])] + [r for c in range(400, 460) for r in say(c, ["same"] * 9)],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_equals_plain_version(spark, case):
    rows = CASES[case]
    assert got(prefixtrie.trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(rows)


def test_whole_table_equals_sql_and_plain_version(spark, tiny):
    df = prefixtrie.op11_prefix_trie(spark, tiny).cache()
    assert_same(df, prefixtrie.OP11_SQL, tiny)
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(df) == plain_trie(rows)


def test_rounds_go_as_deep_as_different_conversations_agree(spark):
    """Copies and long tails cost no rounds: 40 copies of one conversation of 12 turns and one of 300 agree in 2 turns."""
    base = [f"t{i}" for i in range(12)]
    rows = [r for c in range(0, 400, 100) for r in say(c, base)] + say(500, [*base[:2], *(f"u{i}" for i in range(298))])
    turns, _ = prefixtrie.rebuilt(prefixtrie.ordered_turns(spark.createDataFrame(rows, SCHEMA)))
    plain = plain_trie(rows)
    assert got(prefixtrie.trie(spark.createDataFrame(rows, SCHEMA))) == plain
    assert turns.count() == len(rows)
    whole = turns.groupBy("conv").agg({"*": "count", "len": "sum"}).toDF("rep", "n", "total").where("rep in (0, 500)").selectExpr("rep", "1L as w", "n", "total")
    levels = prefixtrie.refined(turns.withColumnRenamed("conv", "rep"), whole)
    assert len(levels) == 4


def test_numbers_do_not_depend_on_partitions(spark):
    """A conversation cut over many range partitions is numbered as in one."""
    rows = say(5, [f"turn {i % 7}" for i in range(500)]) + say(6, "abc")
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted((r["conv"], r["pos"], r["before"]) for r in prefixtrie.ordered_turns(df.coalesce(1)).collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = sorted((r["conv"], r["pos"], r["before"]) for r in prefixtrie.ordered_turns(df.repartition(16)).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    size, expected = {5: 0, 6: 0}, []
    for conv, pos, _, text in rows:
        expected.append((conv, pos, size[conv]))
        size[conv] += len(text)
    assert want == many == sorted(expected)


def test_empty_table_and_clashing_columns(spark):
    assert prefixtrie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = say(1, "ab") + say(2, "abc")
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as pos", "3 as key", "4 as len", "5 as before", "6 as part", "7 as rep", "8 as h", "9 as base", "10 as depth")
    assert got(prefixtrie.trie(clash)) == plain_trie(rows)
