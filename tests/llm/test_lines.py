import random
import textwrap

from tests.llm.helpers import docs, empty
from tests.oracle import assert_same
from windrow.llm import linededup as ld
from windrow.llm import licenses as lc


def test_lines_equal_sql(spark, tiny):
    assert_same(ld.op2_line_dedup(spark, tiny), ld.OP2_SQL, tiny)


def test_licenses_equal_sql(spark, tiny):
    assert_same(lc.op9_licenses(spark, tiny), lc.OP9_SQL, tiny)


def test_shifted_passage_is_removed_but_for_its_first_place(spark):
    r = random.Random(3)
    line = lambda: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(6))
    passage = [line() for _ in range(60)]
    a = [line() for _ in range(5)] + passage + [line()]
    b = [line() for _ in range(8)] + passage[:30] + [line()] + passage[30:] + [line() for _ in range(3)]
    d = spark.createDataFrame([(1, "\n".join(a)), (2, "\n".join(b))], "doc_id long, text string")
    out = {x["doc_id"]: x["text"].split("\n") for x in ld.cleaned(d).collect()}
    assert out[1] == a
    left = [x for x in out[2] if x in set(passage)]
    assert len(left) < 8
    assert [x for x in b if x not in set(passage)] == [x for x in out[2] if x not in set(passage)]


def test_rows_that_share_an_id_keep_their_own_text(spark):
    r = random.Random(6)
    own = lambda: "\n".join(f"own{r.randint(0, 10**9)} line" for _ in range(40))
    shared_part = "\n".join(f"shared {j}" for j in range(40))
    for name in (None, 7):
        plain = [own() for _ in range(12)]
        rows = [(name, t) for t in plain] + [(name, shared_part)] * 2 + [(name, shared_part + "\n" + t) for t in plain]
        out = [x["text"] for x in ld.cleaned(docs(spark, rows)).collect()]
        assert len(out) == len(rows)
        left = "\n".join(out)
        # a unique line is never lost
        assert all(line in left for t in plain for line in t.split("\n"))
        assert all(f"shared {j}\n" in left + "\n" for j in range(40))
        # what is repeated still goes
        assert left.count("shared 20\n") < 14


def test_removed_chunks_are_counted_once(spark, tmp_path):
    text = "\n".join(f"line {j}" for j in range(40))
    spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {x["doc_id"]: x for x in ld.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert rows[1]["removed_lines"] == 0
    assert rows[2]["removed_lines"] == len(rows[2]["removed"].split(",")) > 30
    assert rows[2]["removed_lines"] <= rows[2]["n_lines"] == 40
    assert 1 <= rows[2]["removed_runs"] < 5


def test_every_line_survives_and_short_passages_go(spark):
    r = random.Random(9)
    line = lambda: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(6))
    for size, share in ((5, 0.6), (8, 0.85), (15, 0.9)):
        rows = []
        for p in range(60):
            passage = [line() for _ in range(size)]
            for _ in range(2):
                rows.append((r.choice([None, len(rows), 3]), "\n".join([line() for _ in range(r.randint(0, 6))] + passage + [line() for _ in range(r.randint(0, 6))])))
        out = [x["text"].split("\n") for x in ld.cleaned(docs(spark, rows)).collect()]
        left = [x for t in out for x in t]
        assert {x for _, t in rows for x in t.split("\n")} == set(left) - {""}
        again = sum(len(t.split("\n")) for _, t in rows) - sum(x != "" for x in left)
        assert again >= share * size * 60


def test_long_lines_go_wherever_they_stand(spark):
    r = random.Random(12)
    line = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    passages, short = [line(r.randint(51, 90)) for _ in range(40)], line(50)
    rows = [(i, "\n".join([*(line(6) for _ in range(r.randint(0, 4))), p, *(line(6) for _ in range(r.randint(0, 4)))])) for i, p in enumerate(passages * 3)]
    rows += [(200 + i, f"{line(6)}\n{short}\n{line(6)}") for i in range(3)]
    rows += [(300, f"{passages[0]}\n{line(6)}\n{passages[0]}"), (301, " " * 300 + "x y"), (302, " " * 300 + "x y"), (303, line(60)), (None, passages[1])]
    out = {x["doc_id"]: x["text"].split("\n") for x in ld.cleaned(docs(spark, rows)).collect()}
    for i, text in rows:
        want = text.split("\n") if i is not None and (i < 40 or i > 300 or 200 <= i < 300) else [x for x in text.split("\n") if x not in passages] or [""]
        assert out[i] == want


def test_awkward_lines(spark):
    two = "x one\ny two\nz three"
    rows = [(1, two), (2, two), (3, None), (4, ""), (5, "\n\n"), (None, two), (6, "single"), (6, "single"), (7, "a\n" * 5000)]
    d = docs(spark, rows)
    out = ld.cleaned(d)
    assert out.schema == d.schema
    by = sorted((r["doc_id"] or -1, r["text"], r["n_chars"]) for r in out.collect() if r["text"] is not None)
    assert (1, two, len(two)) in by
    assert out.count() == len(rows)
    assert out.where("doc_id = 3 and text is null").count() == 1
    assert [t for i, t, _ in by if i == 6] == ["single", "single"]
    assert all(len(t) == n for _, t, n in by)
    kept = ld.cleaned(d, drop_emptied=True)
    assert kept.where("doc_id = 4").count() == 1
    assert ld.cleaned(empty(spark)).count() == 0


def test_license_blocks(spark):
    rows = [
        (1, "Intro.\nThis work is licensed under the GNU General Public License, version 3.\nEnd"),
        (2, "cc by cc by, all RIGHTS reserved"),
        (3, None), (4, ""), (5, "Licensed under the apache license version 2.0"), (None, "Released under the MIT License."), (5, "x"),
        (6, "license mit the released far under away " * 3), (7, "word " * 50_000),
    ]
    d = docs(spark, rows)
    got = {(r["doc_id"], r["n_words"]): r for r in lc.scanned(d).collect()}
    assert len(got) == len(rows)
    one = got[1, 14]
    assert (one["n_base"], one["first_word"], one["last_word"], one["base_labels"], one["labels"], one["score"]) == (1, 8, 8, "gpl", "gpl", 1.0)
    two = got[2, 7]
    assert (two["n_base"], two["first_word"], two["last_word"], two["base_labels"]) == (3, 0, 4, "cc-by,reserved")
    assert got[3, 0]["labels"] == ""
    assert got[5, 8]["labels"] == "apache-2.0"
    assert got[None, 5]["labels"] == "mit"
    assert got[7, 50_000]["score"] == 0.0
    assert lc.scanned(empty(spark)).count() == 0


def test_every_row_is_judged_by_its_own_text(spark):
    rows = [(None, "Released under the MIT License."), (None, "nothing at all here"), (7, "All rights reserved."), (7, "nothing either"), (7, None)]
    got = sorted((r["n_words"], r["labels"], r["score"]) for r in lc.scanned(docs(spark, rows)).collect())
    assert got == [(0, "", 0.0), (2, "", 0.0), (3, "reserved", 1.0), (4, "", 0.0), (5, "mit", 1.0)]


def test_wrapped_notices(spark):
    def wrapped(text, width, prefix=""):
        return "\n".join(prefix + x for x in textwrap.wrap(text, width))

    rows, want = [], {}
    for label, text in lc.TEMPLATES:
        for width in (24, 40, 72):
            for prefix in ("", " * ", "# "):
                want[len(rows)] = label
                rows.append((len(rows), f"Some intro\n\n{wrapped('Copyright: some people. ' + text + ' Use it well.', width, prefix)}\n\nThe end"))
    far = len(rows)
    words = lc.TEMPLATES[1][1].split()
    rows.append((far, "\n".join(f"{w} and then many other plain words before the next" for w in words)))
    rows.append((far + 1, "\n\n".join(reversed(words))))  # a block is a set: order and line feeds do not matter
    got = {r["doc_id"]: r for r in lc.scanned(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(label in got[i]["labels"].split(",") and got[i]["score"] >= 0.8 for i, label in want.items())
    assert (got[far]["labels"], got[far]["score"]) == ("", 0.0)
    assert (got[far + 1]["labels"], got[far + 1]["score"]) == ("mit", 1.0)


def test_blocks_equal_brute_force(spark):
    r = random.Random(11)
    tokens = sorted({w for _, t in lc.TEMPLATES for w in lc.normal_words(t)})
    rows = []
    for i in range(300):
        words = lc.normal_words(r.choice(lc.TEMPLATES)[1])
        out = []
        for w in words:  # drop, replace, repeat and pad words of a template
            x = r.random()
            out += [] if x < 0.1 else [r.choice(tokens)] if x < 0.2 else [w, "plain"] if x < 0.3 else [w, w] if x < 0.35 else [w]
        rows.append((i, " \n"[r.random() < 0.2].join([*r.choices(tokens, k=r.randint(0, 20)), *out, *r.choices(tokens, k=r.randint(0, 20))])))
    got = {x["doc_id"]: x for x in lc.scanned(docs(spark, rows)).collect()}
    some = 0
    for i, text in rows:
        words, labels, score = lc.normal_words(text), set(filter(None, got[i]["base_labels"].split(","))), 0.0
        for label, t in lc.TEMPLATES:
            want, need, reach = lc._sizes(t, lc.NUM, lc.DEN)
            most = max(len(set(words[j : j + reach]) & set(want)) for j in range(len(words)))
            if most >= need:
                labels.add(label)
                score = max(score, most / len(want))
        assert (got[i]["labels"], got[i]["score"]) == (",".join(sorted(labels)), score)
        some += score > 0
    assert some > 50
