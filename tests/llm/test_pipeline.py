import hashlib
import struct
from collections import defaultdict

import corpus_pipeline as cp
import tokenizers
from tests.llm.helpers import docs, empty
from tests.llm.test_decontaminate import brute as overlaps
from tests.llm.test_jaccard import brute as components
from tests.llm.test_toxicity import plain_scores
from windrow.llm import bpe
from windrow.llm import linededup as ld
from windrow.llm.shared import stored, table


def plain_cleaned(rows):
    """Texts without the lines of repeated chunks, by (doc_id, text) of rows whose ids differ; None for texts that had nothing else."""
    lines = {i: (t or "").split("\n") for i, t in rows}
    spans = set()
    for i, x in lines.items():
        h = [int(hashlib.md5(q.encode()).hexdigest()[:7], 16) for q in x]
        r = [(a * 1_000_003 + b) % 2_147_483_647 for a, b in zip(h[:-1], h[1:], strict=True)]
        big = [len([w for w in q.split(" ") if w]) > ld.LONG_WORDS for q in x]
        for f in range(ld.FAMILIES + 1):
            a = 0
            for k in range(len(x)):
                at = k - 1 if f < ld.FAMILIES // 2 else k + 1  # the pair before the end, or the one after it
                cut = k == len(x) - 1 or (any(big[k : k + 2]) if f == ld.FAMILIES else 0 <= at < len(r) and r[at] >> f & 1)
                if cut:
                    if k - a + 1 >= ld.MIN_LINES or big[a]:
                        spans.add((i, a, k + 1))
                    a = k + 1
    places = defaultdict(list)
    for i, a, e in spans:
        places["\n".join(lines[i][a:e])].append((i, a, e))
    gone = defaultdict(set)
    for same in places.values():
        for i, a, e in sorted(same)[1:]:
            gone[i] |= set(range(a, e))
    out = {}
    for i, t in rows:
        left = [q for k, q in enumerate(lines[i]) if k not in gone[i]]
        out[i] = t if not gone[i] else "\n".join(left) if left else None
    return {i: t for i, t in out.items() if t is not None or not gone[i]}


def rows_of(d):
    return [(r["doc_id"], r["text"]) for r in d.collect()]


def test_every_stage_equals_brute_force_on_its_own_input(spark, tiny):
    """Each stage's kept rows and texts, over what the stage before has kept; the run gives the last one's rows."""
    labels = [(r["doc_id"], r["toxic"]) for r in table(spark, tiny, "labels").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, tiny, "benchmark").collect()]
    library = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    library.no_truncation()
    library.no_padding()
    d = table(spark, tiny, "documents")
    want_columns, before = d.columns, rows_of(d)
    for name, stage in cp.STAGES:
        d = stored(stage(spark, d, tiny), "t")
        if name == "bpe":
            got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in d.collect()}
            for i, t in before:
                ids = library.encode(t or "", add_special_tokens=False).ids
                text = library.decode(ids, skip_special_tokens=False)
                assert got.pop(i) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
            assert not got
            continue
        assert d.columns == want_columns
        after = rows_of(d)
        if name == "toxicity":
            want = {i for i, _, s in plain_scores(before, labels) if s < 0.5}
        elif name == "line_dedup":
            want = plain_cleaned(before)
            assert dict(after) == want
            want = set(want)
        elif name == "ngram_jaccard":
            want = {i for i, (_, c) in components(before, 5, 4, 5).items() if c == i}
        else:
            hit = {i for i, _ in overlaps(before, items)}
            want = {i for i, _ in before} - hit
            assert len({i for i, _ in after} - want) <= 0.03 * len(hit)  # seeds are a filter
            want = {i for i, _ in after} | want
        assert {i for i, _ in after} == want, name
        assert dict(after).items() <= dict(before).items() or name == "line_dedup"
        before = after
    assert len(before) > 0.6 * table(spark, tiny, "documents").count()
    assert sorted(map(tuple, cp.run(spark, tiny).collect())) == sorted(map(tuple, d.collect()))


def test_awkward_documents_pass_all_stages(spark, tiny):
    long = "x" * 60_000
    extra = [(20, "a fine line of its own\nand a second one that stays"), (21, long + " some words behind a very long one"), (None, "no id but words of its own here"), (None, "no id but words of its own here")]
    d = docs(spark).unionByName(docs(spark, extra))
    for name, stage in cp.STAGES[:-1]:
        d = stored(stage(spark, d, tiny), "t")
    left = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert {i for i, _ in left} >= {1, 3, 4, 5, 6, 7, 9, 20, 21}
    assert dict((i, t) for i, t in left if i is not None)[20] == extra[0][1]
    assert dict((i, t) for i, t in left if i is not None)[21] == extra[1][1]
    assert [t for i, t in left if i is None and t] == [extra[2][1]]  # of rows without an id one of each text stays
    assert cp.STAGES[-1][1](spark, d, tiny).count() == len(left)


def test_empty_documents(spark, tiny):
    d = empty(spark)
    for _, stage in cp.STAGES:
        d = stored(stage(spark, d, tiny), "t")
    assert d.count() == 0
