import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import docs, empty
from windrow.llm import bpe
from windrow.llm.shared import table


@pytest.fixture(scope="module")
def both():
    path = bpe.default_tokenizer()
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    with open(path, encoding="utf-8") as f:
        return t, bpe.WordBpe(f.read())


def same(both, text):
    t, b = both
    ids = t.encode(text, add_special_tokens=False).ids
    raw, decoded = b.encode(text)
    assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == ids
    assert decoded == t.decode(ids, skip_special_tokens=False) == b.decode(raw)


pieces = st.one_of(st.sampled_from(["'s", "'LL", "the", "<|endoftext|>", "<|startoftext|>", "<|", "123", "İ", "ΑΣ", "é", "é", "\u00a0", "\u2003", "\n", "😀", "中文", "!!", "ß"]), st.text(st.characters(max_codepoint=0x2FF), max_size=6))


@given(st.lists(pieces, max_size=25))
@settings(max_examples=400, deadline=None)
def test_equals_library(both, parts):
    same(both, "".join(parts))


@pytest.mark.parametrize("n", [95, 96, 97, 200, 5000])
def test_long_words(both, n):
    same(both, "abcthe" * (n // 6 + 1))
    same(both, "!" * n)


@given(st.text("abcdeth", min_size=2, max_size=120))
@settings(max_examples=150, deadline=None)
def test_heap_and_scan_agree(both, word):
    b = both[1]
    parts = [b.first[c] for c in word.encode()]
    assert b._scan(list(parts)) == b._heap(list(parts))


def test_cache_is_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        b = bpe.WordBpe(f.read())
    text = " ".join(f"w{i}x{i * 7}" for i in range(500))
    assert b.encode(text) == both[1].encode(text)
    assert len(b.cache) + len(b.cache.old) <= 101


def test_whole_table(spark, tiny, both):
    t = both[0]
    text = {r["doc_id"]: r["text"] for r in table(spark, tiny, "documents").collect()}
    for r in bpe.op10_bpe(spark, tiny).collect():
        ids = t.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_rows(spark):
    rows = bpe.digests(docs(spark), bpe.default_tokenizer()).collect()
    assert len(rows) == 12
    nothing = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows if r["doc_id"] in (3, 4, 5)} == {(0, nothing, nothing)}
    assert bpe.digests(empty(spark), bpe.default_tokenizer()).count() == 0


def test_every_code_point_equals_library(both):
    """Each code point between letters, digits and spaces, many of them in one text."""
    t, b = both
    step = 64
    for start in range(0, 0x110000, step):
        text = "\n".join(f"a{chr(c)}b1{chr(c)} {chr(c)}{chr(c)}. {chr(c)}2" for c in range(start, start + step) if not 0xD800 <= c < 0xE000)
        if text and b.encode(text)[0] != struct.pack(f"<{len(ids := t.encode(text, add_special_tokens=False).ids)}I", *ids):
            raise AssertionError(f"from {start:#x}")
