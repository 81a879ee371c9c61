"""BPE encoding and decoding on a contiguous rank array.

A word is held as its parts with the rank of every adjacent pair beside
them; the least rank is found by a scan, its boundary is deleted and the two
neighbouring ranks are refreshed.  Words longer than ``SHORT`` parts, for
which scans would be quadratic, keep the ranks in a heap instead; both take
the leftmost of equal ranks first.  Encoded words are kept in a bounded cache.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.shared import table

#: Longest word that is merged by scanning.
SHORT = 96
#: Words kept for reuse by a worker.
CACHE_WORDS = 3 << 15
#: Text of one output batch.
BATCH_CHARS = 1 << 21
_NONE = 1 << 60

#: Characters with the White_Space property.
_WHITE = "\t-\r \x85\xa0  -     　"


#: Ranges of the letters and digits of Unicode 16, which the library's split knows and Python's tables (15.1) do not.
_NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
#: Capital letters of Unicode 16 and 17, first and last of a range, and the small letter of the first.
_NEW_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
_LOWERED = {chr(c): chr(c - first + small) for first, last, small in _NEW_CAPITALS for c in range(first, last + 1)}


def _byte_chars() -> list[str]:
    """Printable stand-in of each byte: itself where printable, else code points from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out



@functools.cache
def _late_letters() -> str:
    """Ranges, for a character class, of the letters and digits that are new since Unicode 16."""
    known = {c for a, e in _NEW_LETTERS for c in range(a, e + 1)}
    free = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c not in known and unicodedata.category(chr(c)) == "Cn")
    out = []
    for run in regex.findall(r"[\p{L}\p{N}]+", free):
        start = 0
        for i in range(1, len(run) + 1):
            if i == len(run) or ord(run[i]) != ord(run[i - 1]) + 1:
                out.append(f"{run[start]}-{run[i - 1]}" if i - start > 1 else run[start])
                start = i
    return "".join(out)


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class _Words(dict):
    """Ids and decoded text by word, made when first asked for.

    Two generations: when the young one is full it becomes the old one, so
    words in use survive and at most twice CACHE_WORDS are held.
    """

    def __init__(self, bpe: WordBpe):
        self.bpe, self.old = bpe, {}

    def __missing__(self, word: str) -> tuple[bytes, str]:
        got = self.old.get(word)
        if got is None:
            bpe = self.bpe
            ids = [bpe.special[word]] if word in bpe.special else bpe.word_ids(word)
            got = _little(ids), " ".join([bpe.token_of[i] for i in ids])
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        if len(word) <= SHORT:
            self[word] = got
        return got


class WordBpe:
    """Encoder of a tokenizer file whose model is word-level BPE with a word-end suffix.

    Normalisation (NFC, white space to one space, lower case), the split
    pattern and the byte alphabet follow the file; other kinds are refused.
    The library splits by Unicode 16 and lowers by Unicode 17, whatever the
    tables of this Python and of the pattern's module.
    """

    def __init__(self, spec: str):
        conf = json.loads(spec)
        model, kinds = conf["model"], [n["type"] for n in conf["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or conf["decoder"] is not None or conf["post_processor"] is not None:
            raise ValueError("not a word-level BPE file of the supported kind")
        self.vocab = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.token_of = {i: t for t, i in self.vocab.items()}
        self.rank, self.made = {}, []
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.rank[self.vocab[a] << 32 | self.vocab[b]] = r
            self.made.append(self.vocab[a + b])
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.token_of |= {i: t for t, i in self.special.items()}
        chars = _byte_chars()
        self.first = [self.vocab.get(c, -1) for c in chars]
        self.last = [self.vocab.get(c + self.end, -1) for c in chars]
        pattern = conf["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        plain = pattern.replace("\\s", _WHITE)
        self.split = regex.compile(plain, regex.V0).findall
        late = _late_letters()
        self.rare = regex.compile(f"[{late}{''.join(_LOWERED)}]").search
        self.capital = regex.compile(f"[{''.join(_LOWERED)}]").sub
        old = lambda kind: f"[\\p{{{kind}}}--[{late}]]" if late else f"\\p{{{kind}}}"
        self.split_rare = regex.compile(plain.replace("\\p{L}", old("L")).replace("\\p{N}", old("N")), regex.V1).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        # a special token is looked for only where all of them begin alike
        self.mark = os.path.commonprefix(list(self.special))
        self.space = regex.compile(f"[{_WHITE}]+").sub
        self.cache = _Words(self)

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode()
        parts = [self.first[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        if -1 in parts:
            parts = [p for p in parts if p >= 0]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank, made = self.rank.get, self.made
        ranks = [rank(a << 32 | b, _NONE) for a, b in pairwise(parts)]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            parts[i] = new = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | new, _NONE)
            if i < len(ranks):
                ranks[i] = rank(new << 32 | parts[i + 1], _NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or rank(parts[i] << 32 | parts[j]) != r:
                continue
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (q := rank(parts[k] << 32 | parts[after[k]])) is not None:
                    heapq.heappush(heap, (q, k))
        return [p for p in parts if p >= 0]

    def words(self, text: str) -> list[str]:
        pieces = self.cut(text) if self.cut and self.mark in text else [text]
        rare = not text.isascii() and self.rare(text) is not None
        split = self.split_rare if rare else self.split
        out = []
        for piece in pieces:
            if piece in self.special:
                out.append(piece)
            elif piece:
                plain = unicodedata.normalize("NFC", piece)
                plain = self.space(" ", plain).replace("Σ", "σ").lower()
                if rare:
                    plain = self.capital(lambda m: _LOWERED[m[0]], plain)
                out += split(plain)
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        """Token ids as little-endian 32-bit integers, and the decoded text."""
        found = list(map(self.cache.__getitem__, self.words(text)))
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def decode(self, ids: bytes) -> str:
        return " ".join(self.token_of[int.from_bytes(ids[i : i + 4], "little")] for i in range(0, len(ids), 4))


_BUILT: dict[str, WordBpe] = {}


def _built(spec: str) -> WordBpe:
    """The encoder of a worker process, made once."""
    if spec not in _BUILT:
        _BUILT[spec] = WordBpe(spec)
    return _BUILT[spec]


def encoded(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every row; ids are little-endian unsigned 32-bit integers in a binary.

    Null texts are empty texts: no ids, empty decoded text.  Repeated rows
    and null doc_ids are kept as they are; other columns are not read.  The
    tokenizer file is read on the driver and broadcast (its size is fixed).
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _built(spec.value)
        for batch in batches:
            ids, text, lo, chars = [], [], 0, 0
            for i, t in enumerate(batch.column("text")):
                t = t.as_py() or ""
                a, b = bpe.encode(t)
                ids.append(a)
                text.append(b)
                chars += len(t)
                if chars >= BATCH_CHARS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, i + 1 - lo), pa.array(ids, pa.binary()), pa.array(text, pa.string())], names=["doc_id", "ids", "decoded"])
                    ids, text, lo, chars = [], [], i + 1, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Token count and SHA-256 of ids and decoded text for each row."""
    e = encoded(docs, tokenizer_file)
    return e.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract query: digests of every document."""
    return digests(table(spark, sf_dir, "documents"), default_tokenizer())
