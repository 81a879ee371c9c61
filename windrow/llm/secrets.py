"""Secret scans: three fixed patterns, and windows of high Shannon entropy.

The entropy scan looks at candidate strings (long runs of key-like
characters), classifies each by its characters, and slides a window over it;
the entropy follows from character counts that are updated as one character
enters and one leaves.  Windows above the class's threshold join to spans.
An allow-list suppresses what is known not to be secret.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.shared import table

#: Fixed patterns of the contract.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_token", "entropy_lower", "entropy_upper")
#: Characters of the sliding window, and bits a character that it must exceed, by class.
WINDOW = 20
THRESHOLD = {"entropy_hex": 3.0, "entropy_base64": 3.75, "entropy_token": 3.75, "entropy_lower": 3.6, "entropy_upper": 3.6}
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
_HEX_CLASS = re.compile(r"[0-9A-Fa-f]+\Z")
_TOKEN_CLASS = re.compile(r"[A-Za-z0-9_-]+\Z")
#: Strings that are never secret: sample keys, UUIDs, plain runs, plain numbers, digests that are named as such.
ALLOW = (
    re.compile(r"EXAMPLE|example|placeholder|changeme|XXXX|xxxx"),
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z"),
    re.compile(r"0123456789|abcdefghij|ABCDEFGHIJ|qwertyuiop"),
    re.compile(r"\A[0-9]+\Z"),
)
ALLOW_BEFORE = re.compile(r"(?:sha\d*|md5|integrity|checksum|digest|commit|etag)[\s\"'=:-]{0,4}\Z", re.I)
#: A character enters before one leaves.
_LOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the contract's three kinds; letter case of ASCII only is ignored where it is."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low or not low.isascii():
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


def window_spans(text: str, threshold: float) -> Iterator[tuple[int, int]]:
    """Joined spans of windows whose entropy exceeds ``threshold`` bits a character."""
    if len(text) < WINDOW:
        return
    count: dict[str, int] = {}
    total = 0.0  # of c log2 c over the window's characters
    begin = end = -1
    bound = (math.log2(WINDOW) - threshold) * WINDOW
    for i, ch in enumerate(text):
        c = count.get(ch, 0)
        total += _LOG[c + 1] - _LOG[c]
        count[ch] = c + 1
        if i >= WINDOW:
            old = text[i - WINDOW]
            c = count[old]
            total += _LOG[c - 1] - _LOG[c]
            count[old] = c - 1
        if i >= WINDOW - 1 and total < bound - 1e-9:
            lo = i - WINDOW + 1
            if begin >= 0 and lo <= end:
                end = i + 1
            else:
                if begin >= 0:
                    yield begin, end
                begin, end = lo, i + 1
    if begin >= 0:
        yield begin, end


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of high-entropy stretches that no base span holds."""
    out = []
    for m in _CANDIDATE.finditer(text):
        s = m[0]
        if any(a.search(s) for a in ALLOW) or ALLOW_BEFORE.search(text, max(0, m.start() - 16), m.start()):
            continue
        if _HEX_CLASS.match(s):
            kind = 3
        elif s.lower() == s:
            kind = 6  # of letters only small ones: base36
        elif s.upper() == s:
            kind = 7  # of letters only capital ones: base32
        else:
            kind = 5 if _TOKEN_CLASS.match(s) else 4
        for lo, hi in window_spans(s, THRESHOLD[KINDS[kind]]):
            lo, hi = lo + m.start(), hi + m.start()
            if not any(b <= lo and hi <= e for b, _, e in base):
                out.append((lo, kind, hi))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` of every row: spans as ``kind:start:end`` in code points, comma-joined by start.

    ``base`` holds the fixed patterns only.  Null and empty texts have no
    spans; null doc_ids and repeated rows are kept; other columns are not read.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, spans = [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                base = base_spans(text)
                bases.append(joined(base))
                spans.append(joined(base + entropy_spans(text, base)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bases, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, base string, spans string")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and digest of the base spans, and all spans."""
    s = scanned(table(spark, sf_dir, "documents"))
    counts = [F.regexp_count("base", F.lit(f"(?:^|,){k}:")).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return s.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
