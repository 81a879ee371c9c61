"""Dedup of repeated multi-line chunks with content-defined boundaries.

A rolling hash runs over the hashes of ``WINDOW`` consecutive lines.  Each of
its first ``FAMILIES`` bits cuts the text on its own: the first half of the
bits after the lines that were hashed, the other half before them.  Whether a
place is a boundary depends on the lines next to it only, so boundaries move
along when lines are put in or taken out elsewhere, and a passage that is
repeated between foreign lines is cut alike at both its ends by some of the
families.  One more family cuts before and after every line of more than
``LONG_WORDS`` words, which is a whole paragraph without line feeds.  Lines of
chunks that occur more than once in the corpus go, but for the chunk's first
occurrence, after their bytes have been compared with those of the first, if
the chunk has two lines or more or is such a paragraph.

Everything is DataFrame functions: chunks are cut inside the row by array
functions, occurrences are counted by a partially aggregated group-by on the
chunk's 64-bit hash, and only lines of repeated chunks are shuffled with their
text, once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.shared import drop_stored, free_names, stored, table

#: Lines under the rolling hash, and families of boundaries (half of them after the hashed lines, half before).
WINDOW, FAMILIES = 2, 6
#: Multiplier and modulus of the rolling hash.
_BASE, _PRIME = 1_000_003, 2_147_483_647
MIN_LINES = 2
#: A line of more words is a chunk of its own.  Words are what stands between spaces.
LONG_WORDS = 50
#: Orders documents without an id behind all others.
_LAST = 9223372036854775807


def text_id(text: Column) -> Column:
    """Tells rows apart that share a doc_id but not the text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_id(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST))


def _long(line: Column) -> Column:
    return (F.length(line) > 2 * LONG_WORDS) & (F.regexp_count(line, F.lit("[^ ]+")) > LONG_WORDS)


def _ends(family: int) -> str:
    """Last lines of the family's chunks, from ``r``, the rolling hash of each line and its next, or from ``big``, the long lines."""
    if family == FAMILIES:
        return "filter(sequence(1, n), i -> i = n OR big[i - 1] OR big[i])"
    if family < FAMILIES // 2:
        return f"filter(sequence(1, n), i -> i = n OR (i >= 2 AND (r[i - 2] >> {family}) % 2 = 1))"
    return f"filter(sequence(1, n), i -> i = n OR (i <= n - 2 AND (r[i] >> {family}) % 2 = 1))"


def _chunks(docs: DataFrame) -> DataFrame:
    """Rows of ``docs(row_id, text)`` as ``row_id, text_id, a, e, chunk``: first and last line of every chunk that counts, and its hash."""
    each = F.transform(_lines(F.col("text")), lambda x: F.struct(F.md5(x.cast("binary")).alias("d"), _long(x).alias("big")))
    rows = docs.select("row_id", text_id(F.col("text")).alias("text_id"), each.alias("x"))
    # generators keep hashes from being computed anew in each expression that reads them
    rows = rows.select("row_id", "text_id", F.explode(F.array("x")).alias("x")).where(f"size(x) >= {MIN_LINES} OR x[0].big")
    rows = rows.select("row_id", "text_id", F.col("x.d").alias("d"), F.col("x.big").alias("big"))
    hashed = F.transform("d", lambda x: F.conv(F.substring(x, 1, 7), 16, 10).cast("long"))
    rows = rows.select("row_id", "text_id", "d", "big", F.size("d").alias("n"), F.explode(F.array(hashed)).alias("h"))
    rolled = f"zip_with(slice(h, 1, n - 1), slice(h, 2, n - 1), (x, y) -> (x * {_BASE} + y) % {_PRIME})"
    rows = rows.select("row_id", "text_id", "d", "big", "n", F.explode(F.array(F.expr(rolled))).alias("r"))
    rows = rows.select("row_id", "text_id", "d", "big", F.explode(F.array(*(F.expr(_ends(f)) for f in range(FAMILIES + 1)))).alias("ends"))
    spans = F.expr("transform(ends, (e, k) -> struct(if(k = 0, 1, ends[k - 1] + 1) AS a, e AS e))")
    counts = F.filter(spans, lambda s: (s["e"] - s["a"] >= MIN_LINES - 1) | F.get("big", s["a"] - 1))
    rows = rows.select("row_id", "text_id", "d", F.explode(counts).alias("s"))
    return rows.select("row_id", "text_id", F.col("s.a").alias("a"), F.col("s.e").alias("e"), F.xxhash64(F.slice("d", F.col("s.a"), F.col("s.e") - F.col("s.a") + 1)).alias("chunk"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``row_id, text_id, gone``: numbers, from 1, of the lines to remove from each row of ``docs(row_id, text)`` that loses any.

    They are the lines of all byte-equal occurrences of a chunk but the first
    by (row_id, text_id, line).
    """
    found = stored(_chunks(docs).distinct(), "spans")  # families agree on some chunks; rows that are repeated whole count once
    place = F.struct("row_id", "text_id", "a")
    twice = stored(found.groupBy("chunk").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1").select("chunk", "first"), "chunks")
    # a merge join at every size, so that hot chunks may be split
    again = found.hint("merge").join(twice, "chunk").where(place != F.col("first"))
    # each line is held against its place in the first occurrence, the earliest if several chunks hold it
    line = again.select("row_id", "text_id", F.explode(F.sequence("a", "e")).alias("i"), "a", "first")
    source = F.struct(F.col("first.row_id").alias("row_id"), F.col("first.text_id").alias("text_id"), (F.col("first.a") + F.col("i") - F.col("a")).alias("i"))
    later = stored(line.groupBy("row_id", "text_id", "i").agg(F.min(source).alias("of")), "later")
    wanted = later.select("row_id", "text_id", "i", "of").union(later.select("of.row_id", "of.text_id", "of.i").distinct().select("row_id", "text_id", "i", F.lit(None).cast(later.schema["of"].dataType)))
    wanted = wanted.groupBy("row_id", "text_id").agg(F.collect_list(F.struct("i", "of")).alias("w"))  # bounded by the text's lines
    texts = docs.select("row_id", text_id(F.col("text")).alias("text_id"), "text")
    cut = texts.hint("merge").join(wanted, ["row_id", "text_id"]).select("row_id", "text_id", _lines(F.col("text")).alias("lines"), F.explode("w").alias("w"))
    lines = stored(cut.select("row_id", "text_id", F.col("w.i").alias("i"), F.col("w.of").alias("of"), F.element_at("lines", F.col("w.i")).alias("line")), "lines")
    # rows that are repeated whole give their lines several times
    firsts = lines.where("of is null").groupBy("row_id", "text_id", "i").agg(F.min("line").alias("kept"))
    firsts = firsts.select(F.struct("row_id", "text_id", "i").alias("of"), "kept")
    same = lines.where("of is not null").hint("merge").join(firsts, "of").where("line = kept")
    out = stored(same.groupBy("row_id", "text_id").agg(F.sort_array(F.collect_set("i")).alias("gone")), "gone")
    drop_stored(found, twice, later, lines)
    return out


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with the row_id that orders occurrences: the doc_id, nulls last."""
    return docs.select(_row_id(docs).alias("row_id"), F.col("text").cast("string").alias("text"))


def cleaned(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the lines of repeated chunks taken out of ``text``; all other columns stay.

    A null text stays null, an empty one empty; a text that loses all its
    lines becomes empty, or its row goes if ``drop_emptied``.  ``n_chars``,
    where present, follows the text.  Rows that share both doc_id and text
    count as one document and stay alike; rows that share a doc_id (or have
    none) and differ in text are documents of their own.
    """
    # names that no column of the table has
    row, of_text, gone, lines, kept = free_names(docs.columns, "_row", "_text", "_gone", "_lines", "_kept")
    found = repeated_lines(_numbered(docs)).select(F.col("row_id").alias(row), F.col("text_id").alias(of_text), F.col("gone").alias(gone))
    both = docs.hint("merge").join(found, (_row_id(docs) == found[row]) & (text_id(docs["text"].cast("string")) == found[of_text]), "left")
    same = both.where(F.col(row).isNull()).drop(row, of_text, gone)
    # only rows that lose lines are cut again; as generators, so that nothing later computes the lines anew
    cut = both.where(F.col(row).isNotNull()).withColumn(lines, F.explode(F.array(_lines(F.col("text").cast("string")))))
    left = cut.withColumn(kept, F.explode(F.array(F.expr(f"array_except(sequence(1, size({lines})), {gone})"))))
    left = left.where(F.size(kept) > 0) if drop_emptied else left
    new = left.withColumn("text", F.explode(F.array(F.array_join(F.transform(kept, lambda i: F.element_at(lines, i)), "\n"))))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return same.union(new.drop(row, of_text, gone, lines, kept))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines, removed runs of lines and removed lines of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.size(_lines(F.col("text"))).cast("long")
    rows = docs.select("doc_id", n.alias("n_lines"), _row_id(docs).alias("row_id"), text_id(F.col("text").cast("string")).alias("text_id"))
    out = rows.join(repeated_lines(_numbered(docs)), ["row_id", "text_id"], "left")
    runs = F.size(F.array_except("gone", F.transform("gone", lambda i: i + 1)))
    return out.select(
        "doc_id",
        "n_lines",
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(runs).cast("long").alias("removed_runs"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_lines"),
        F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"),
    )


#: DuckDB SQL for op2_line_dedup's rows.
OP2_SQL = f"""
WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
pos AS (SELECT doc_id, len(l) AS n, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM lines),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h, len(regexp_extract_all(line, '[^ ]+')) > {LONG_WORDS} AS big FROM pos),
rolled AS (SELECT *, (h * {_BASE} + lead(h) OVER (PARTITION BY doc_id ORDER BY i)) % {_PRIME} AS r FROM hashed),
around AS (SELECT *, lag(r) OVER (PARTITION BY doc_id ORDER BY i) AS r_before, lead(r) OVER (PARTITION BY doc_id ORDER BY i) AS r_after, lead(big) OVER (PARTITION BY doc_id ORDER BY i) AS big_after FROM rolled),
ends AS (
  SELECT doc_id, i, line, big, f, i = n OR CASE WHEN f = {FAMILIES} THEN big OR big_after WHEN f < {FAMILIES // 2} THEN i >= 2 AND (r_before >> f) % 2 = 1 ELSE i <= n - 2 AND (r_after >> f) % 2 = 1 END AS ends_here
  FROM around, range(0, {FAMILIES + 1}) t(f)),
numbered AS (SELECT *, coalesce(sum(ends_here::INT) OVER (PARTITION BY doc_id, f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_no FROM ends),
chunks AS (SELECT doc_id, min(i) AS a, max(i) AS e, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY doc_id, f, chunk_no HAVING count(*) >= {MIN_LINES} OR bool_or(big)),
spans AS (SELECT DISTINCT doc_id, a, e, chunk FROM chunks),
ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, a) AS rn FROM spans),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, e + 1)) AS i FROM ranked WHERE rn > 1),
runs AS (SELECT *, CASE WHEN lag(i) OVER (PARTITION BY doc_id ORDER BY i) = i - 1 THEN 0 ELSE 1 END AS s FROM gone),
done AS (SELECT doc_id, sum(s) AS removed_runs, count(*) AS removed_lines, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS removed FROM runs GROUP BY 1)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(removed_runs, 0) AS BIGINT) AS removed_runs,
       CAST(coalesce(removed_lines, 0) AS BIGINT) AS removed_lines, coalesce(removed, '') AS removed
FROM lines d LEFT JOIN done g ON d.doc_id = g.doc_id
"""
