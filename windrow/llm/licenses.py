"""License scan: phrases, and an exact set-similarity join of text blocks with templates.

A template is a set of words.  The text blocks held against it are all
stretches of consecutive words that are 5/4 as long as the template (a shorter
text is one block), so line breaks, comment signs and whatever else stands
between words do not matter.  A block contains the template if it holds at
least NUM / DEN of the template's words.

Tokens are ordered by their document frequency over all documents, the rarest
first.  The rarest common token of a block and a template it contains is
among the template's first ``size - need + 1`` tokens (prefix filter).  Each
place of such a token is joined with the templates that have it there; the
words around it must hold ``need`` template tokens in all (length filter) and
enough of them from that token on in the order (positional filter).  What
passes is verified block by block.

The text is read once: what is stored are the places of template tokens.  All
of it is DataFrame functions.  The templates are constants of the code, so
their tables have a fixed size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.shared import drop_stored, stored, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Fixed templates and their labels: public license texts and the notices that public licenses ask for.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/.",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
        "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to "
        "anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "All rights reserved."),
)
#: Share of a template's tokens that a block must hold; a block is DEN / NUM as long as the template.
NUM, DEN = 4, 5


def normal(text: Column) -> Column:
    """Words of the text with single spaces between them."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP, " "))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _place(phrase: str, last: bool) -> Column:
    """Word number of the phrase's first or last place in ``padded``, else null."""
    key = f" {phrase} "
    if last:
        at = F.length("padded") - len(key) + 2 - F.instr(F.reverse("padded"), key[::-1])
    else:
        at = F.instr("padded", key)
    return F.when(F.contains("padded", F.lit(key)), _spaces(F.expr("padded").substr(F.lit(1), at - 1)).cast("long"))


def normal_words(text: str) -> list[str]:
    out, word = [], ""
    for ch in text.lower() + " ":
        if ch.isascii() and not ch.isalnum():
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    return out


def _sizes(text: str, num: int, den: int) -> tuple[list[str], int, int]:
    """Distinct tokens of a template, how many a block must hold, and how many words a block has."""
    tokens = list(dict.fromkeys(normal_words(text)))
    return tokens, -(-len(tokens) * num // den), -(-len(normal_words(text)) * den // num)


def _read(docs: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """Of every row: a number of its own, the phrases' results, and ``occ``: the places of template tokens in word order."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # as a generator: the normal form is computed once, not again in each expression that reads it
    worded = plain.select("doc_id", F.explode(F.array(normal(F.col("text")))).alias("norm"))
    worded = worded.select("doc_id", F.concat(F.lit(" "), "norm", F.lit(" ")).alias("padded"), F.split("norm", " ", -1).alias("words"))
    hits = [F.contains("padded", F.lit(f" {p} ")) for p, _ in PHRASES]
    n_base = sum((F.when(h, F.regexp_count("padded", F.lit(f" {p}(?= )"))).otherwise(0) for h, (p, _) in zip(hits, PHRASES, strict=True)), F.lit(0)).cast("long")
    base = F.array_compact(F.array(*(F.when(h, F.lit(label)) for h, (_, label) in zip(hits, PHRASES, strict=True))))
    places = F.transform("words", lambda w, i: F.when(w.isin(*vocabulary), F.struct(i.alias("i"), w.alias("t"))))
    return worded.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.when(F.col("padded") == "  ", F.lit(0)).otherwise(F.size("words")).cast("long").alias("n_words"),
        n_base.alias("n_base"),
        F.least(*(_place(p, False) for p, _ in PHRASES)).alias("first_word"),
        F.greatest(*(_place(p, True) for p, _ in PHRASES)).alias("last_word"),
        F.array_sort(base).alias("base"),
        F.filter(places, lambda x: x.isNotNull()).alias("occ"),
    )


def scanned(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, num: int = NUM, den: int = DEN) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row.

    Null texts count as empty ones.  Every row is judged by its own text,
    whether or not its doc_id is null or repeated.  Other columns are not
    read.  ``score`` is the largest verified containment, 0 where no block
    reaches the threshold.
    """
    spark = docs.sparkSession
    sets = [(label, *_sizes(text, num, den)) for label, text in templates]
    vocabulary = sorted({t for _, tokens, _, _ in sets for t in tokens})
    read = stored(_read(docs, vocabulary), "scan")
    counts = read.select(F.explode(F.array_distinct(F.transform("occ", lambda x: x["t"]))).alias("token")).groupBy("token").count().collect()  # a row for each template token
    seen = {r["token"]: r["count"] for r in counts}
    rank = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (seen.get(t, 0), t)))}
    prefix, full = [], []
    for number, (label, tokens, need, reach) in enumerate(sets):
        ordered = sorted(tokens, key=rank.get)
        full.append((number, label, ordered, need, reach))
        prefix += [(t, number, i, len(ordered), need) for i, t in enumerate(ordered[: len(ordered) - need + 1])]
    rare = sorted({t for t, *_ in prefix})
    p = F.broadcast(spark.createDataFrame(prefix, "token string, template int, pos int, size int, need int"))  # constants of the code
    t = F.broadcast(spark.createDataFrame(full, "template int, label string, tokens array<string>, need int, reach int"))

    places = read.where(F.exists("occ", lambda x: x["t"].isin(*rare))).select("row", "occ", F.posexplode("occ").alias("k", "at")).where(F.col("at.t").isin(*rare))
    near = places.select("row", F.col("at.t").alias("token"), F.col("at.i").alias("q"), "k", "occ").join(p, "token").join(t.drop("need"), "template")
    # template tokens within reach of the place: at most reach - 1 on either side
    around = F.expr("slice(occ, greatest(k - reach + 2, 1), 2 * reach - 1)")
    near = near.withColumn("region", F.filter(around, lambda x: (x["i"] > F.col("q") - F.col("reach")) & (x["i"] < F.col("q") + F.col("reach")) & F.array_contains("tokens", x["t"])))
    held = F.transform("region", lambda x: F.array_position("tokens", x["t"]) - 1)
    later = F.size(F.array_distinct(F.filter(held, lambda j: j >= F.col("pos"))))
    fits = near.where((F.size("region") >= F.col("need")) & (F.least(later, F.col("size") - F.col("pos")) >= F.col("need")))
    # blocks that hold the place may begin with a template token: no other block holds more
    most = F.expr("array_max(transform(filter(region, s -> s.i <= q), s -> size(array_distinct(transform(filter(region, x -> x.i >= s.i AND x.i < s.i + reach), x -> x.t)))))")
    found = fits.select("row", "label", "need", (most / F.col("size")).alias("share"), most.alias("most")).where("most >= need")
    best = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    out = read.drop("occ").join(best, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.coalesce("share", F.lit(0.0)).alias("score"))


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document scanned."""
    return scanned(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """DuckDB SQL for op9_licenses' rows: every template against the block after each of its tokens, without filters."""
    gap = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    sets = [(label, *_sizes(text, NUM, DEN)) for label, text in TEMPLATES]
    values = ", ".join(f"({number}, '{label}', {tokens!r}, {need}, {reach})" for number, (label, tokens, need, reach) in enumerate(sets))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    return f"""
WITH templates(template, label, tokens, need, reach) AS (VALUES {values}),
members AS (SELECT template, need, reach, unnest(tokens) AS token FROM templates),
phrases(phrase, label, k) AS (VALUES {phrases}),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{gap}') AS w FROM documents),
words AS (SELECT r, unnest(w) AS token, unnest(range(0, len(w))) AS i FROM d),
hits AS (SELECT r, template, need, reach, token, i FROM words JOIN members USING (token)),
blocks AS (SELECT a.r, a.template, a.need, a.i, count(DISTINCT b.token) AS n FROM hits a JOIN hits b ON a.r = b.r AND a.template = b.template AND b.i >= a.i AND b.i < a.i + a.reach GROUP BY 1, 2, 3, 4),
found AS (SELECT r, label, n / CAST(len(tokens) AS DOUBLE) AS share FROM blocks JOIN templates t USING (template) WHERE n >= t.need),
best AS (SELECT r, list(DISTINCT label) AS more, max(share) AS share FROM found GROUP BY 1),
starts AS (
  SELECT d.r, p.label, i FROM d JOIN phrases p ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || phrase || ' '), unnest(range(1, len(w) + 1)) AS u(i)
  WHERE array_to_string(w[i:i + k - 1], ' ') = phrase),
base AS (SELECT r, count(*) AS n_base, min(i) - 1 AS f, max(i) - 1 AS l, list(DISTINCT label) AS labels FROM starts GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more, [])))), ','), '') AS labels,
       coalesce(share, 0.0) AS score
FROM d LEFT JOIN base ON d.r = base.r LEFT JOIN best ON d.r = best.r
"""


OP9_SQL = _oracle()
