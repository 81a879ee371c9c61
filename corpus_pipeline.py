"""Corpus pipeline: toxicity, line dedup, n-gram Jaccard join, decontamination, BPE.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each stage's result as Parquet to the shared folder and reads it back
as the next stage's documents.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm import bpe, decontaminate, jaccard, linededup, toxicity
from windrow.llm.shared import drop_stored, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below 0.5 for toxicity.

    Null and empty texts get the score of a text without any feature; a row
    without a doc_id is judged by its text; rows that share a doc_id go
    together.  Columns of any name come through.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks and lines of more than 50 words that an earlier document (or place) holds; one that had nothing else goes.

    Null and empty texts stay as they are; rows that share doc_id and text
    count as one document and stay alike.  Columns of any name come through.
    """
    return linededup.cleaned(docs, drop_emptied=True)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8) the document with the smallest doc_id; all without words stay.

    Null and empty texts are without words; rows that share a doc_id go or
    stay together; of rows without a doc_id that have one text one stays.
    """
    return jaccard.one_of_each(docs, k=5, num=4, den=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item.

    Null and empty texts overlap with nothing; a row without a doc_id is
    judged by its text; rows that share a doc_id go together.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, digests of ids and decoded text.

    Null texts count as empty ones, with no tokens; repeated rows and null
    doc_ids are kept.
    """
    return bpe.digests(docs, bpe.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_near),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: Learnt weights and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_stored(before)
        docs = before = after
    return docs
