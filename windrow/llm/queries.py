"""Registry of the text operators' queries and of the SQL that some are checked by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from windrow.llm import bpe, centroids, decontaminate, jaccard, licenses, linededup, neardup, prefixtrie, quality, revisits, secrets, toxicity, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_line_dedup": linededup.op2_line_dedup,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_secrets": secrets.op4_secrets,
        "op5_embeddings": neardup.op5_embeddings,
        "op6_revisits": revisits.op6_revisits,
        "op7_urls": urlfilter.op7_urls,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_licenses": licenses.op9_licenses,
        "op10_bpe": bpe.op10_bpe,
        "op11_prefix_trie": prefixtrie.op11_prefix_trie,
        "op12_centroids": centroids.op12_centroids,
        "op13_quality": quality.op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": linededup.OP2_SQL,
        "op6_revisits": revisits.OP6_SQL,
        "op9_licenses": licenses.OP9_SQL,
        "op11_prefix_trie": prefixtrie.OP11_SQL,
        "op12_centroids": centroids.OP12_SQL,
    }
