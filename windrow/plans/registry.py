"""Registry of the interval and copy-number queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from windrow.plans import queries_calls, queries_extra, queries_genotype, queries_io, queries_models, queries_more, queries_search, queries_tracks

MODULES = (queries_tracks, queries_calls, queries_genotype, queries_models, queries_more, queries_extra, queries_io, queries_search)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter and cluster interval calls, resolve each cluster, and give the resolved calls' statistics."""
    return queries_models.refine_calls(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
