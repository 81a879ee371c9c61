"""The VCF line filter as a stream: stateless, so the batch operator runs unchanged."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from windrow.operators.vcf import filtered_lines


def filter_vcf_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, cutoffs: dict[str, float]) -> StreamingQuery:
    """Filter lines of text files that appear below ``source`` into ``sink``, once each, until there are no more."""
    lines = spark.readStream.text(source)
    return filtered_lines(lines, cutoffs).writeStream.format("text").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
