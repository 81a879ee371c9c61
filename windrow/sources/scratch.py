"""Paths in the folder that driver and executors share, for tables that only the session needs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the folder that driver and executors share; a private one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="windrow-"))
    uri = f"{base.rstrip('/')}/windrow-io/{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return uri


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a scratch path and read from there: lineage ends here, and a lost executor costs no recomputation."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
