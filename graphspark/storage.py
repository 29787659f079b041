"""Tables written between the steps of an iterative plan."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame

_LOCAL: list[str] = []


def stored(df: DataFrame, label: str, *by: str) -> DataFrame:
    """df written to the folder that all executors share (spark.checkpoint.dir), in a directory per value of `by`, and read back, without its lineage."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(Path(tempfile.mkdtemp(prefix="graphspark-")).as_uri())
        base = _LOCAL[0]
    path = f"{base.rstrip('/')}/graphspark-steps/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
