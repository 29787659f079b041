"""Helpers that the training-data operators share: tables, scratch tables, hashing."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on one machine (tests) a local one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_SCRATCH:
        _LOCAL_SCRATCH.append(Path(tempfile.mkdtemp(prefix="graphspark-")).as_uri())
    return _LOCAL_SCRATCH[0]


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage so that a lost executor costs a re-read, not a recomputation of all that came
    before, and lets several consumers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphspark-scratch/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the scratch table behind a frame that materialize() returned."""
    spark = df.sparkSession
    jvm = spark._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "graphspark-scratch" in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def spare(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32_of_id(id_col: str) -> Column:
    """CRC-32 of an id written as text, unsigned; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
