"""What the operators share: reading tables, and tables written between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where none is set (tests, one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: later steps neither
    recompute them nor depend on an executor that may be lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def frequent(counts: DataFrame, n: str, size: int) -> DataFrame:
    """The rows of `counts` with the largest `n`, `size` at most.

    They are cut at a level of `n`, of which there are few, so no partition has to send its
    own largest rows to the driver. Rows of equal `n` stay together.
    """
    level = F.floor(F.log2(n) * 16)
    left, least = size, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        if r["count"] > left:
            break
        left, least = left - r["count"], r["level"]
    return counts.where(level >= least) if least is not None else counts.where(F.lit(False))
