"""Tables that are computed once in the middle of a job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_folder(spark: SparkSession) -> str:
    """A new temporary folder, for sessions that run on this machine alone; any other must set ``spark.checkpoint.dir``."""
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="axleyard-")


def scratch(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; only where that is unset and Spark is local, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{local_folder(spark)}"
    return f"{base.rstrip('/')}/axleyard-{uuid.uuid4().hex}"


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read back: for rows by the million, which take a fraction of a checkpoint's bytes, and of which each reader takes only its columns (and of ``by`` only its values)."""
    path = scratch(df.sparkSession)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in ``spark.checkpoint.dir``; only where that is unset and Spark is local, in a temporary folder."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(local_folder(spark))
    return df.checkpoint()
