"""Where streams keep what they write on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset, a temporary one in local mode;
    on a cluster there is no folder to fall back on, so it fails."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="foliant-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in such a folder, read back, where plans that use it often would each carry all of its own."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
