"""The shared folder for written tables: what the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from strandix.errors import EngineError


def scratch(spark: SparkSession) -> str:
    """A folder that all executors see. Where the session names none, a local master gets one of our own; a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise EngineError("CFG001", "spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strandix-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/strandix"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that what it took is done once."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
