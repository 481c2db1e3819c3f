"""Cutting lineage with tables written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session names it; where none is set, a temporary folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local(spark.sparkContext.applicationId)


@lru_cache(maxsize=4)
def _local(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='lossbook-')}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back; survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
