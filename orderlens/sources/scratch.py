"""Written intermediate tables in the folder all executors share.

A multi-pass job must not depend on cached blocks, so anything read more than once across
actions is written as Parquet under the session's checkpoint folder and read back.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for a local, unconfigured session."""
    context = spark.sparkContext
    configured = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="orderlens-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/orderlens/{app}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and return a reader over it, cutting the lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
