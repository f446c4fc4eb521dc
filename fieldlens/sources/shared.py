"""The folder that all executors share, for written tables and cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below spark.checkpoint.dir.

    Where that is unset, a local session (a test) gets a folder of its own machine, and a cluster an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-fieldlens-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else as it is, and the join is a shuffled one."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
