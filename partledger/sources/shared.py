"""Folders that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side that was counted may be broadcast.
BROADCAST_ROWS = 200_000


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in spark.checkpoint.dir. In a local session without one, as in tests, a new folder is set first."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder for working tables that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='partledger-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/partledger/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once and outlives lost executors."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a shuffled join that is not broadcast. The optimizer takes a file's size for that of its rows, and rows that
    repeat are a hundred times larger in the driver's memory than in a file."""
    return df.hint("merge")


def small_or_merged(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has no more than so many rows, else for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else merged(df)
