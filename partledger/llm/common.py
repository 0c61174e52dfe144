"""What the operators share: reading tables, working tables in the shared folder, text expressions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a side that was counted may be broadcast; each such side is a few fixed-width columns.
BROADCAST_ROWS = 200_000
#: Rows that go to Python at once where they have whole texts: in Spark's usual 10,000 they take much memory outside the heap, which stays taken.
ARROW_BATCH, TEXTS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. A local session without one gets a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder for working tables that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='partledger-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/partledger/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "table", arrow_rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once and outlives lost executors. arrow_rows bounds the rows that go to
    Python at once while it is."""
    spark = df.sparkSession
    path, before = new_path(spark, kind), spark.conf.get(ARROW_BATCH)
    if arrow_rows and not 0 < int(before) <= arrow_rows:
        spark.conf.set(ARROW_BATCH, arrow_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has no more than so many rows, else as it is (then a shuffled join follows)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def remove_working_tables(spark: SparkSession) -> None:
    """Deletes every working table that this package has written to the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/partledger")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two hashes with different seeds."""
    return [F.xxhash64(text), F.xxhash64(F.lit("partledger"), text)]


def same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Equality of the named columns in which nulls equal each other."""
    out = F.lit(True)
    for name in names:
        out = out & a[name].eqNullSafe(b[name])
    return out
