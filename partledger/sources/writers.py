"""Sinks: files by key, evidence in CSV, stamped JSON, publishing by rename, appends of new records."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """A folder for each key; only the keys that df has are replaced. Rows are dealt by key, a hot key over several files by AQE."""
    df.hint("rebalance", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_evidence_csv(df: DataFrame, path: str, lists: list[str]) -> None:
    """Quoted CSV with lists joined by semicolons."""
    flat = df.withColumns({c: F.concat_ws(";", c) for c in lists})
    flat.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_marked_csv(df: DataFrame, path: str, lists: list[str]) -> None:
    """Evidence for spreadsheets: write_evidence_csv with a byte-order mark before the header of each file, so that programs read UTF-8."""
    flat = df.withColumns({c: F.concat_ws(";", c) for c in lists})
    lines = flat.select(F.to_csv(F.struct(*flat.columns), {"quoteAll": "true", "escape": '"', "nullValue": ""}).alias("value"))
    header = "\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in flat.columns)

    def headed(batches):
        yield pd.DataFrame({"value": [header]})
        yield from batches

    lines.mapInPandas(headed, "value string").write.mode("overwrite").text(path)


def write_stamped_json(df: DataFrame, path: str, stamp: dict[str, str]) -> None:
    """JSON lines in which every record has the release stamp."""
    df.withColumns({k: F.lit(v) for k, v in stamp.items()}).write.mode("overwrite").json(path)


def publish(df: DataFrame, path: str) -> None:
    """Replaces what is at path at once: the new table is built aside and renamed; if that fails the old one is put back."""
    spark = df.sparkSession
    aside, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = as_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(as_path(path))
    if had and not fs.rename(as_path(path), as_path(old)):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(as_path(aside), as_path(path)):
        if had:
            fs.rename(as_path(old), as_path(path))
        raise OSError(f"{aside} can't be published")
    if had:
        fs.delete(as_path(old), True)


def append_records(df: DataFrame, path: str, key: str) -> None:
    """Appends the records whose key is not at path yet; existing ones are never changed."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df.dropDuplicates([key]).write.mode("append").parquet(path)
