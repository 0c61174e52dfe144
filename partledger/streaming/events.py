"""Structured Streaming over event files: windows, sessions, first occurrences. State with timers is in timed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partledger.sources.shared import shared_path


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
TIMER_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The Parquet files of a folder, or one file of a folder, as a stream with their own schema; times are instants."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    rows = reader.parquet(path)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run_available(stream: DataFrame, kind: str, mode: str = "append", timers: bool = False) -> DataFrame:
    """Runs a stream over all that is there into a table in the shared folder, exactly once, and returns that table.

    timers says that its state has timers, which one of Spark's state stores keeps.
    """
    spark = stream.sparkSession
    out, state = shared_path(spark, kind), shared_path(spark, f"{kind}-state")
    before = spark.conf.get(STATE_STORE, None)
    if timers:
        spark.conf.set(STATE_STORE, TIMER_STORE)
    try:
        running = stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start(out)
    finally:
        if timers and before is None:
            spark.conf.unset(STATE_STORE)
        elif timers:
            spark.conf.set(STATE_STORE, before)
    running.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(out)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in stream.schema if f.dataType.typeName() == "timestamp"})


def tumbling(stream: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts in windows, given out once the watermark has passed a window's end."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), *keys, "n")


def sessions(stream: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def first_occurrences(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once. State is all keys ever seen; first_within forgets them."""
    return stream.select(*keys).dropDuplicates(keys)


def first_within(stream: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """Rows whose keys have not come within some time before: a key is forgotten when the watermark has passed it by so much."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)
