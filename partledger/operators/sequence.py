"""Operators over ordered rows: as-of, islands, neighbours, carried values, and the work queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(df: DataFrame, keys: Sequence[str], order: Sequence[str], is_mark: Column, value: Column, name: str) -> DataFrame:
    """The value of the last earlier row that is a mark."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(is_mark, value), ignorenulls=True).over(before))


def carried_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], is_heading: Column, value: Column, name: str) -> DataFrame:
    """The value of the last heading up to and with this row."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(is_heading, value), ignorenulls=True).over(upto))


def islands(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int, order: Sequence[str] = ()) -> DataFrame:
    """df with island: rows of a key whose time is more than gap_seconds after the previous row begin a new one."""
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    starts = F.when(F.col(ts) - F.lag(ts).over(w) <= F.make_dt_interval(secs=F.lit(gap_seconds)), 0).otherwise(1)
    return df.withColumn("_starts", starts).withColumn("island", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def phase_flags(df: DataFrame, keys: Sequence[str], order: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """A column for each flag: whether it has held in this or an earlier row."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: F.coalesce(F.max(c).over(upto), F.lit(False)) for n, c in flags.items()})


def neighbourhood(df: DataFrame, keys: Sequence[str], order: Sequence[str], radius: int, amount: Column, name: str) -> DataFrame:
    """The sum of an amount over the rows within radius places."""
    around = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-radius, radius)
    return df.withColumn(name, F.sum(amount).over(around))


def nearest_within(df: DataFrame, keys: Sequence[str], position: str, is_target: Column, value: str, reach: int, name: str) -> DataFrame:
    """For each row the value of the nearest target row within reach positions, the earlier one where two are equally near.

    Positions are met by exploding each target to the positions that it reaches: an equi-join, however long a document is.
    """
    targets = df.filter(is_target).select(*keys, F.col(position).alias("_at"), F.col(value).alias("_v"))
    reached = targets.withColumn(position, F.explode(F.sequence(F.col("_at") - reach, F.col("_at") + reach)))
    best = reached.groupBy(*keys, position).agg(F.min(F.struct(F.abs(F.col("_at") - F.col(position)).alias("d"), "_at", "_v")).alias("_b"))
    return df.join(best.select(*keys, position, F.col("_b._v").alias(name), F.col("_b.d").alias(f"{name}_distance")), [*keys, position], "left")


def claimable(queue: DataFrame, now: Column, lease_seconds: int, max_attempts: int) -> DataFrame:
    """Work items that may be claimed: ready or with a stale lease, under the attempt limit, and due."""
    stale = (F.col("status") == "processing") & (now - F.col("started_at") > F.make_dt_interval(secs=F.lit(lease_seconds)))
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)
    return queue.filter(((F.col("status") == "queued") & due | stale) & (F.col("attempts") < max_attempts))


def claim(queue: DataFrame, now: Column, lease_seconds: int, max_attempts: int, n: int) -> DataFrame:
    """The first n claimable items by due time, those without one first: a claim takes as many as it has workers."""
    rows = claimable(queue, now, lease_seconds, max_attempts)
    return rows.orderBy(F.asc_nulls_first("next_attempt_at"), "item_id").limit(n).withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1})


def after_failure(queue: DataFrame, now: Column, max_attempts: int, retry_seconds: int) -> DataFrame:
    """Processing items that failed: queued again after a wait, or failed for good at the attempt limit."""
    failed = queue.filter("status = 'processing'")
    final = F.col("attempts") >= max_attempts
    return failed.select("item_id", "attempts", F.when(final, "failed").otherwise("queued").alias("status"), F.when(~final, now + F.make_dt_interval(secs=F.lit(retry_seconds))).alias("next_attempt_at"))
