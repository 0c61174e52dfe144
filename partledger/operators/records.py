"""Picking, deduplicating and merging records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partledger.sources.shared import shared_path

def best_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a given order, which ends in a total order so that ties keep the first seen."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def best_values(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """best_rows where only the ordering values are kept: the largest of each key, by partial aggregation instead of a sort."""
    best = df.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{v}").alias(v) for v in values))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, numbered."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col(rank) <= n)


def mode_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the lexicographically largest."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max(F.struct("n", value)).alias("_m")).select(key, F.col(f"_m.{value}").alias(value), F.col("_m.n").alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: str, stamp: Column, values: Sequence[str], first_seen: str = "first_seen") -> DataFrame:
    """New values by key over old ones; first_seen survives, or is stamp for new keys; action tells what happened."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, key, "full")
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(f"o.{v}").eqNullSafe(F.col(f"n.{v}"))
    in_old, in_new = F.col("o.present").isNotNull(), F.col("n.present").isNotNull()
    action = F.when(~in_old, "new").when(~in_new, "kept").when(changed, "updated").otherwise("unchanged")
    return both.select(key, *(F.coalesce(f"n.{v}", f"o.{v}").alias(v) for v in values), F.coalesce(f"o.{first_seen}", stamp).alias(first_seen), action.alias("action"))


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The incoming rows whose key is not there yet."""
    return incoming.join(existing.select(key).distinct(), key, "left_anti")


def changed_rows(current: DataFrame, seen: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose key is new or whose digest differs from the one seen."""
    return current.join(seen.select(key, digest).distinct(), [key, digest], "left_anti")


def merge_identities(rows: DataFrame, mapping: DataFrame, key: str, target: str) -> DataFrame:
    """rows with their key replaced by the mapping's target where it has one."""
    return rows.join(mapping, key, "left").withColumn(key, F.coalesce(target, key)).drop(target)


def row_diff(left: DataFrame, right: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """(key, status): added, removed, changed or same, comparing the values as one tuple in which nulls are equal."""
    a = left.select(key, F.struct(*values).alias("_a"))
    b = right.select(key, F.struct(*values).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, when: Column | None = None) -> DataFrame:
    """Child rows (that meet a condition) whose key has no parent; null keys have none."""
    rows = child if when is None else child.filter(when)
    return rows.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], at: str, size: str | None = None) -> DataFrame:
    """df with the place of each row within its key, from 0, and the key's size: no key is sorted in one task.

    Rows are cut into ranges by key and order, and written so that the cut stays as it is; a row's place is its place in its
    range and the sizes of the ranges before. The order has to be total for places to be the same in every run.
    """
    path = shared_path(df.sparkSession, "ranges")
    spread = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    spread.write.parquet(path)
    rows = df.sparkSession.read.schema(spread.schema).parquet(path)
    counts = rows.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    of_key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each range and key.
    ends = counts.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k_{k}") for k in keys), before.alias("_before"), F.sum("_n").over(of_key).alias("_size"))
    place = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)) - 1
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    held = rows.withColumn("_place", place).join(ends, same).withColumn(at, (F.col("_before") + F.col("_place")).cast("long"))
    return held.withColumn(size or "_size", F.col("_size")).drop("_part", "_p", "_place", "_before", *(f"_k_{k}" for k in keys), *([] if size == "_size" else ["_size"]))


def even_sample(df: DataFrame, order: Sequence[Column], n: int, keys: Sequence[str]) -> DataFrame:
    """n rows of each key at even distances: those numbered round(i * (size - 1) / (n - 1)), or all if there are no more."""
    rows = numbered(df, keys, order, "_at", "_size")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_size") - 1) / (n - 1) + 0.5))
    return rows.filter((F.col("_size") <= n) | F.array_contains(wanted, F.col("_at"))).drop("_at", "_size")


def top_few(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key. Spark keeps the first n of every task before it deals keys out, so a hot key is no single sort."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")
