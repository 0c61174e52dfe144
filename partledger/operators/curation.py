"""Reconciliation, precedence, review and guard operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partledger.operators.records import numbered, top_few


def reconciliation_plan(sources: DataFrame, identity: str, target: str) -> DataFrame:
    """What becomes of each old identity: move if its sources agree on one target, conflict if on several, retire if they
    have none, preserve if it has no sources."""
    targets = F.array_compact(F.sort_array(F.collect_set(target)))
    known = F.count("source_id")
    action = F.when(F.size("targets") == 1, "move").when(F.size("targets") > 1, "conflict").when(F.col("sources") > 0, "retire").otherwise("preserve")
    return sources.groupBy(identity).agg(targets.alias("targets"), known.alias("sources")).withColumn("action", action)


def by_precedence(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int, group: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the first in order; then at most cap rows of each group."""
    first = df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1")
    return first.withColumn("_g", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_g") <= cap).drop("_k", "_g")


def stratified_sample(df: DataFrame, strata: Sequence[str], difficult: Column, order: Sequence[Column], quota: int) -> DataFrame:
    """quota rows of each stratum: difficult ones first, in order, then the rest."""
    return top_few(df, strata, [F.when(difficult, 0).otherwise(1), *order], quota)


def pages(df: DataFrame, order: Sequence[Column], size: int, keys: Sequence[str]) -> DataFrame:
    """df with page and place: rows of each key in order, size to a page, from 0."""
    rows = numbered(df, keys, order, "_at")
    return rows.withColumns({"page": F.floor(F.col("_at") / size).cast("long"), "place": F.col("_at") % size}).drop("_at")


def drop_guard(old: DataFrame, new: DataFrame, key: str, count: str, most_percent: int) -> DataFrame:
    """Keys whose count has fallen by more than so many percent, keys that are gone included."""
    both = old.select(key, F.col(count).alias("before")).join(new.select(key, F.col(count).alias("after")), key, "left").fillna(0, ["after"])
    return both.withColumn("blocked", 100 * (F.col("before") - F.col("after")) > most_percent * F.col("before"))


def boundary_scan(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, found): how many rows break each rule, in one pass."""
    totals = df.agg(*(F.count_if(c).alias(n) for n, c in rules.items()))
    return totals.select(F.explode(F.create_map(*(x for n in rules for x in (F.lit(n), F.col(n))))).alias("rule", "found"))


def lexicon_mentions(docs: DataFrame, text: str, lexicon: Sequence[str]) -> DataFrame:
    """(word, documents, mentions) for each word of a fixed lexicon that occurs."""
    low = F.lower(text)
    counts = F.array(*(F.struct(F.lit(w).alias("word"), F.when(F.contains(low, F.lit(w)), F.size(F.split(low, w)) - 1).otherwise(0).alias("n")) for w in lexicon))
    return docs.select(F.explode(F.filter(counts, lambda c: c["n"] > 0)).alias("c")).groupBy("c.word").agg(F.count("*").alias("documents"), F.sum("c.n").alias("mentions"))


def first_and_best(df: DataFrame, keys: Sequence[str], position: str, score: str, first: int, best: int) -> DataFrame:
    """The first rows of each key by position and, of the rest, those with the highest scores, in order of position."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_p", F.row_number().over(w.orderBy(position)))
    rows = rows.withColumn("_s", F.row_number().over(w.orderBy(F.when(F.col("_p") <= first, 1).otherwise(0), F.desc(score), position)))
    return rows.filter((F.col("_p") <= first) | (F.col("_s") <= best)).drop("_p", "_s")


def highlights(df: DataFrame, keys: Sequence[str], priority: Column, order: Sequence[Column], most: int) -> DataFrame:
    """Up to most rows of each key, priority rows first, with how many remain."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_n": F.row_number().over(w.orderBy(F.when(priority, 0).otherwise(1), *order)), "_size": F.count("*").over(w)})
    return rows.filter(F.col("_n") <= most).withColumn("remaining", F.greatest(F.col("_size") - most, F.lit(0))).drop("_n", "_size")


