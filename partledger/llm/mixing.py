"""Operator 5: mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partledger.llm.common import n_words, small, table, written

#: Weights that the sources take in turn, and the most that a source may be repeated.
WEIGHTS, MAX_EPOCHS = (5, 2, 1), 3
#: Ranges into which each source's sampling keys are cut; only the range in which the budget ends is sorted.
RANGES = 1024


def typical_word_weight(text: Column) -> Column:
    """A quality weight in (0, 1] from the text: 1 where words average six characters, less the farther from it."""
    words = n_words(text)
    per_word = F.when(words > 0, F.length(text) / words).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + F.abs(per_word - 6.0) / 6.0)


def uniform(seed: str, *columns: Column) -> Column:
    """A number in (0, 1) that depends on seed and columns only: 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("null")) for c in columns))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): the sum of all sizes is shared by weight.

    Sources take the weights in turn by code point, null last. A target stops at max_epochs times its
    source's size; by rising cap per weight, a source stops if its share of what is left would exceed its cap.
    The table has one row for each source, so its windows are small however many documents there are.
    """
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (at + 1).cast("int")).cast("long")
    rated = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rated = rated.select(
        "source", "source_size", "weight", "cap",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    ).withColumn("stops", F.col("cap") * F.col("weight_left") <= F.col("left") * F.col("weight"))
    open_left = F.max(F.when(~F.col("stops"), F.col("left"))).over(everything)
    open_weight = F.max(F.when(~F.col("stops"), F.col("weight_left"))).over(everything)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("weight") * open_left.cast("double") / open_weight)
    return rated.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, size: Column, quality: Column, *, source: str = "source", doc_id: str = "doc_id", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """How many words of each document the mix takes: (doc_id, source, size, source_size, target, epochs, taken).

    A source whose target is at least its size takes complete epochs of all its documents first; the rest of its
    budget goes to documents in the order of their exponential keys -ln(u) / quality, the last one in part.
    u depends on the seed and doc_id only, so reruns agree. Documents with size 0, a null text or a null id are
    mixed like others (they take 0 words if they have none); equal rows count each by itself; null sources form one
    source; very long texts are words like others, and the last one taken is taken in part; an empty table gives an empty result.
    Other columns of docs are not read, whatever their names.

    No source is sorted as a whole: its keys are cut into RANGES ranges, the sums of the ranges show where the
    budget ends, and only that range is sorted.
    """
    key = -F.log(uniform(seed, F.col(doc_id))) / F.greatest(quality, F.lit(1e-6))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.cast("long").alias("size"), key.alias("key"))
    rows = written(rows.withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key"))) * RANGES), F.lit(RANGES - 1))), "mix-keys")
    ranges = written(rows.groupBy("source", "range").agg(F.sum("size").alias("in_range")), "mix-ranges")

    targets = source_targets(ranges.groupBy("source").agg(F.sum("in_range").alias("source_size")), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    rising = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranges.withColumn("before", F.coalesce(F.sum("in_range").over(rising), F.lit(0)))
    last = ends.join(targets.select(F.col("source").alias("of"), "rest"), F.col("source").eqNullSafe(F.col("of")))
    last = last.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("in_range")))
    last = last.select(F.col("source").alias("of"), F.col("range").alias("last_range"), "before")
    budgets = written(targets.join(last, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "mix-budgets")

    mixed = rows.join(small(budgets.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # No last range: the rest is the whole source (all of it is taken) or the source is empty.
    in_last = F.coalesce(F.col("range") == F.col("last_range"), F.lit(False))
    whole = mixed.filter(~in_last).withColumn("extra", F.when(F.coalesce(F.col("range") < F.col("last_range"), F.col("rest") > 0), F.col("size")).otherwise(F.lit(0)))
    by_key = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = mixed.filter(in_last).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(by_key), F.lit(0)))
    cut = cut.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))).drop("ahead")
    taken = (F.col("epochs") * F.col("size") + F.col("extra")).cast("long")
    return whole.unionByName(cut).select("doc_id", "source", "size", "source_size", "target", "epochs", taken.alias("taken"))


def op5_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mixed = mix_sources(docs, n_words(F.col("text")), F.coalesce(typical_word_weight(F.col("text")), F.lit(0.5)))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, text FROM documents
), k AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
      / greatest(coalesce(1.0 / (1.0 + abs(CASE WHEN size > 0 THEN length(text)::DOUBLE / size ELSE 0 END - 6.0) / 6.0), 0.5), 1e-6) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM d GROUP BY source
), c AS (
  SELECT *, source_size * 3 AS cap,
    sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER r, 0) AS rest_all,
    sum(weight) OVER () - coalesce(sum(weight) OVER r, 0) AS rest_weight
  FROM s WINDOW r AS (ORDER BY source_size * 3 / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, cap * rest_weight <= rest_all * weight AS stops FROM c
), o AS (
  SELECT max(rest_all) FILTER (NOT stops) AS open_all, max(rest_weight) FILTER (NOT stops) AS open_weight FROM f
), t AS (
  SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE weight * open_all::DOUBLE / open_weight END AS target FROM f, o
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t
), p AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size)::BIGINT AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM p
"""
