"""Snapshots of products that merge the fields of their best source with what else is known of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Selling points, claims and scenarios that a snapshot shows at most, and a scenario that says nothing.
POINTS, CLAIMS, SCENARIOS, NO_SCENARIO = 8, 7, 4, "游戏"
POSITIONING = ("消费者卖点主要集中在", "、", "。")
MODULES = ("packaging", "charging_case", "earbuds")
CLAIM = "array<struct<text: string, category: string, scenario: string>>"


def distinct_filled(values: Column) -> Column:
    """The distinct values of an array that are not blank, trimmed, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != ""))


def best_source(sources: DataFrame, product: str, score: str, source: str) -> DataFrame:
    """The source of each product: its best report, however sparse; only without one its best video, if that scores. Ties go to the
    smallest source. The choice is an aggregation over the row as one value, so each row is read once."""
    usable = sources.filter((F.col("kind") == "report") | (F.col(score) > 0))
    rest = [c for c in sources.columns if c not in (product, "kind", score, source)]
    first = F.struct(F.when(F.col("kind") == "report", 0).otherwise(1).alias("_k"), (-F.col(score)).alias("_s"), F.col(source), "kind", F.col(score), *rest)
    return usable.groupBy(product).agg(F.min(first).alias("b")).select(product, "b.*").drop("_k", "_s")


def market_snapshots(sources: DataFrame, reviewed: DataFrame, derived: DataFrame, product: str) -> DataFrame:
    """One row for each product with something to say: claims, selling points, scenarios, positioning and dates of its best source.

    sources has (product, kind, source, score, selling_points, scenarios, positioning, launch_date); reviewed and derived have
    (product, source, claims). Reviewed claims count if they are of the chosen report; else the report's derived ones do. A video's claims
    are its selling points. Claims take the place of selling points, and their scenarios and categories that of the source's
    scenarios and positioning. Blank and general scenarios go.
    """
    chosen = best_source(sources, product, "score", "source")
    of = lambda df, name: df.select(product, "source", F.slice("claims", 1, CLAIMS).alias(name), F.lit("report").alias("kind"))
    held = chosen.join(of(reviewed, "_reviewed"), [product, "source", "kind"], "left").join(of(derived, "_derived"), [product, "source", "kind"], "left")
    points = F.slice(distinct_filled(F.col("selling_points")), 1, POINTS)
    none = F.array().cast(CLAIM)
    from_points = F.transform(points, lambda t: F.struct(t.alias("text"), F.lit("").alias("category"), F.lit("").alias("scenario")))
    claims = F.coalesce(F.when(F.col("kind") == "video", from_points), F.when(F.size("_reviewed") > 0, F.col("_reviewed")), F.col("_derived"), none).cast(CLAIM)
    held = held.withColumn("claims", claims)
    any_claim = F.size("claims") > 0
    texts = F.when(any_claim, F.transform("claims", lambda c: c["text"])).otherwise(points)
    scenarios = F.slice(F.filter(distinct_filled(F.when(any_claim, F.transform("claims", lambda c: c["scenario"])).otherwise(F.col("scenarios"))), lambda s: s != NO_SCENARIO), 1, SCENARIOS)
    categories = distinct_filled(F.transform("claims", lambda c: c["category"]))
    said = F.when(F.size(categories) > 0, F.concat(F.lit(POSITIONING[0]), F.array_join(categories, POSITIONING[1]), F.lit(POSITIONING[2]))).otherwise("")
    method = F.when(~any_claim, "none").when(F.col("kind") == "video", "video").when(F.size("_reviewed") > 0, "reviewed").otherwise("derived")
    out = held.select(product, "kind", "source", method.alias("method"), F.size("claims").alias("n_claims"), texts.alias("selling_points"), scenarios.alias("scenarios"), F.when(any_claim, said).otherwise(F.coalesce("positioning", F.lit(""))).alias("positioning"), "launch_date")
    return out.filter((F.size("selling_points") > 0) | (F.size("scenarios") > 0) | (F.col("positioning") != ""))


def unboxing_snapshots(sources: DataFrame, summaries: DataFrame, product: str, modules: Sequence[str] = MODULES) -> DataFrame:
    """One row for each product: the fields of its fullest unboxing's modules with the summary's bullets of that report.

    sources has (product, source, gaps, and for each module a struct of description, accessories and images); summaries has (source, module,
    bullets). The fullest has most images and accessories in its packaging. completeness is the share of modules with images.
    """
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    score = size("packaging.images") + size("packaging.accessories")
    rest = [c for c in sources.columns if c not in (product, "source")]
    best = sources.withColumn("_score", score).groupBy(product).agg(F.min(F.struct((-F.col("_score")).alias("s"), "source", *rest)).alias("b")).select(product, "b.*").drop("s")
    wide = summaries.groupBy("source").agg(*(F.max(F.when(F.col("module") == m, F.col("bullets"))).alias(f"_{m}") for m in modules))
    held = best.join(wide, "source", "left")
    none = F.array().cast("array<string>")
    merged = [F.struct(F.coalesce(f"{m}.description", F.lit("")).alias("description"), F.coalesce(f"{m}.accessories", none).alias("accessories"), F.coalesce(f"{m}.images", none).alias("images"), F.coalesce(f"_{m}", none).alias("bullets")).alias(m) for m in modules]
    filled = sum((F.when(size(f"{m}.images") > 0, 1).otherwise(0) for m in modules), F.lit(0))
    return held.select(product, "source", *merged, F.coalesce("gaps", none).alias("gaps"), F.bround(filled / len(modules), 2).alias("completeness"))
