"""Coverage, manifests, rankings, trends and facets over analysis rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partledger.functions.text import ratio
from partledger.sources.shared import written


def known(c: str) -> Column:
    return F.col(c) != ""


def once_per_product(rows: DataFrame, keys: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """(keys, product_id, rows, a 0/1 column for each flag that holds in some row): conditional distinct counts become sums.

    One shuffle by (keys, product_id) takes the place of an expansion for each count_distinct.
    """
    return rows.groupBy(*keys, "product_id").agg(F.count("*").alias("rows"), *(F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in flags.items()))


def coverage(rows: DataFrame, key: str = "component_key") -> DataFrame:
    """Coverage of each component: rows, products, and rows and products with known manufacturer, model, parameters.

    One pass: each product's rows are summed, and of the sums those above 0 are its flags.
    """
    flags = {"manufacturer": known("manufacturer"), "model": (F.col("model_status") == "reported"), "parameter": F.col("parameters") > 1}
    per = rows.groupBy(key, "product_id").agg(F.count("*").alias("rows"), *(F.count_if(c).alias(n) for n, c in flags.items()), F.count_if(F.col("model_status") == "invalid_parameter_value").alias("invalid"))
    both = per.groupBy(key).agg(
        F.sum("rows").alias("rows"), F.count("*").alias("products"), *(F.sum(n).alias(f"{n}_rows") for n in flags),
        *(F.count_if(F.col(n) > 0).alias(f"{n}_products") for n in flags), F.sum("invalid").alias("invalid_model_rows"),
    )
    shares = {f"{n}_{of[:-1]}_ratio": ratio(F.col(f"{n}_{of}"), F.col(of)) for n in flags for of in ("rows", "products")}
    return both.withColumns(shares)


def distribution(rows: DataFrame, column: str, unknown: str = "unknown") -> DataFrame:
    label = F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit(unknown))
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label")


def manifest(rows: DataFrame, key: str, counted: dict[str, Column], flags: dict[str, Column] | None = None) -> DataFrame:
    """Rows, products, products with a flag, and distinct non-null values of the given expressions for each key.

    Products are counted from one row for each (key, product). The values counted beside them are of few kinds, so their
    combinations are taken first, by partial aggregation, and told apart afterwards.
    """
    flags = flags or {}
    per = once_per_product(rows, [key], flags)
    found = per.groupBy(key).agg(F.sum("rows").alias("rows"), F.count("*").alias("products"), *(F.sum(n).alias(n) for n in flags))
    if not counted:
        return found
    kinds = rows.select(key, *(c.alias(n) for n, c in counted.items())).distinct()
    return found.join(kinds.groupBy(key).agg(*(F.count_distinct(n).alias(n) for n in counted)), key)


def products_by_year(rows: DataFrame, entity: str) -> DataFrame:
    """(entity, year, products): distinct products, from one row for each of them."""
    per = rows.select(entity, F.year("published").alias("year"), "product_id").distinct()
    return per.groupBy(entity, "year").agg(F.count("*").alias("products"))


def yearly_ranks(rows: DataFrame, entity: str, top: int = 5) -> DataFrame:
    """The top entities of each year by distinct products, and how far each moved since the previous year observed.

    The counts, a row for each entity and year, are written once: they are read four times. Each of the top entities' ranks in the
    previous year is 1 and the entities ahead of it there. Those are counted by holding that year's counts against the few of the top, not by
    ranking the year as a whole.
    """
    counts = written(products_by_year(rows, entity), "yearly-counts")
    best = top_rows(counts, entity, top)
    years = counts.select("year").distinct().withColumn("previous", F.lag("year").over(Window.orderBy("year")))  # a row for each year
    asked = best.join(years, "year").select("year", "previous", entity, "products", "rank")
    then = counts.select(F.col("year").alias("previous"), F.col(entity), F.col("products").alias("then"))
    asked = asked.join(then, ["previous", entity], "left")
    # At most `top` rows of each year stand on the small side.
    others = counts.select(F.col("year").alias("of_year"), F.col(entity).alias("other"), F.col("products").alias("other_products"))
    before = (F.col("other_products") > F.col("then")) | ((F.col("other_products") == F.col("then")) & (F.col("other") < F.col(entity)))
    better = others.join(F.broadcast(asked.filter("then is not null")), (F.col("of_year") == F.col("previous")) & before)
    places = better.groupBy("year", entity).agg(F.count("*").alias("better"))
    held = asked.join(places, ["year", entity], "left")
    previous_rank = F.when(F.col("then").isNotNull(), F.coalesce("better", F.lit(0)) + 1)
    return held.select("year", entity, "products", "rank", (previous_rank - F.col("rank")).alias("movement"))


def top_rows(counts: DataFrame, entity: str, top: int) -> DataFrame:
    """The top entities of each year. Spark keeps the top of every task before it deals years out, so none is sorted whole."""
    rank = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("products"), F.col(entity)))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


def zero_filled_trend(rows: DataFrame, entity: str, top: int = 5) -> DataFrame:
    """Distinct products of the top entities in every year, 0 where there are none."""
    # One row for each entity, product and year, which both the totals and the counts follow from.
    per = rows.select(entity, "product_id", F.year("published").alias("year")).distinct()
    found = per.groupBy(entity, "product_id").agg(F.collect_set("year").alias("years"))  # a few years
    found = written(found.groupBy(entity, "years").agg(F.count("*").alias("n")), "products-by-years")
    counts = found.select(entity, F.explode("years").alias("year"), "n").groupBy(entity, "year").agg(F.sum("n").alias("products"))
    series = found.groupBy(entity).agg(F.sum("n").alias("all")).orderBy(F.desc("all"), entity).limit(top).select(entity)
    # At most `top` rows against the years that occur.
    grid = F.broadcast(series).crossJoin(counts.select("year").distinct())
    return grid.join(counts, [entity, "year"], "left").fillna(0, ["products"])


def self_excluding_facets(rows: DataFrame, chosen: dict[str, str], dimensions: Sequence[str]) -> DataFrame:
    """For each dimension, the distinct products of each value among rows that meet all other dimensions' choices.

    One pass: a row is unpivoted to the dimensions whose other choices it meets. Chosen values stay with 0.
    """
    meets = {d: F.col(d) == v for d, v in chosen.items()}
    others = lambda d: _all([c for k, c in meets.items() if k != d])
    entries = F.array(*(F.when(others(d), F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))) for d in dimensions))
    counts = rows.select("product_id", F.explode(F.array_compact(entries)).alias("e")).groupBy("e.dimension", "e.value").agg(F.count_distinct("product_id").alias("products"))
    kept = rows.sparkSession.createDataFrame([(d, v) for d, v in chosen.items() if d in dimensions], "dimension string, value string")
    return counts.join(F.broadcast(kept), ["dimension", "value"], "full").fillna(0, ["products"])


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def first_years(rows: DataFrame, entity: str) -> DataFrame:
    """First and last year of each entity, and whether it entered in the last year of all."""
    years = rows.groupBy(entity).agg(F.min(F.year("published")).alias("first_year"), F.max(F.year("published")).alias("last_year"))
    last = years.agg(F.max("last_year").alias("latest"))
    return years.crossJoin(F.broadcast(last)).select(entity, "first_year", "last_year", (F.col("first_year") == F.col("latest")).alias("entrant"))
