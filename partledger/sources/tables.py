"""Reading the tables that queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partledger.functions.text import first_rule
from partledger.sources.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table of short rows that one task takes where each row costs much work.
DEALT_ROWS = 8192


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table dealt out by its key, so that each row's text can cost a task milliseconds.

    A part's row is a few bytes in a file, so a million of them are one split or two, and whatever is rendered and extracted from
    them would run in as many tasks. Their number follows from the rows (a count that a Parquet file's footer answers). The dealt
    rows are written, since the optimizer would put filters over what is extracted, and so the extraction, before the shuffle. Tables
    whose rows are longer have splits enough and stay as they are, as do small ones.
    """
    rows = table(spark, sf_dir, name)
    if name != "part" or (n := -(-rows.count() // DEALT_ROWS)) <= 1:
        return rows
    return written(rows.repartition(n, rows.columns[0]), "dealt")


#: Line items that one task takes where they are grouped to analysis rows.
LINES_A_TASK, FEW_TASKS = 200_000, 8


def supply_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis rows: line items as evidence that a product (customer) has a component (part) from a manufacturer.

    One row for each product, component, location, manufacturer, model and status: that with the most parameters, then the latest
    date. Both are packed into one whole number, so the pick is a hash aggregation, not a sort. Nearly every line is a row of its own, so
    partial results before the shuffle would only hold a whole split's lines; many lines are dealt by product and component to as many
    tasks as their number asks for (a count that a Parquet file's footer answers), which holds a task's memory whatever the session's
    partitions are. What a product implies (segment, nation) comes with its orders, so that grouped rows are not dealt again for it. Which
    dimension is broadcast is left to the optimizer and its size estimates.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    orders = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    status = first_rule([(F.col("p_size") % 7 == 0, "not_disclosed"), (F.col("p_size") % 11 == 0, "invalid_parameter_value")], "reported")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("component_key"), status.alias("model_status"), F.when(status == "not_disclosed", "").otherwise(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("model"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("s_name")).alias("manufacturer"))
    joined = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey).join(orders, line.l_orderkey == orders.o_orderkey)
    tasks = -(-line.count() // LINES_A_TASK)
    if tasks > FEW_TASKS:
        joined = joined.repartition(tasks, "o_custkey", "component_key")
    packed = F.col("l_linenumber").cast("long") * 100_000 + F.date_diff(F.to_date("l_shipdate"), F.lit("1900-01-01").cast("date"))
    keys = [F.col("o_custkey").alias("product_id"), "c_mktsegment", "c_nationkey", "component_key", F.col("l_returnflag").alias("usage_location"), "manufacturer", "model", "model_status"]
    best = joined.groupBy(*keys).agg(F.max(packed).alias("best"))
    return best.join(F.broadcast(nations(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "product_id", brand("product_id").alias("product_brand"), F.col("n_name").alias("product_category"), F.col("r_name").alias("product_region"), "component_key", "usage_location", "manufacturer", "model", "model_status",
        F.floor(F.col("best") / 100_000).alias("parameters"), F.date_add(F.lit("1900-01-01").cast("date"), (F.col("best") % 100_000).cast("int")).alias("published"),
    )


def brand(key: str) -> Column:
    """A product's brand: its customer's segment, blank for each tenth."""
    return F.when(F.col(key) % 10 == 0, "").otherwise(F.col("c_mktsegment"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations with their regions, a few rows whatever the size."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, product_brand, product_category, product_region) of the customers."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    held = customer.join(nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    return held.select(F.col("c_custkey").alias("product_id"), brand("c_custkey").alias("product_brand"), F.col("n_name").alias("product_category"), F.col("r_name").alias("product_region"))


def supplied_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products that any analysis row has, without building the rows: those with an order with a line whose part and supplier exist."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    part, supplier, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "orders")
    line = line.join(part, line.l_partkey == part.p_partkey, "left_semi").join(supplier, line.l_suppkey == supplier.s_suppkey, "left_semi")
    ordered = orders.join(line, orders.o_orderkey == line.l_orderkey, "left_semi").select(F.col("o_custkey").alias("product_id"))
    return products(spark, sf_dir).join(ordered, "product_id", "left_semi")


#: The same rows in SQL.
FACTS_SQL = """
facts AS (
  SELECT o_custkey AS product_id, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment END AS product_brand, n_name AS product_category, r_name AS product_region,
    p_type AS component_key, l_returnflag AS usage_location, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS manufacturer,
    CASE WHEN p_size % 7 = 0 THEN '' ELSE split_part(p_name, ' ', 2) END AS model,
    CASE WHEN p_size % 7 = 0 THEN 'not_disclosed' WHEN p_size % 11 = 0 THEN 'invalid_parameter_value' ELSE 'reported' END AS model_status,
    l_linenumber::BIGINT AS parameters, l_shipdate::DATE AS published, l_orderkey AS order_key, round(l_extendedprice * 100)::BIGINT AS price_cents
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), rows AS (
  SELECT product_id, product_brand, product_category, product_region, component_key, usage_location, manufacturer, model, model_status,
    max(parameters * 100000 + (published - DATE '1900-01-01')) // 100000 AS parameters, DATE '1900-01-01' + (max(parameters * 100000 + (published - DATE '1900-01-01')) % 100000)::INT AS published
  FROM facts GROUP BY ALL
)
"""
