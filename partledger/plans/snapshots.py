"""Queries over snapshots of products: customers stand for products, their orders for reports and videos."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partledger.operators import snapshots as S
from partledger.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str, *names: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))
        ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return keep


def listed(n: Column, name: str) -> Column:
    """name0, name1, ... as many as n."""
    n = n.cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit(name), i.cast("string")))).otherwise(F.array().cast("array<string>"))


@query("""
WITH s AS (SELECT o_custkey AS product, o_orderkey AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'report' ELSE 'video' END AS kind, o_orderkey % 5 - 1 AS score, o_orderkey % 11 AS points, o_orderkey % 7 AS scenes FROM orders WHERE o_custkey % 4 <> 1 OR o_orderkey % 3 <> 0),
b AS (SELECT * FROM s WHERE kind = 'report' OR score > 0 QUALIFY row_number() OVER (PARTITION BY product ORDER BY kind, -score, source) = 1),
c AS (SELECT *, CASE WHEN kind = 'video' THEN 'video' WHEN source % 6 = 0 AND source % 9 > 0 THEN 'reviewed' WHEN source % 4 > 0 THEN 'derived' ELSE 'none' END AS how FROM b),
d AS (SELECT *, CASE how WHEN 'video' THEN least(points, 8) WHEN 'reviewed' THEN least(source % 9, 7) WHEN 'derived' THEN source % 4 ELSE 0 END AS n FROM c),
e AS (SELECT product, kind, source, CASE WHEN n > 0 THEN how ELSE 'none' END AS method, n::INT AS n_claims,
  CASE WHEN n > 0 AND how <> 'video' THEN list_transform(range(n), lambda i: CASE how WHEN 'reviewed' THEN 'r' ELSE 'd' END || i) ELSE list_transform(range(least(points, 8)), lambda i: 'p' || i) END AS points,
  CASE WHEN n > 0 AND how = 'video' THEN [] WHEN n > 0 THEN list_transform(range(least(n, CASE how WHEN 'reviewed' THEN 3 ELSE 2 END)), lambda i: 's' || i) ELSE list_transform(range(least(scenes, 4)), lambda i: 'q' || i) END AS scenarios,
  CASE WHEN n > 0 AND how = 'video' THEN '' WHEN n > 0 THEN '消费者卖点主要集中在' || array_to_string(list_transform(range(least(n, 2)), lambda i: 'c' || i), '、') || '。' WHEN source % 2 = 0 THEN 'own' ELSE '' END AS positioning FROM d)
SELECT product, kind, source, method, n_claims, array_to_string(points, ',') AS selling_points, array_to_string(scenarios, ',') AS scenarios, positioning FROM e WHERE len(points) > 0 OR len(scenarios) > 0 OR positioning <> ''
""", "orders")
def market_snapshots(orders):
    """Fields of each product's best source, reviewed claims before derived ones, a video's only where there is no report."""
    key = F.col("o_orderkey")
    base = orders.filter("o_custkey % 4 <> 1 or o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("product"), key.alias("source"), F.when(key % 3 == 0, "report").otherwise("video").alias("kind"))
    n = F.col("source")
    sources = base.select("product", "kind", "source", (n % 5 - 1).alias("score"), F.concat(F.array(F.lit(" ")), listed(n % 11, "p")).alias("selling_points"), F.concat(F.array(F.lit("游戏")), listed(n % 7, "q")).alias("scenarios"), F.when(n % 2 == 0, "own").alias("positioning"), F.lit(None).cast("date").alias("launch_date"))
    claims = lambda size, name, scenes: F.transform(listed(size, ""), lambda i: F.struct(F.concat(F.lit(name), i).alias("text"), F.concat(F.lit("c"), (i.cast("int") % 2).cast("string")).alias("category"), F.concat(F.lit("s"), (i.cast("int") % scenes).cast("string")).alias("scenario")))
    reviewed = base.filter("source % 6 = 0").select("product", "source", claims(n % 9, "r", 3).alias("claims"))
    derived = base.filter("kind = 'report'").select("product", "source", claims(n % 4, "d", 2).alias("claims"))
    found = S.market_snapshots(sources, reviewed, derived, "product")
    return found.withColumns({c: F.array_join(c, ",") for c in ("selling_points", "scenarios")}).drop("launch_date")


@query("""
WITH b AS (SELECT o_custkey AS product, o_orderkey AS source, o_orderkey % 4 AS i, o_orderkey % 3 AS a FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY -(o_orderkey % 4 + o_orderkey % 3), o_orderkey) = 1)
SELECT product, source, 'about ' || source AS packaging, a + i AS filled, CASE WHEN source % 5 = 0 THEN 'b0,b1' ELSE '' END AS bullets, round_even(((i > 0)::INT + (source % 2 = 0)::INT + (source % 7 = 0)::INT) / 3.0, 2)::DOUBLE AS completeness, CASE WHEN source % 2 = 1 THEN 'charging_case' ELSE '' END AS gaps FROM b
""", "orders")
def unboxing_fields(orders):
    """Fields of each product's fullest unboxing with the bullets of its summary."""
    n = F.col("o_orderkey")
    module = lambda about, extras, images: F.struct(about.alias("description"), extras.alias("accessories"), images.alias("images"))
    none = F.array().cast("array<string>")
    pictures = lambda when: F.when(when, F.array(F.lit("x"))).otherwise(none)
    sources = orders.select(
        F.col("o_custkey").alias("product"), n.alias("source"), F.when(n % 2 == 1, F.array(F.lit("charging_case"))).alias("gaps"), module(F.concat(F.lit("about "), n.cast("string")), listed(n % 3, "a"), listed(n % 4, "i")).alias("packaging"),
        module(F.lit(None).cast("string"), none, pictures(n % 2 == 0)).alias("charging_case"), module(F.lit(None).cast("string"), none, pictures(n % 7 == 0)).alias("earbuds"),
    )
    summaries = orders.filter("o_orderkey % 5 = 0").select(n.alias("source"), F.lit("packaging").alias("module"), F.array(F.lit("b0"), F.lit("b1")).alias("bullets"))
    found = S.unboxing_snapshots(sources, summaries, "product")
    return found.select("product", "source", F.col("packaging.description").alias("packaging"), (F.size("packaging.accessories") + F.size("packaging.images")).cast("long").alias("filled"), F.array_join("packaging.bullets", ",").alias("bullets"), "completeness", F.array_join("gaps", ",").alias("gaps"))
