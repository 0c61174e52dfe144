"""Queries over the supply facts: coverage, manifests, rankings, trends, facets, matrices."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from partledger.functions.text import blank_to_null, ratio, short_hash
from partledger.operators import analytics as A
from partledger.operators.records import top_n
from partledger.sources.tables import FACTS_SQL, supplied_products, supply_rows

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str, of=supply_rows):
    """Registers a query under its function's name over the analysis rows, or their products; the SQL follows the CTEs facts and rows."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(of(spark, sf_dir))
        ORACLE_SQL[f.__name__] = f"WITH {FACTS_SQL}, {sql.strip()}" if sql.strip().startswith("q ") else f"WITH {FACTS_SQL} {sql.strip()}"
        return f

    return keep


@query("""
SELECT component_key, count(*) AS rows, count(DISTINCT product_id) AS products,
  count(DISTINCT product_id) FILTER (manufacturer <> '') AS manufacturer_products, count(DISTINCT product_id) FILTER (model_status = 'reported') AS model_products, count(DISTINCT product_id) FILTER (parameters > 1) AS parameter_products,
  count(*) FILTER (manufacturer <> '') AS manufacturer_rows, count(*) FILTER (model_status = 'reported') AS model_rows, count(*) FILTER (parameters > 1) AS parameter_rows, count(*) FILTER (model_status = 'invalid_parameter_value') AS invalid_model_rows,
  round_even(count(*) FILTER (manufacturer <> '') / count(*), 4) AS manufacturer_row_ratio, round_even(count(DISTINCT product_id) FILTER (manufacturer <> '') / count(DISTINCT product_id), 4) AS manufacturer_product_ratio,
  round_even(count(*) FILTER (model_status = 'reported') / count(*), 4) AS model_row_ratio, round_even(count(DISTINCT product_id) FILTER (model_status = 'reported') / count(DISTINCT product_id), 4) AS model_product_ratio,
  round_even(count(*) FILTER (parameters > 1) / count(*), 4) AS parameter_row_ratio, round_even(count(DISTINCT product_id) FILTER (parameters > 1) / count(DISTINCT product_id), 4) AS parameter_product_ratio
FROM rows GROUP BY component_key
""")
def component_coverage(rows):
    return A.coverage(rows)


@query("""
SELECT row_number() OVER (ORDER BY component_key) AS ordinal, component_key, count(*) AS rows, count(DISTINCT product_id) AS products FROM rows GROUP BY component_key
""")
def component_manifest(rows):
    found = A.manifest(rows, "component_key", {})
    return found.withColumn("ordinal", F.row_number().over(Window.orderBy("component_key")).cast("long"))


@query("SELECT coalesce(nullif(trim(product_brand), ''), 'unknown') AS label, count(*) AS count FROM rows GROUP BY 1")
def distribution_brand(rows):
    return A.distribution(rows, "product_brand")


@query("SELECT product_category AS label, count(*) AS count FROM rows GROUP BY 1")
def distribution_category(rows):
    return A.distribution(rows, "product_category")


@query("""
SELECT product_brand, substr(sha1('brand|' || product_brand), 1, 12) AS brand_key, count(*) AS rows, count(DISTINCT product_id) AS products, count(DISTINCT component_key) AS components
FROM rows WHERE product_brand <> '' GROUP BY product_brand
""")
def brand_manifest(rows):
    found = A.manifest(rows.filter(A.known("product_brand")), "product_brand", {"components": F.col("component_key")})
    return found.withColumn("brand_key", short_hash(12, F.lit("brand"), "product_brand")).orderBy(F.desc("products"), "product_brand")


@query("""
SELECT product_brand, count(*) AS rows, count(DISTINCT product_id) AS products, count(DISTINCT nullif(manufacturer, '')) AS suppliers, round_even(count(*) FILTER (manufacturer <> '') / count(*), 4) AS manufacturer_ratio, max(published) AS latest
FROM rows WHERE product_brand = 'BUILDING' GROUP BY product_brand
""")
def brand_payload(rows):
    of = rows.filter(F.col("product_brand") == "BUILDING").groupBy("product_brand")
    found = of.agg(F.count("*").alias("rows"), F.count_distinct("product_id").alias("products"), F.count_distinct(blank_to_null("manufacturer")).alias("suppliers"), F.count_if(A.known("manufacturer")).alias("_known"), F.max("published").alias("latest"))
    return found.withColumn("manufacturer_ratio", ratio(F.col("_known"), F.col("rows"))).drop("_known")


@query("""
SELECT manufacturer, substr(sha1('supplier|' || manufacturer), 1, 12) AS supplier_key, count(*) AS rows, count(DISTINCT product_id) AS products, count(DISTINCT component_key) AS components, count(DISTINCT CASE WHEN model_status = 'reported' THEN model END) AS models,
  count(DISTINCT product_brand) AS brands, count(DISTINCT CASE WHEN model_status = 'reported' THEN product_id END) AS model_known_products, count(DISTINCT CASE WHEN product_brand <> '' THEN product_id END) AS brand_known_products
FROM rows WHERE manufacturer <> '' GROUP BY manufacturer
""")
def supplier_manifest(rows):
    """brands counts the blank brand as one of them."""
    reported = F.col("model_status") == "reported"
    counted = {"components": F.col("component_key"), "models": F.when(reported, F.col("model")), "brands": F.col("product_brand")}
    flags = {"model_known_products": reported, "brand_known_products": A.known("product_brand")}
    found = A.manifest(rows.filter(A.known("manufacturer")), "manufacturer", counted, flags)
    return found.withColumn("supplier_key", short_hash(12, F.lit("supplier"), "manufacturer")).orderBy(F.desc("products"), F.desc("components"), "manufacturer")


@query("""
SELECT component_key, count(*) AS rows, count(DISTINCT product_id) AS products, count(DISTINCT nullif(product_brand, '')) AS brands, min(published) AS first_date, max(published) AS last_date
FROM rows WHERE manufacturer = 'Supplier#000000001' GROUP BY component_key
""")
def supplier_payload(rows):
    of = rows.filter(F.col("manufacturer") == "Supplier#000000001").groupBy("component_key")
    return of.agg(F.count("*").alias("rows"), F.count_distinct("product_id").alias("products"), F.count_distinct(blank_to_null("product_brand")).alias("brands"), F.min("published").alias("first_date"), F.max("published").alias("last_date"))


@query("""
q AS (SELECT manufacturer, product_id, max(CASE WHEN model_status = 'reported' THEN 1 ELSE 0 END) AS r, max(CASE WHEN parameters > 1 THEN 1 ELSE 0 END) AS p FROM rows WHERE manufacturer <> '' GROUP BY ALL)
SELECT manufacturer, count(*) AS products, sum(p)::BIGINT AS parameterised_products, sum(1 - r)::BIGINT AS supplier_only_products FROM q GROUP BY manufacturer
""")
def supplier_stats(rows):
    flags = {"reported": F.col("model_status") == "reported", "parameterised": F.col("parameters") > 1}
    per = A.once_per_product(rows.filter(A.known("manufacturer")), ["manufacturer"], flags)
    return per.groupBy("manufacturer").agg(F.count("*").alias("products"), F.sum("parameterised").alias("parameterised_products"), F.sum(1 - F.col("reported")).alias("supplier_only_products"))


@query("""
SELECT manufacturer, lower(model) AS model_key, count(DISTINCT product_id) AS products, string_agg(DISTINCT product_brand, ';' ORDER BY product_brand) FILTER (product_brand <> '') AS brands, string_agg(DISTINCT usage_location, ';' ORDER BY usage_location) AS locations,
  min(year(published))::INT AS first_year, max(year(published))::INT AS last_year, count(DISTINCT CASE WHEN parameters > 1 THEN product_id END) AS parameterised_products
FROM rows WHERE manufacturer <> '' AND model_status = 'reported' GROUP BY 1, 2
""")
def model_stats(rows):
    """Flags for each product first, so that distinct counts become sums."""
    of = rows.filter(A.known("manufacturer") & (F.col("model_status") == "reported"))
    year = F.year("published")
    keys = ["manufacturer", "model_key"]
    per = of.groupBy("manufacturer", F.lower("model").alias("model_key"), "product_id", "product_brand").agg(
        F.max(F.when(F.col("usage_location") == "A", 1).otherwise(0)).alias("a"), F.max(F.when(F.col("usage_location") == "N", 1).otherwise(0)).alias("n"), F.max(F.when(F.col("usage_location") == "R", 1).otherwise(0)).alias("r"),
        F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.max(F.when(F.col("parameters") > 1, 1).otherwise(0)).alias("parameterised"),
    )
    brands = F.nullif(F.array_join(F.sort_array(F.collect_set(blank_to_null("product_brand"))), ";"), F.lit(""))
    locations = F.concat_ws(";", *(F.when(F.max(c) == 1, c.upper()) for c in ("a", "n", "r")))
    return per.groupBy(*keys).agg(F.count("*").alias("products"), brands.alias("brands"), locations.alias("locations"), F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"), F.sum("parameterised").alias("parameterised_products"))


@query("""
q AS (SELECT year(published)::INT AS year, manufacturer, count(DISTINCT product_id) AS products FROM rows WHERE manufacturer <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY products DESC, manufacturer) AS rank FROM q),
y AS (SELECT year, lag(year) OVER (ORDER BY year) AS previous FROM (SELECT DISTINCT year FROM q))
SELECT r.year, r.manufacturer, r.products, r.rank, b.rank - r.rank AS movement FROM r JOIN y USING (year) LEFT JOIN r b ON b.year = y.previous AND b.manufacturer = r.manufacturer WHERE r.rank <= 5
""")
def supplier_year_rank_movement(rows):
    return A.yearly_ranks(rows.filter(A.known("manufacturer")), "manufacturer")


@query("""
q AS (SELECT manufacturer, year(published)::INT AS year, count(DISTINCT product_id) AS products FROM rows WHERE manufacturer <> '' GROUP BY ALL), s AS (SELECT manufacturer FROM rows WHERE manufacturer <> '' GROUP BY 1 ORDER BY count(DISTINCT product_id) DESC, 1 LIMIT 5)
SELECT manufacturer, year, coalesce(products, 0) AS products FROM s CROSS JOIN (SELECT DISTINCT year FROM q) LEFT JOIN q USING (manufacturer, year)
""")
def annual_trend_zero_filled(rows):
    return A.zero_filled_trend(rows.filter(A.known("manufacturer")), "manufacturer")


@query("SELECT manufacturer, count(DISTINCT product_id) AS products FROM rows WHERE manufacturer <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def cumulative_top_suppliers(rows):
    """A top-k report: ten is what it reports."""
    found = A.manifest(rows.filter(A.known("manufacturer")), "manufacturer", {}).drop("rows")
    return found.orderBy(F.desc("products"), "manufacturer").limit(10)


@query("""
q AS (SELECT product_category, product_id, count(*) AS n_rows, max(published) AS latest FROM rows GROUP BY ALL)
SELECT product_category, product_id, n_rows, latest, row_number() OVER (PARTITION BY product_category ORDER BY n_rows DESC, latest DESC, product_id) AS rank FROM q QUALIFY rank <= 9
""")
def category_topn_slice(rows):
    per = rows.groupBy("product_category", "product_id").agg(F.count("*").alias("n_rows"), F.max("published").alias("latest"))
    return top_n(per, ["product_category"], [F.desc("n_rows"), F.desc("latest"), F.col("product_id")], 9)


@query("""
q AS (SELECT manufacturer, min(year(published))::INT AS first_year, max(year(published))::INT AS last_year FROM rows WHERE manufacturer <> '' GROUP BY 1) SELECT *, first_year = max(last_year) OVER () AS entrant FROM q
""")
def evolution_first_year(rows):
    return A.first_years(rows.filter(A.known("manufacturer")), "manufacturer")


@query("""
q AS (SELECT product_id, manufacturer, min(year(published))::INT AS year, min(product_category) AS category FROM rows WHERE manufacturer <> '' GROUP BY 1, 2)
SELECT year, manufacturer, count(*) AS products, count(DISTINCT category) AS categories FROM q GROUP BY 1, 2
""")
def evolution_by_year(rows):
    first = rows.filter(A.known("manufacturer")).groupBy("product_id", "manufacturer").agg(F.min(F.year("published")).alias("year"), F.min("product_category").alias("category"))
    return first.groupBy("year", "manufacturer").agg(F.count("*").alias("products"), F.count_distinct("category").alias("categories"))


@query("""
q AS (SELECT component_key, product_id, max(CASE WHEN manufacturer <> '' THEN 1 ELSE 0 END) AS k FROM rows GROUP BY ALL)
SELECT component_key, count(*) AS cells, sum(k)::BIGINT AS known_cells, round_even(sum(k) / count(*), 4) AS known_ratio FROM q GROUP BY component_key
""")
def known_cell_coverage(rows):
    cells = A.once_per_product(rows, ["component_key"], {"known": A.known("manufacturer")})
    found = cells.groupBy("component_key").agg(F.count("*").alias("cells"), F.sum("known").cast("long").alias("known_cells"))
    return found.withColumn("known_ratio", ratio(F.col("known_cells"), F.col("cells")))


@query("""
SELECT component_key, manufacturer, model, count(DISTINCT product_id) AS products FROM rows WHERE manufacturer <> '' AND model_status = 'reported' GROUP BY ALL HAVING count(DISTINCT product_id) >= 2 ORDER BY products DESC, component_key, manufacturer, model LIMIT 1
""")
def reuse_top_combo(rows):
    """A top-1 report."""
    per = rows.filter(A.known("manufacturer") & (F.col("model_status") == "reported")).groupBy("component_key", "manufacturer", "model").agg(F.count_distinct("product_id").alias("products"))
    return per.filter("products >= 2").orderBy(F.desc("products"), "component_key", "manufacturer", "model").limit(1)


@query("""
q AS (SELECT component_key, product_category, manufacturer, count(DISTINCT product_id) AS products FROM rows WHERE manufacturer <> '' GROUP BY ALL), t AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY component_key, product_category ORDER BY products DESC, manufacturer) = 1)
SELECT component_key, product_category, manufacturer, products, min(manufacturer) OVER c <> max(manufacturer) OVER c AS differs FROM t WINDOW c AS (PARTITION BY component_key)
""")
def top_supplier_by_category(rows):
    per = rows.filter(A.known("manufacturer")).groupBy("component_key", "product_category", "manufacturer").agg(F.count_distinct("product_id").alias("products"))
    best = top_n(per, ["component_key", "product_category"], [F.desc("products"), F.col("manufacturer")], 1).drop("rank")
    of = Window.partitionBy("component_key")
    return best.withColumn("differs", F.min("manufacturer").over(of) != F.max("manufacturer").over(of))


@query("""
SELECT product_category, product_brand, grouping(product_brand)::INT AS is_total, count(DISTINCT product_id) AS products FROM rows GROUP BY ROLLUP (product_category, product_brand)
""", supplied_products)
def category_brand_tree(products):
    """A product has one category and one brand, so products that have a row are all that is counted."""
    return products.rollup("product_category", "product_brand").agg(F.grouping("product_brand").cast("int").alias("is_total"), F.count("*").alias("products"))


_FACET_SQL = """
q AS (
  SELECT 'component_key' AS dimension, component_key AS value, count(DISTINCT product_id) AS products FROM rows WHERE product_region = 'ASIA' AND usage_location = 'R' GROUP BY 2
  UNION ALL SELECT 'product_region', product_region, count(DISTINCT product_id) FROM rows WHERE usage_location = 'R' GROUP BY 2
  UNION ALL SELECT 'usage_location', usage_location, count(DISTINCT product_id) FROM rows WHERE product_region = 'ASIA' GROUP BY 2
) SELECT coalesce(q.dimension, k.dimension) AS dimension, coalesce(q.value, k.value) AS value, coalesce(products, 0) AS products FROM q FULL JOIN (VALUES ('product_region', 'ASIA'), ('usage_location', 'R')) k(dimension, value) ON q.dimension = k.dimension AND q.value = k.value
"""


@query(_FACET_SQL)
def facets_self_excluding(rows):
    return A.self_excluding_facets(rows, {"product_region": "ASIA", "usage_location": "R"}, ["component_key", "product_region", "usage_location"])


@query("""
q AS (SELECT product_id, CASE WHEN min(CASE WHEN parameters > 1 THEN 1 ELSE 0 END) = 1 THEN 'complete' WHEN max(CASE WHEN parameters > 1 THEN 1 ELSE 0 END) = 1 THEN 'partial' ELSE 'missing' END AS state FROM rows GROUP BY 1)
SELECT state, count(*) AS products FROM q GROUP BY state
""")
def disclosure_state_counts(rows):
    has = F.when(F.col("parameters") > 1, 1).otherwise(0)
    per = rows.groupBy("product_id").agg(F.min(has).alias("all"), F.max(has).alias("any"))
    state = F.when(F.col("all") == 1, "complete").when(F.col("any") == 1, "partial").otherwise("missing")
    return per.groupBy(state.alias("state")).agg(F.count("*").alias("products"))


@query("""
SELECT product_id, component_key, coalesce(string_agg(DISTINCT nullif(manufacturer, ''), ';' ORDER BY nullif(manufacturer, '')), '') AS suppliers FROM rows
WHERE product_brand = 'BUILDING' GROUP BY 1, 2
""")
def supply_matrix(rows):
    cell = F.array_join(F.sort_array(F.collect_set(blank_to_null("manufacturer"))), ";")
    return rows.filter(F.col("product_brand") == "BUILDING").groupBy("product_id", "component_key").agg(cell.alias("suppliers"))


@query("""
SELECT component_key, count(DISTINCT product_id) FILTER (usage_location = 'A') AS a, count(DISTINCT product_id) FILTER (usage_location = 'N') AS n, count(DISTINCT product_id) FILTER (usage_location = 'R') AS r FROM rows GROUP BY 1
""")
def location_pivot(rows):
    found = rows.groupBy("component_key").pivot("usage_location", ["A", "N", "R"]).agg(F.count_distinct("product_id"))
    return found.select("component_key", *(F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in ("A", "N", "R")))


@query("""
q AS (SELECT product_brand, product_category, component_key, count(DISTINCT nullif(manufacturer, '')) AS suppliers, count(DISTINCT product_id) AS products FROM rows WHERE product_brand <> '' GROUP BY ALL),
n AS (SELECT product_brand, count(DISTINCT product_category) AS categories FROM rows WHERE product_brand <> '' GROUP BY 1)
SELECT q.product_brand, component_key, CASE WHEN count(*) = any_value(categories) THEN 'common' ELSE 'partial' END AS presence, min(suppliers) <> max(suppliers) AS changed FROM q JOIN n USING (product_brand) GROUP BY 1, 2
""")
def bom_alignment(rows):
    of = rows.filter(A.known("product_brand"))
    per = of.groupBy("product_brand", "product_category", "component_key").agg(F.count_distinct(blank_to_null("manufacturer")).alias("suppliers"))
    all_ = of.groupBy("product_brand").agg(F.count_distinct("product_category").alias("categories"))
    found = per.groupBy("product_brand", "component_key").agg(F.count("*").alias("n"), (F.min("suppliers") != F.max("suppliers")).alias("changed")).join(all_, "product_brand")
    return found.select("product_brand", "component_key", F.when(F.col("n") == F.col("categories"), "common").otherwise("partial").alias("presence"), "changed")


@query("""
SELECT count(*) AS rows, count(*) FILTER (model_status = 'invalid_parameter_value') AS invalid_model_rows, count(*) FILTER (manufacturer = '') AS unknown_manufacturer_rows, count(*) FILTER (product_brand = '') AS unknown_brand_rows,
  count(*) FILTER (manufacturer = '' AND model_status <> 'reported') AS quarantined_rows, min(published) AS first_date, max(published) AS last_date FROM rows
""")
def quality_audit_counters(rows):
    unknown = F.col("manufacturer") == ""
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(F.col("model_status") == "invalid_parameter_value").alias("invalid_model_rows"), F.count_if(unknown).alias("unknown_manufacturer_rows"), F.count_if(F.col("product_brand") == "").alias("unknown_brand_rows"),
        F.count_if(unknown & (F.col("model_status") != "reported")).alias("quarantined_rows"), F.min("published").alias("first_date"), F.max("published").alias("last_date"),
    )


@query("""
SELECT coalesce(year(published)::VARCHAR, 'unknown') AS year, count(DISTINCT product_id) AS products, count(DISTINCT product_id) FILTER (model_status = 'reported') AS modelled FROM rows GROUP BY 1
""")
def year_coverage(rows):
    return rows.groupBy(F.coalesce(F.year("published").cast("string"), F.lit("unknown")).alias("year")).agg(F.count_distinct("product_id").alias("products"), F.count_distinct(F.when(F.col("model_status") == "reported", F.col("product_id"))).alias("modelled"))
