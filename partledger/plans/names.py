"""Queries over similar and contained names."""

from __future__ import annotations

from pyspark.sql import functions as F

from partledger.functions.identity import folded_key
from partledger.functions.text import canonical_id
from partledger.operators import similarity as S
from partledger.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str, *names: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return keep


#: Matching blocks in SQL: pairs (x, y) are cut at their longest common run, the first in x, then in y, and cut again left and right of it.
RATIO_SQL = """
cut AS (
  SELECT x, y, x AS a, y AS b, list_max(list_transform(range(1, length(x) + 1), lambda i: {'l': len(list_filter(range(1, length(x) - i + 2), lambda n: contains(y, substr(x, i, n)))), 'i': -i})) AS m FROM pair
  UNION ALL
  SELECT x, y, a, b, list_max(list_transform(range(1, length(a) + 1), lambda i: {'l': len(list_filter(range(1, length(a) - i + 2), lambda n: contains(b, substr(a, i, n)))), 'i': -i}))
  FROM (SELECT x, y, unnest([substr(a, 1, -m.i - 1), substr(a, m.l - m.i)]) AS a, unnest([substr(b, 1, instr(b, substr(a, -m.i, m.l)) - 1), substr(b, instr(b, substr(a, -m.i, m.l)) + m.l)]) AS b FROM cut WHERE m.l > 0)
  WHERE a <> '' AND b <> ''
), ratio AS (
  SELECT x, y, 2.0::DOUBLE * sum(m.l) / (length(x) + length(y)) AS ratio FROM cut GROUP BY x, y
)
"""


@query(f"""
WITH RECURSIVE q AS (
  SELECT p_partkey AS query, replace(lower(p_type || p_name), ' ', '') AS x, p_brand AS g FROM part
), first AS (
  SELECT p_name, min(p_partkey) AS item FROM part GROUP BY p_name
), i AS (
  SELECT item, unnest([replace(lower(p.p_name), ' ', ''), replace(lower(p_brand || p.p_name), ' ', '')]) AS y, p_brand AS ig FROM first JOIN part p ON p_partkey = item
), pair AS (
  SELECT DISTINCT x, y FROM (SELECT DISTINCT x FROM q), i
), {RATIO_SQL.strip()}, best AS (
  SELECT x, g, item, min(struct_pack(m := -ratio, y := y)).y AS alias, max(least(1.0, ratio + CASE WHEN g = ig THEN 0.15 ELSE 0.0 END)) AS score FROM ratio JOIN i USING (y) JOIN (SELECT DISTINCT x, g FROM q) USING (x) GROUP BY x, g, item HAVING score >= 0.45
), top AS (
  SELECT *, row_number() OVER (PARTITION BY x, g ORDER BY round_even(score, 3) DESC, item) AS place FROM best
)
SELECT query, item, alias, round(score, 6) AS score, place::INT AS place FROM q JOIN top USING (x, g) WHERE place <= 5
""", "part")
def similar_products(part):
    """The five catalogue entries most like each product's type and name, by matching blocks, entries of its brand before others."""
    queries = part.select(F.col("p_partkey").alias("query"), F.concat_ws(" ", "p_type", "p_name").alias("text"), F.col("p_brand").alias("group"))
    first = part.groupBy("p_name").agg(F.min(F.struct(F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"))).alias("f"))
    aliases = F.explode(F.array("p_name", F.concat_ws(" ", "f.brand", "p_name")))
    items = first.select("f.item", aliases.alias("alias"), F.col("f.brand").alias("item_group"))
    return S.top_similar(queries, items).withColumn("score", F.round("score", 6))


@query(f"""
WITH RECURSIVE t AS (
  SELECT p_partkey, regexp_replace(lower(p_name || ', ' || p_type), '[\\s,]+', '', 'g') AS x, regexp_replace(lower(lag(p_name || CASE WHEN p_partkey % 4 = 3 THEN '' ELSE ' ' || p_type END) OVER (ORDER BY p_partkey)), '[\\s,]+', '', 'g') AS y FROM part
), pair AS (
  SELECT DISTINCT x, y FROM t WHERE y <> ''
), {RATIO_SQL.strip()}
SELECT p_partkey, CASE WHEN y IS NULL OR y = '' THEN false WHEN contains(x, y) OR contains(y, x) THEN least(length(x), length(y)) >= 0.68 * greatest(length(x), length(y)) ELSE ratio >= 0.76 END AS same FROM t LEFT JOIN ratio USING (x, y)
""", "part")
def caption_sameness(part):
    """Whether each row says the same as the one before, which another line names by another rule."""
    before = F.concat("p_name", F.when(F.col("p_partkey") % 4 == 3, "").otherwise(F.concat(F.lit(" "), "p_type")))
    earlier = part.select((F.col("p_partkey") + 1).alias("p_partkey"), before.alias("before"))
    rows = part.select("p_partkey", F.concat_ws(", ", "p_name", "p_type").alias("text")).join(earlier, "p_partkey", "left")
    return rows.select("p_partkey", S.text_is_same(F.col("text"), F.col("before")).alias("same"))


_MATCH_SQL = """
WITH raw AS (
  SELECT p_partkey AS item, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'New ' || p_brand || ': ' END || p_name || ' ' || (p_size + CASE WHEN p_partkey % 7 = 0 THEN 50 ELSE 0 END) || ', taken apart (' || p_type || ')' AS title,
    CASE WHEN p_partkey % 4 = 0 THEN p_brand WHEN p_partkey % 4 = 1 THEN 'Brand#3' ELSE '' END AS brand, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' ' || p_size ELSE '' END AS model FROM part
), k AS (
  SELECT item, CASE WHEN brand <> '' AND model <> '' THEN regexp_replace(lower(brand), '[^a-z0-9]+', '-', 'g') || '--' || regexp_replace(lower(model), '[^a-z0-9]+', '-', 'g') ELSE '' END AS canonical,
    regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS t, regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g') AS b, regexp_replace(lower(model), '[^a-z0-9]+', '', 'g') AS m FROM raw
), p AS (
  SELECT p_partkey AS product, CASE WHEN p_partkey % 2 = 0 THEN regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') || '--' || regexp_replace(lower(p_name || ' ' || p_size), '[^a-z0-9]+', '-', 'g') ELSE '' END AS pc,
    regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS pb, CASE WHEN p_partkey % 11 = 0 THEN p_size::VARCHAR ELSE regexp_replace(lower(p_name || p_size), '[^a-z0-9]+', '', 'g') END AS pm FROM part
), u AS (
  SELECT pb, pm, min(product) AS product FROM p WHERE length(pm) >= 3 GROUP BY pb, pm
), h AS (
  SELECT item, min(product) AS product, 0 AS step FROM k JOIN p ON canonical = pc AND pc <> '' GROUP BY item
  UNION ALL SELECT item, product, CASE WHEN b = pb AND m = pm THEN 1 WHEN contains(t, pm) AND (b = pb OR contains(t, pb)) THEN 2 ELSE 3 END FROM k JOIN u ON contains(t, pm) OR m = pm
), best AS (
  SELECT item, product, step FROM h QUALIFY row_number() OVER (PARTITION BY item ORDER BY step, product) = 1
)
SELECT item, product, CASE step WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.98 WHEN 3 THEN 0.82 END::DOUBLE AS confidence,
  CASE step WHEN 0 THEN 'canonical_product_id_exact' WHEN 1 THEN 'normalized_brand_model_exact' WHEN 2 THEN 'brand_and_model_in_title' WHEN 3 THEN 'model_only_needs_review' ELSE 'no_product_match' END AS reason
FROM k LEFT JOIN best USING (item)
"""


@query(_MATCH_SQL, "part")
def title_match_cascade(part):
    """Titles that name products in several ways, matched with the catalogue in four steps."""
    size = F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 50).otherwise(0)
    title = F.concat(F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("New "), "p_brand", F.lit(": "))), "p_name", F.lit(" "), size, F.lit(", taken apart ("), "p_type", F.lit(")"))
    brand = F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).when(F.col("p_partkey") % 4 == 1, "Brand#3").otherwise("")
    whole = F.concat_ws(" ", "p_name", "p_size")
    model = F.when(F.col("p_partkey") % 5 == 0, whole).otherwise("")
    items = part.select(F.col("p_partkey").alias("item"), F.when((brand != "") & (model != ""), canonical_id(brand, model)).otherwise("").alias("canonical"), folded_key(title).alias("title"), folded_key(brand).alias("brand"), folded_key(model).alias("model"))
    other = F.when(F.col("p_partkey") % 11 == 0, F.col("p_size").cast("string")).otherwise(folded_key(whole))
    products = part.select(F.col("p_partkey").alias("product"), F.when(F.col("p_partkey") % 2 == 0, canonical_id("p_brand", whole)).otherwise("").alias("canonical"), folded_key("p_brand").alias("brand"), other.alias("model"))
    return S.match_products(items, products)


@query("""
WITH i AS (SELECT p_partkey AS item, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS category, CASE p_size % 3 WHEN 0 THEN lower(p_brand) WHEN 1 THEN '' ELSE lower(p_brand) || 'x' END AS brand, CASE WHEN p_size % 5 = 0 THEN '' ELSE replace(p_name, ' ', '') || p_size END AS model, CASE WHEN p_size % 7 = 0 THEN 'the' || replace(p_name, ' ', '') || p_size ELSE '' END AS title FROM part),
p AS (SELECT p_partkey AS product, CASE WHEN p_size % 6 = 0 THEN '' ELSE p_type END AS o, lower(p_brand) AS b, CASE WHEN p_size % 10 = 9 THEN '' ELSE replace(p_name, ' ', '') || (p_size % 20) END AS m FROM part WHERE p_size > 25),
s AS (SELECT item, product, CASE WHEN brand <> '' AND (contains(brand, b) OR contains(b, brand)) THEN 2 ELSE 0 END + CASE WHEN model <> '' AND m <> '' AND (contains(model, m) OR contains(m, model) OR contains(title, model)) THEN 2 ELSE 0 END AS score FROM i JOIN p ON category = '' OR o = '' OR category = o)
SELECT item, product, score::INT AS score, row_number() OVER (PARTITION BY item ORDER BY score DESC, product)::INT AS place FROM s WHERE score >= 2 QUALIFY place <= 5
""", "part")
def internal_products(part):
    """Products of one's own beside each product, by brand and model in each other or in its title; larger sizes stand for one's own."""
    whole = F.concat("p_name", F.col("p_size").cast("string"))
    third = F.col("p_size") % 3
    items = part.select(
        F.col("p_partkey").alias("item"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("category"), F.when(third == 0, F.col("p_brand")).when(third == 2, F.concat("p_brand", F.lit("x"))).alias("brand"), F.when(F.col("p_size") % 5 != 0, whole).alias("model"),
        F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("The "), whole)).alias("title"),
    )
    own = part.filter("p_size > 25").select(F.col("p_partkey").alias("product"), F.when(F.col("p_size") % 6 != 0, F.col("p_type")).alias("category"), "p_brand", F.when(F.col("p_size") % 10 != 9, F.concat("p_name", (F.col("p_size") % 20).cast("string"))).alias("model"))
    return S.internal_matches(items, own.withColumnRenamed("p_brand", "brand"))
