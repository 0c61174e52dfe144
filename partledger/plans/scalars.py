"""Queries that show the scalar functions on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from partledger.functions import identity as I
from partledger.functions.text import family_match, model_token, tolerant_date
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


@query("", "documents")
def unicode_keys(documents):
    """Keys of whole texts, which may be of any alphabet, as digests."""
    return documents.select("doc_id", F.md5(I.folded_key("text")).alias("key"), F.md5(I.ascii_slug("text")).alias("slug"))


@query("""
SELECT s_suppkey, trim(regexp_replace(trim(regexp_replace(lower(s_name || CASE WHEN s_suppkey % 3 = 0 THEN ' Co., Ltd.' WHEN s_suppkey % 3 = 1 THEN ' GmbH' ELSE '' END), '[^0-9a-z]+', ' ', 'g')), '(?: (?:co|ltd|gmbh|inc))+$', '')) AS bare FROM supplier
""", "supplier")
def company_signature(supplier):
    name = F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, " Co., Ltd.").when(F.col("s_suppkey") % 3 == 1, " GmbH").otherwise(""))
    return supplier.select("s_suppkey", I.bare_company(name, ["co", "ltd", "gmbh", "inc"]).alias("bare"))


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+'), lambda t: length(t) >= 2))), ' ') AS tokens FROM part
""", "part")
def token_sets(part):
    return part.select("p_partkey", F.array_join(F.sort_array(I.latin_tokens(F.concat_ws(" ", "p_name", "p_brand"))), " ").alias("tokens"))


@query("""
SELECT p_partkey, list_sum(list_transform(['green', 'ring', '1'], lambda w: CASE WHEN list_contains(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+'), w) THEN 2.0 WHEN contains(lower(p_name || ' ' || p_brand), w) THEN 0.5 ELSE 0 END))::DOUBLE AS score FROM part
""", "part")
def search_hit_score(part):
    wanted = F.array(*map(F.lit, ("green", "ring", "1")))
    return part.select("p_partkey", I.token_score(F.concat_ws(" ", "p_name", "p_brand"), wanted, 2.0, 0.5).alias("score"))


@query("""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '^(www|m)\\.', '') || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS link,
  CAST(list_last(regexp_extract_all(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '[0-9]+')) AS BIGINT) AS number FROM pages
""", "pages")
def link_normalisation(pages):
    return pages.select("page_id", I.clean_link("url").alias("link"), I.number_in_link("url").alias("number"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 7 = 0 AND p_size % 5 = 0 THEN p_partkey::VARCHAR ELSE trim(concat_ws(' ', CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END)) END AS name,
  CASE WHEN p_size % 3 = 0 THEN '¥' WHEN p_size % 3 = 1 THEN '$' ELSE 'EUR ' END || printf('%.2f', p_retailprice) AS price FROM part
""", "part")
def display_fields(part):
    brand, model = F.when(F.col("p_size") % 7 != 0, F.col("p_brand")), F.when(F.col("p_size") % 5 != 0, F.col("p_name"))
    currency = F.when(F.col("p_size") % 3 == 0, "CNY").when(F.col("p_size") % 3 == 1, "USD").otherwise("EUR")
    return part.select("p_partkey", I.display_name(brand, model, "p_partkey").alias("name"), I.price_label("p_retailprice", currency, {"CNY": "¥", "USD": "$"}).alias("price"))


@query("""
SELECT p_partkey, array_to_string(list_distinct_ordered, ';') AS tags FROM (SELECT p_partkey, list_filter([p_type, p_brand, CASE WHEN p_size % 2 = 0 THEN p_type ELSE ' ' END, split_part(p_name, ' ', 1)], lambda v, i: trim(v) <> '' AND list_position([p_type, p_brand, CASE WHEN p_size % 2 = 0 THEN p_type ELSE ' ' END, split_part(p_name, ' ', 1)], v) = i)[1:3] AS list_distinct_ordered FROM part)
""", "part")
def search_entries(part):
    columns = [F.col("p_type"), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" "), F.split_part("p_name", F.lit(" "), F.lit(1))]
    return part.select("p_partkey", F.array_join(I.search_tags(columns, 3), ";").alias("tags"))


@query("""
SELECT event_id, CAST(json_extract(regexp_extract('note ' || props || ' end', '(\\{[^{}]*\\})', 1), '$.k') AS BIGINT) AS k FROM events
""", "events")
def json_in_text(events):
    found = I.first_json_object(F.concat(F.lit("note "), "props", F.lit(" end")))
    return events.select("event_id", F.get_json_object(found, "$.k").try_cast("long").alias("k"))


@query("""
SELECT p_partkey, coalesce(list_last(regexp_extract_all(code, '[A-Z]{1,8}[0-9]+[A-Z0-9-]*')), trim(code)) AS token, regexp_matches(coalesce(list_last(regexp_extract_all(code, '[A-Z]{1,8}[0-9]+[A-Z0-9-]*')), trim(code)), '^QC1[A-Z0-9]$') AS fits
FROM (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN ' none ' ELSE 'chip QC' || p_size || ' of ' || p_name END AS code FROM part)
""", "part")
def model_tokens(part):
    code = F.when(F.col("p_size") % 4 == 0, " none ").otherwise(F.concat(F.lit("chip QC"), F.col("p_size").cast("string"), F.lit(" of "), "p_name"))
    rows = part.select("p_partkey", model_token(code).alias("token"))
    return rows.withColumn("fits", family_match(F.col("token"), F.lit("QC1X")))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate::DATE END AS day, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE year(o_orderdate)::VARCHAR END AS year FROM orders
""", "orders")
def tolerant_dates(orders):
    text = F.when(F.col("o_orderkey") % 4 == 0, "20xx-1-1").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    day = tolerant_date(text)
    return orders.select("o_orderkey", day.alias("day"), F.coalesce(F.year(day).cast("string"), F.lit("unknown")).alias("year"))
