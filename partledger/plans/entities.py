"""Queries that match, merge, diff and check entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from partledger.functions.text import blank_to_null, canonical_id, collapse_spaces, first_nonblank, first_rule, identity_key, marker_rules, number_and_unit, quoted, short_hash, slug
from partledger.operators import matching as M
from partledger.operators import records as R
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


@query("""
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name ILIKE '%1%' ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 20
""", "customer")
def product_page_list(customer):
    """A page of a list: its limit and offset are the feature."""
    found = customer.filter((F.col("c_mktsegment") == "BUILDING") & F.col("c_name").ilike("%1%"))
    return found.orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").offset(20).limit(50).select("c_custkey", "c_name", "c_acctbal")


@query("""
SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey) = 1
""", "orders")
def best_record_pick(orders):
    """The priority class decides before the score; ties keep the first by key."""
    order = [F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), F.desc("o_totalprice"), F.col("o_orderkey")]
    return R.best_rows(orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"), ["o_custkey"], order)


@query("""
SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority DESC) = 1
""", "orders")
def mode_category(orders):
    return R.mode_value(orders, "o_custkey", "o_orderpriority")


@query("""
SELECT CASE WHEN o_custkey % 97 < 5 THEN o_custkey % 97 ELSE o_custkey END AS o_custkey, count(*) AS orders, min(o_orderdate) AS first_seen, max(o_orderdate) AS latest, max(o_totalprice) AS price FROM orders GROUP BY 1
""", "orders", "customer")
def identity_merge(orders, customer):
    mapping = customer.filter("c_custkey % 97 < 5").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 97).alias("target"))
    merged = R.merge_identities(orders.select("o_custkey", "o_orderdate", "o_totalprice"), mapping, "o_custkey", "target")
    return merged.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("latest"), F.max("o_totalprice").alias("price"))


_UPSERT_SQL = """
WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderdate::DATE AS first_seen FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(first_seen, DATE '2024-01-01') AS first_seen,
  CASE WHEN o.o_orderstatus IS NULL THEN 'new' WHEN n.o_orderstatus IS NULL THEN 'kept' WHEN o.o_orderstatus IS DISTINCT FROM n.o_orderstatus THEN 'updated' ELSE 'unchanged' END AS action FROM o FULL JOIN n USING (o_orderkey)
"""


@query(_UPSERT_SQL, "orders")
def upsert_first_seen(orders):
    old = orders.filter("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("first_seen"), F.lit(True).alias("present"))
    status = F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))
    new = orders.filter("o_orderkey % 2 = 0").select("o_orderkey", status.alias("o_orderstatus"), F.lit(True).alias("present"))
    return R.upsert(old, new, "o_orderkey", F.lit("2024-01-01").cast("date"), ["o_orderstatus"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0", "orders")
def append_new_ids(orders):
    rows = orders.select("o_orderkey", "o_custkey")
    return R.append_new(rows.filter("o_orderkey % 3 <> 0"), rows, "o_orderkey")


@query("""
WITH b AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN -p_partkey ELSE p_partkey END AS p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END AS p_type FROM part)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' WHEN a.p_brand IS NOT DISTINCT FROM b.p_brand AND a.p_size = b.p_size AND a.p_type IS NOT DISTINCT FROM b.p_type THEN 'same' ELSE 'changed' END AS status
FROM part a FULL JOIN b ON a.p_partkey = b.p_partkey
""", "part")
def catalog_diff(part):
    key = F.when(F.col("p_partkey") % 11 == 0, -F.col("p_partkey")).otherwise(F.col("p_partkey"))
    size = F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    kind = F.when(F.col("p_partkey") % 13 != 0, F.col("p_type"))
    other = part.select(key.alias("p_partkey"), "p_brand", size.alias("p_size"), kind.alias("p_type"))
    return R.row_diff(part.select("p_partkey", "p_brand", "p_size", "p_type"), other, "p_partkey", ["p_brand", "p_size", "p_type"])


_GATE_SQL = """
WITH p AS (SELECT * FROM part WHERE p_size >= 5), s AS (SELECT * FROM supplier WHERE s_suppkey % 9 <> 0)
SELECT 'line_without_part' AS check_name, count(*) AS found, true AS blocking FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM p)
UNION ALL SELECT 'line_without_supplier', count(*), true FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM s)
UNION ALL SELECT 'returned_line_without_order', count(*), false FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
UNION ALL SELECT 'order_without_customer', count(*), true FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
"""


@query(_GATE_SQL, "lineitem", "part", "supplier", "orders", "customer")
def release_gate(lineitem, part, supplier, orders, customer):
    """Integrity checks in one table; parents are taken away so that there is something to find."""
    line = lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_returnflag")
    checks = [
        ("line_without_part", True, R.orphans(line, part.filter("p_size >= 5"), "l_partkey", "p_partkey")),
        ("line_without_supplier", True, R.orphans(line, supplier.filter("s_suppkey % 9 <> 0"), "l_suppkey", "s_suppkey")),
        ("returned_line_without_order", False, R.orphans(line, orders.filter("o_orderstatus <> 'F'"), "l_orderkey", "o_orderkey", F.col("l_returnflag") == "R")),
        ("order_without_customer", True, R.orphans(orders, customer, "o_custkey", "c_custkey")),
    ]
    out = None
    for name, blocking, rows in checks:
        one = rows.agg(F.count("*").alias("found")).select(F.lit(name).alias("check_name"), "found", F.lit(blocking).alias("blocking"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5) GROUP BY 1, 2
""", "lineitem", "part")
def orphan_checks(lineitem, part):
    return R.orphans(lineitem.select("l_partkey", "l_suppkey"), part.filter("p_size >= 5"), "l_partkey", "p_partkey").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


_ALIASES = [("green", "Verdant"), ("blue", "Azure"), ("steel blue", "Steel"), ("red", "Crimson"), ("small", "Mini"), ("widget", "Widget Co"), ("ring", "Ring Works")]


@query("""
WITH a(alias, name) AS (VALUES ('green', 'Verdant'), ('blue', 'Azure'), ('steel blue', 'Steel'), ('red', 'Crimson'), ('small', 'Mini'), ('widget', 'Widget Co'), ('ring', 'Ring Works')),
h AS (SELECT p_partkey, name, row_number() OVER (PARTITION BY p_partkey ORDER BY instr(lower(p_name), alias), -length(alias), name) AS k FROM part JOIN a ON contains(lower(p_name), alias))
SELECT part.p_partkey, coalesce(name, '') AS brand FROM part LEFT JOIN h ON part.p_partkey = h.p_partkey AND k = 1
""", "part")
def alias_first_longest(part):
    return part.select("p_partkey", M.earliest_alias(F.col("p_name"), _ALIASES).alias("brand"))


@query("""
WITH a(alias, name) AS (VALUES ('green', 'Verdant'), ('blue', 'Azure'), ('red', 'Crimson'), ('small', 'Mini')), w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w, unnest(range(len(string_split(p_name, ' ')))) AS p FROM part),
h AS (SELECT p_partkey, name, row_number() OVER (PARTITION BY p_partkey ORDER BY p, name) AS k FROM w JOIN a ON w = alias)
SELECT part.p_partkey, coalesce(name, '') AS brand FROM part LEFT JOIN h ON part.p_partkey = h.p_partkey AND k = 1
""", "part")
def alias_word_join(part):
    aliases = part.sparkSession.createDataFrame([(a, n) for a, n in _ALIASES if a in ("green", "blue", "red", "small")], "alias string, canonical string")
    return M.earliest_alias_join(part.select("p_partkey", "p_name"), "p_name", "p_partkey", aliases, "brand").drop("p_name")


@query("""
SELECT s_suppkey, CASE WHEN regexp_replace(lower(s_name), '[^0-9a-z]+', '', 'g') = 'supplier000000001' THEN 'First Supplier' WHEN contains(lower(s_name), '00007') THEN 'Seven Group' WHEN contains(lower(s_name), '7') THEN 'With Seven' ELSE s_name END AS canonical FROM supplier
""", "supplier")
def canonical_exact_then_rules(supplier):
    return supplier.select("s_suppkey", M.canonical_name(F.col("s_name"), {"supplier000000001": "First Supplier"}, [("00007", "Seven Group"), ("7", "With Seven")]).alias("canonical"))


@query("""
WITH i AS (SELECT p_partkey AS item, p_brand AS b, p_type AS t, p_size AS z FROM part WHERE p_partkey % 2 = 0), c AS (SELECT p_partkey AS cand, p_brand AS b, p_type AS t, p_size AS z FROM part WHERE p_partkey % 2 = 1),
h AS (SELECT item, cand, 1.0 AS s FROM i JOIN c ON i.b = c.b AND i.t = c.t AND i.z = c.z UNION ALL SELECT item, cand, 0.98 FROM i JOIN c ON i.b = c.b AND i.t = c.t UNION ALL SELECT item, cand, 0.82 FROM i JOIN c ON i.t = c.t AND i.z = c.z),
k AS (SELECT item, s, cand, row_number() OVER (PARTITION BY item ORDER BY s DESC, cand) AS k FROM h)
SELECT i.item, cand AS matched, s::DOUBLE AS confidence FROM i LEFT JOIN k ON i.item = k.item AND k = 1
""", "part")
def match_cascade(part):
    items = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("b"), F.col("p_type").alias("t"), F.col("p_size").cast("string").alias("z"))
    candidates = part.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("cand"), F.col("p_brand").alias("cb"), F.col("p_type").alias("ct"), F.col("p_size").cast("string").alias("cz"))
    steps = [([("b", "cb"), ("t", "ct"), ("z", "cz")], 1.0), ([("b", "cb"), ("t", "ct")], 0.98), ([("t", "ct"), ("z", "cz")], 0.82)]
    return M.match_cascade(items, candidates, "item", steps, "cand")


@query("""
WITH n AS (SELECT p_brand, p_name, min(p_partkey) AS k FROM part GROUP BY 1, 2)
SELECT a.k AS a, b.k AS b, levenshtein(a.p_name, b.p_name)::INT AS edits FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.k < b.k WHERE levenshtein(a.p_name, b.p_name) <= 2
""", "part")
def similar_names(part):
    """Near names of a brand; equal names are one row before they are compared."""
    names = part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("k"))
    return M.similar_pairs(names, "k", "p_name", F.col("p_brand"), 2)


@query("", "part")
def greedy_entity_merge(part):
    """Models of a brand and type, in which some characters are unknown, merged in order."""
    model = F.upper(F.substring(F.sha1(F.col("p_size").cast("string")), 1, 3))
    masked = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.substring(model, 1, 2), F.lit("X"))).otherwise(model)
    rows = part.select("p_brand", "p_type", masked.alias("model"), "p_partkey")
    return M.greedy_merge(rows, ["p_brand", "p_type"], "model", "p_partkey")


@query("SELECT p_partkey, substr(sha1(p_brand || '|' || p_name), 1, 12) AS key12, substr(sha256(p_name), 1, 24) AS key24 FROM part", "part")
def key_hash(part):
    return part.select("p_partkey", short_hash(12, "p_brand", "p_name").alias("key12"), short_hash(24, "p_name", algorithm="sha2").alias("key24"))


@query("""
SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') || '--' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS canonical_id FROM part
""", "part")
def slug_id(part):
    return part.select("p_partkey", slug("p_name").alias("slug"), canonical_id("p_brand", "p_name").alias("canonical_id"))


@query("""
SELECT p_partkey, p_size::DOUBLE AS number, CASE WHEN p_partkey % 3 = 0 THEN 'mm' WHEN p_partkey % 3 = 1 THEN 'mAh' END AS unit FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_size END AS p_size FROM part)
""", "part")
def numeric_unit_split(part):
    text = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, " mm").when(F.col("p_partkey") % 3 == 1, "mAh").otherwise(" mm x 3"))
    number, unit = number_and_unit(text)
    return part.select("p_partkey", number.alias("number"), unit.alias("unit"))


@query("""
SELECT p_partkey, CASE WHEN p_type LIKE 'ECO%' THEN 'battery_protection' WHEN p_size > 40 THEN 'battery' WHEN p_name LIKE '%green%' OR p_name LIKE '%blue%' THEN 'driver' ELSE 'unclassified' END AS component_key,
  CASE WHEN contains(lower(p_name), 'small') THEN 'in_ear' WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'widget') THEN 'over_ear' ELSE 'unknown' END AS form FROM part
""", "part")
def rule_cascade_case(part):
    key = first_rule([(F.col("p_type").startswith("ECO"), "battery_protection"), (F.col("p_size") > 40, "battery"), (F.contains("p_name", F.lit("green")) | F.contains("p_name", F.lit("blue")), "driver")], "unclassified")
    return part.select("p_partkey", key.alias("component_key"), marker_rules(F.lower("p_name"), [(["small"], "in_ear"), (["ring", "widget"], "over_ear")], "unknown").alias("form"))


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS best FROM orders GROUP BY 1)
SELECT c_custkey, round_even(((nullif(trim(c_name), '') IS NOT NULL)::INT + (c_acctbal >= 0)::INT + (n IS NOT NULL)::INT + (best > 100000 AND best IS NOT NULL)::INT) / 4.0, 3) AS completeness FROM customer LEFT JOIN o ON c_custkey = o_custkey
""", "customer", "orders")
def completeness_score(customer, orders):
    per = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("best"))
    held = customer.join(per, customer.c_custkey == per.o_custkey, "left")
    filled = [blank_to_null("c_name").isNotNull(), F.col("c_acctbal") >= 0, F.col("n").isNotNull(), F.coalesce(F.col("best") > 100000, F.lit(False))]
    score = sum((F.when(c, 1).otherwise(0) for c in filled[1:]), F.when(filled[0], 1).otherwise(0))
    return held.select("c_custkey", F.bround(score / F.lit(4.0), 3).alias("completeness"))


_PRICE_SQL = """
WITH ch AS (SELECT l_partkey, min(round(l_extendedprice * 100)::BIGINT) AS channel FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT p_partkey, coalesce(CASE WHEN p_size % 4 = 0 THEN round(p_retailprice * 100)::BIGINT END, CASE WHEN p_size % 4 = 1 THEN round(p_retailprice * 90)::BIGINT END, channel) AS price_cents,
  CASE WHEN p_size % 4 = 0 THEN 'official_msrp' WHEN p_size % 4 = 1 THEN 'official' WHEN channel IS NOT NULL THEN 'channel' ELSE 'unpriced' END AS price_layer FROM part LEFT JOIN ch ON p_partkey = l_partkey
"""


@query(_PRICE_SQL, "part", "lineitem")
def cost_precedence_price(part, lineitem):
    """The price by layer: official list price, official price, channel price; the layer is named."""
    channel = lineitem.filter("l_returnflag <> 'R'").groupBy("l_partkey").agg(F.min(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("channel"))
    held = part.join(channel, part.p_partkey == channel.l_partkey, "left")
    msrp = F.when(F.col("p_size") % 4 == 0, F.round(F.col("p_retailprice") * 100).cast("long"))
    official = F.when(F.col("p_size") % 4 == 1, F.round(F.col("p_retailprice") * 90).cast("long"))
    layer = first_rule([(msrp.isNotNull(), "official_msrp"), (official.isNotNull(), "official"), (F.col("channel").isNotNull(), "channel")], "unpriced")
    return held.select("p_partkey", F.coalesce(msrp, official, "channel").alias("price_cents"), layer.alias("price_layer"))


@query("""
SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey))
WHERE n <= 20 OR list_contains(list_transform(range(20), lambda i: floor(i * (n - 1) / 19 + 0.5)::BIGINT), place)
""", "orders")
def sample_even_spaced(orders):
    """A sampling operator: twenty orders of each priority at even distances."""
    return R.even_sample(orders.select("o_orderpriority", "o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], 20, ["o_orderpriority"]).drop("o_orderdate")


@query("""
SELECT p_partkey, name AS parameter, value FROM (SELECT p_partkey, p_brand AS brand, p_type AS type, p_size::VARCHAR AS size FROM part) UNPIVOT (value FOR name IN (brand, type, size))
""", "part")
def compare_unpivot(part):
    wide = part.select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size"))
    return wide.unpivot("p_partkey", ["brand", "type", "size"], "parameter", "value")


_BRANDS = [f"Brand#{n}" for n in range(1, 26)]


@query(f"""
WITH u AS (SELECT p_brand, name, value FROM (SELECT p_brand, max(p_type) AS top_type, max(p_size)::VARCHAR AS max_size, count(*)::VARCHAR AS parts FROM part GROUP BY 1) UNPIVOT (value FOR name IN (top_type, max_size, parts)))
SELECT name AS parameter, {", ".join(f"max(value) FILTER (p_brand = '{b}') AS b{b[6:]}" for b in _BRANDS)} FROM u GROUP BY 1
""", "part")
def compare_transpose(part):
    """Parameters as rows, all brands as columns: they are a fixed list, so that the result's columns are known before it is computed."""
    per = part.groupBy("p_brand").agg(F.max("p_type").alias("top_type"), F.max("p_size").cast("string").alias("max_size"), F.count("*").cast("string").alias("parts"))
    long = per.unpivot("p_brand", ["top_type", "max_size", "parts"], "parameter", "value")
    wide = long.groupBy("parameter").pivot("p_brand", _BRANDS).agg(F.max("value"))
    return wide.select("parameter", *(F.col(f"`{b}`").alias(f"b{b[6:]}") for b in _BRANDS))


@query("""
SELECT conv_id, turn, coalesce(nullif(trim(CASE WHEN turn % 3 = 0 THEN ' ' ELSE text END), ''), nullif(trim(role), ''), '') AS title, CASE WHEN length(text) > 180 THEN substr(text, 1, 180) || '…' ELSE text END AS quote FROM conversations
""", "conversations")
def first_nonblank_chain(conversations):
    title = F.when(F.col("turn") % 3 == 0, " ").otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", first_nonblank(title, "role").alias("title"), quoted("text").alias("quote"))


@query("""
SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed, md5(regexp_replace(lower(text), '[^0-9a-z]+', '', 'g')) AS identity FROM documents
""", "documents")
def normalize_ws_alnum(documents):
    return documents.select("doc_id", collapse_spaces("text").alias("collapsed"), F.md5(identity_key("text")).alias("identity"))
