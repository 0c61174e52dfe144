"""Queries on product records: candidate filters, selections, snapshot merges, title reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from partledger.functions.text import first_rule, identity_key
from partledger.operators import products as P
from partledger.sources.shared import written
from partledger.sources.tables import FEW_TASKS, LINES_A_TASK, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str, *names: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))
        ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return keep


@query("""
SELECT doc_id, regexp_matches(text, '[0-9]{2}') AND (contains(lower(text), 'the') OR contains(lower(text), 'der')) AS roundup, CASE WHEN lang = 'en' THEN regexp_matches(lower(text), 'battery|cell|tion') ELSE trim(text) <> '' AND trim(source) <> '' END AS supported,
  NOT contains(text, 'http') AND length(text) <= 2200 AND regexp_matches(lower(text), 'board|chip|ing') AS concrete, source IN ('src1', 'src2') OR source LIKE 'src1%' AS automatic, regexp_matches(lower(text), 'box|pack|oth') AS packaging,
  len(regexp_extract_all(text, '[0-9]+')) >= 2 AS technical, CASE WHEN contains(lower(text), 'password') THEN 'guide' WHEN contains(lower(text), 'license') THEN 'notice' ELSE 'article' END AS kind, regexp_full_match(source, '[a-z]{3}[0-9]{1,3}') AS valid_source FROM documents
""", "documents")
def candidate_predicates(documents):
    """The predicates that pick texts for work: round-ups, supported evidence, concrete parts, automatic sources, packaging and technical
    texts, kinds, well-formed names. One projection; nothing is shuffled."""
    low = F.lower("text")
    return documents.select(
        "doc_id",
        (F.rlike("text", F.lit("[0-9]{2}")) & P.any_marker(low, ["the", "der"])).alias("roundup"),
        F.when(F.col("lang") == "en", F.rlike(low, F.lit("battery|cell|tion"))).otherwise((F.trim("text") != "") & (F.trim("source") != "")).alias("supported"),
        (~F.contains("text", F.lit("http")) & (F.length("text") <= 2200) & F.rlike(low, F.lit("board|chip|ing"))).alias("concrete"),
        (F.col("source").isin("src1", "src2") | F.startswith("source", F.lit("src1"))).alias("automatic"),
        F.rlike(low, F.lit("box|pack|oth")).alias("packaging"),
        (F.regexp_count("text", F.lit("[0-9]+")) >= 2).alias("technical"),
        first_rule([(F.contains(low, F.lit("password")), "guide"), (F.contains(low, F.lit("license")), "notice")], "article").alias("kind"),
        F.rlike("source", F.lit("^[a-z]{3}[0-9]{1,3}$")).alias("valid_source"),
    )


@query("""
SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('purchase', 'signup') AND value >= 30 AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 3
""", "events")
def published_facts(events):
    """Facts that are shown: of a status, not for review, important enough."""
    weight = F.get_json_object("props", "$.k").try_cast("long")
    return events.filter(F.col("event_type").isin("purchase", "signup") & (F.col("value") >= 30) & (weight >= 3)).select("event_id", "user_id", "event_type")


@query("""
SELECT p_partkey, p_name, p_partkey % 13 = 1 AS related FROM part WHERE p_partkey % 13 <> 0
""", "part")
def override_exclusion(part):
    overrides = part.filter("p_partkey % 13 in (0, 1)").select("p_partkey", F.when(F.col("p_partkey") % 13 == 0, "exclude").otherwise("related_only").alias("action"))
    return P.without_excluded(part.select("p_partkey", "p_name"), overrides, "p_partkey")


@query("""
WITH priced AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.09 AND l_returnflag = 'N'), r AS (SELECT l_partkey, min(l_shipdate)::DATE AS first_seen FROM lineitem GROUP BY 1)
SELECT p_partkey, CASE WHEN p_size > 40 THEN 0 WHEN p_size > 20 THEN 1 ELSE 2 END::INT AS priority, first_seen FROM part JOIN r ON p_partkey = l_partkey WHERE p_size > 5 AND p_partkey NOT IN (SELECT l_partkey FROM priced)
""", "part", "lineitem")
def unpriced_candidates(part, lineitem):
    """Products of a priority without a price, with evidence, in the order of work."""
    priced = lineitem.filter("l_discount > 0.09 and l_returnflag = 'N'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    seen = lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.to_date(F.min("l_shipdate")).alias("first_seen"))
    held = part.filter("p_size > 5").join(seen, "p_partkey").join(priced, "p_partkey", "left_anti")
    return held.select("p_partkey", F.when(F.col("p_size") > 40, 0).when(F.col("p_size") > 20, 1).otherwise(2).alias("priority"), "first_seen").orderBy("priority", "first_seen", "p_partkey")


@query("""
WITH s AS (SELECT o_custkey, min(o_orderdate)::DATE AS first_seen FROM orders GROUP BY 1)
SELECT c_custkey, first_seen FROM customer JOIN s ON c_custkey = o_custkey WHERE first_seen >= DATE '1992-06-01' AND c_custkey % 3 <> 0
""", "customer", "orders")
def launch_date_candidates(customer, orders):
    """Recent products with evidence and without a launch date yet, latest first."""
    seen = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.min("o_orderdate")).alias("first_seen"))
    dated = customer.filter("c_custkey % 3 = 0").select("c_custkey")
    return customer.select("c_custkey").join(seen.filter("first_seen >= date'1992-06-01'"), "c_custkey").join(dated, "c_custkey", "left_anti").orderBy(F.desc("first_seen"), F.desc("c_custkey"))


@query("""
SELECT p_partkey, length(p_name) < 8 OR regexp_matches(p_name, '^[a-z]+ [a-z]+$') AND p_size % 2 = 0 OR trim(p_brand) = '' AS repair FROM part
""", "part")
def identity_repair_candidates(part):
    odd = (F.length("p_name") < 8) | (F.rlike("p_name", F.lit("^[a-z]+ [a-z]+$")) & (F.col("p_size") % 2 == 0)) | (F.trim("p_brand") == "")
    return part.select("p_partkey", odd.alias("repair"))


@query("""
SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') OR event_type = 'signup'
""", "events", "customer")
def priority_assets(events, customer):
    """Assets of listed owners, and those of a kind that always counts."""
    keys = customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return P.in_keys_or_kind(events.select("event_id", "user_id", "event_type"), keys, "user_id", F.col("event_type") == "signup")


@query("""
SELECT o_orderkey, o_custkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS "primary", count(*) OVER (PARTITION BY o_custkey) > 1 AS has_other FROM orders
""", "orders")
def primary_lookup(orders):
    return P.other_primary(orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderkey", [F.col("o_orderdate")]).drop("o_orderdate")


@query("""
SELECT p_partkey, concat_ws(' · ', CASE WHEN p_size % 2 = 0 THEN 'official' END, CASE WHEN p_size % 3 = 0 THEN 'channel' END, CASE WHEN p_type LIKE 'PROMO%' THEN 'promo' END) AS badges,
  CASE WHEN p_size % 5 <> 0 THEN 'img/' || p_partkey WHEN p_size % 7 <> 0 THEN 'alt/' || p_partkey END AS evidence_image FROM part
""", "part")
def layer_badges(part):
    """The layers that have something, joined; the first image that has an address."""
    layers = [("official", F.col("p_size") % 2 == 0), ("channel", F.col("p_size") % 3 == 0), ("promo", F.startswith("p_type", F.lit("PROMO")))]
    key = F.col("p_partkey").cast("string")
    images = F.array(F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("img/"), key)), F.lit(""), F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("alt/"), key)))
    first = F.try_element_at(F.filter(images, lambda u: u.isNotNull() & (u != "")), F.lit(1))
    return part.select("p_partkey", F.concat_ws(" · ", *(F.when(c, F.lit(n)) for n, c in layers)).alias("badges"), first.alias("evidence_image"))


@query("""
WITH r AS (SELECT DISTINCT l_partkey, 'order' AS kind, l_orderkey AS ref FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT DISTINCT l_partkey, 'supplier', l_suppkey FROM lineitem WHERE l_returnflag = 'A'),
t AS (SELECT l_partkey, kind, ref, CASE kind WHEN 'order' THEN o_orderstatus ELSE CASE WHEN s_suppkey % 10 <> 0 THEN s_name END END AS title FROM r LEFT JOIN orders ON kind = 'order' AND o_orderkey = ref LEFT JOIN supplier ON kind = 'supplier' AND s_suppkey = ref)
SELECT l_partkey, kind, count(*) AS refs, md5(string_agg(coalesce(title, ref::VARCHAR), ';' ORDER BY ref)) AS digest FROM t GROUP BY 1, 2
""", "lineitem", "orders", "supplier")
def related_intelligence(lineitem, orders, supplier):
    """References of two kinds with their titles; one whose source is missing keeps its id as title."""
    a = lineitem.filter("l_returnflag = 'R'").select("l_partkey", F.lit("order").alias("kind"), F.col("l_orderkey").alias("ref")).distinct().join(orders.select(F.col("o_orderkey").alias("ref"), F.col("o_orderstatus").alias("title")), "ref", "left")
    known = supplier.filter("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("ref"), F.col("s_name").alias("title"))
    b = lineitem.filter("l_returnflag = 'A'").select("l_partkey", F.lit("supplier").alias("kind"), F.col("l_suppkey").alias("ref")).distinct().join(known, "ref", "left")
    both = a.unionByName(b).withColumn("title", F.coalesce("title", F.col("ref").cast("string")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref", "title"))), lambda s: s["title"]), ";")
    return both.groupBy("l_partkey", "kind").agg(F.count("*").alias("refs"), F.md5(listed).alias("digest"))


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 2 ELSE 1 END + CASE WHEN o_totalprice > 150000 THEN 3 ELSE 0 END - CASE WHEN o_orderpriority LIKE '5%' THEN 5 ELSE 0 END AS score FROM orders)
SELECT o_custkey, o_orderkey, score::INT AS score FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) = 1
""", "orders")
def card_image_pick(orders):
    """The picture of a card: its section's base, plus and minus what its description earns."""
    base = F.when(F.col("o_orderstatus") == "F", 4).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    rules = [(F.col("o_totalprice") > 150_000, 3), (F.startswith("o_orderpriority", F.lit("5")), -5)]
    return P.best_scored(orders, ["o_custkey"], "o_orderkey", rules, base)


@query("""
WITH s AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2), g AS (SELECT conv_id, turn, (CASE WHEN contains(lower(text), 'the') THEN 2 ELSE 0 END + CASE WHEN contains(text, '?') THEN 1 ELSE 0 END) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score >= 2 DESC, CASE WHEN score >= 2 THEN -score END, turn) AS k FROM g)
SELECT conv_id, turn, score::INT AS score FROM r WHERE score >= 2 AND k <= 5 OR score < 2 AND k <= 3
""", "conversations")
def key_image_selection(conversations):
    """Up to five that score well; where fewer than three do, the earliest others fill up."""
    s = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    score = F.when(F.contains(F.lower("text"), F.lit("the")), 2).otherwise(0) + F.when(F.contains("text", F.lit("?")), 1).otherwise(0)
    return P.scored_with_fill(s, "conv_id", "turn", score, 2, 5, 3).select("conv_id", "turn", "score")


@query("""
WITH o AS (SELECT o_custkey, max(o_orderpriority) AS p, max(CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END) AS f FROM orders GROUP BY 1)
SELECT c_custkey, ((trim(c_name) <> '')::INT + (c_acctbal IS NOT NULL)::INT + (p IS NOT NULL)::INT + (f IS NOT NULL)::INT)::BIGINT AS filled FROM customer LEFT JOIN o ON c_custkey = o_custkey ORDER BY filled DESC, c_custkey LIMIT 4
""", "customer", "orders")
def default_compare_selection(customer, orders):
    """The four fullest rows: the number is the feature."""
    per = orders.groupBy("o_custkey").agg(F.max("o_orderpriority").alias("p"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus"))).alias("f"))
    held = customer.join(per, customer.c_custkey == per.o_custkey, "left")
    return P.best_filled(held, ["c_name", "c_acctbal", "p", "f"], "c_custkey", 4).select("c_custkey", "filled")


@query("""
SELECT o_orderkey, o_custkey, 'runtime' AS origin FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, o_custkey, 'release' FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 4 <> 0
""", "orders")
def runtime_evidence(orders):
    """Child rows of a release replace the current ones; what was found at run time stays."""
    current = orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderstatus") == "P", "runtime").otherwise("old").alias("origin"))
    release = orders.filter("o_orderkey % 4 <> 0").select("o_orderkey", "o_custkey", F.lit("release").alias("origin"))
    return P.replaced_children(current, release, "o_orderkey", F.col("o_orderstatus") == "P").select("o_orderkey", "o_custkey", "origin")


_PROFILE = """
WITH pr(profile, category, level, parameter) AS (VALUES ('small', 'PROMO', 'p0', 'size'), ('small', 'PROMO', 'p1', 'type'), ('large', 'ECONOMY', 'p0', 'price'), ('large', 'STANDARD', 'p0', 'price'), ('large', 'STANDARD', 'p1', 'size'))
SELECT p_partkey, profile, level, parameter, CASE parameter WHEN 'size' THEN p_size > 10 WHEN 'price' THEN p_retailprice > 1000 ELSE true END AS applies FROM part JOIN pr ON split_part(p_type, ' ', 1) = category
"""


@query(_PROFILE, "part")
def compare_profile_parameters(part):
    """The parameters that a category's profile compares, and whether each applies to the product."""
    rows = [("small", "PROMO", "p0", "size"), ("small", "PROMO", "p1", "type"), ("large", "ECONOMY", "p0", "price"), ("large", "STANDARD", "p0", "price"), ("large", "STANDARD", "p1", "size")]
    profiles = part.sparkSession.createDataFrame(rows, "profile string, category string, level string, parameter string")
    held = part.withColumn("category", F.split_part("p_type", F.lit(" "), F.lit(1))).join(F.broadcast(profiles), "category")  # a fixed, small table
    applies = F.when(F.col("parameter") == "size", F.col("p_size") > 10).when(F.col("parameter") == "price", F.col("p_retailprice") > 1000).otherwise(F.lit(True))
    return held.select("p_partkey", "profile", "level", "parameter", applies.alias("applies"))


_INVENTORY_SQL = r"""
WITH base AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, l_partkey, l_suppkey, p_type, p_size, p_name, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey),
i AS (SELECT k, ord, p_type AS component, CASE p_size % 4 WHEN 0 THEN 'battery' WHEN 1 THEN 'chip' WHEN 2 THEN 'driver' ELSE 'other' END AS family, CASE l_returnflag WHEN 'A' THEN 'left' WHEN 'R' THEN 'case' ELSE '' END AS side,
  CASE WHEN p_size % 4 = 1 THEN 'AB' || (p_size // 10) || CASE WHEN l_suppkey % 2 = 0 THEN 'X' ELSE '' END WHEN p_size % 4 = 2 THEN 'Q-' || (l_partkey % 50) ELSE '' END AS model, CASE WHEN p_size % 5 = 0 THEN 'seen at ' || (p_size % 3) ELSE '' END AS evidence FROM base),
m AS (SELECT *, regexp_replace(upper(model), '[^A-Z0-9]', '', 'g') AS mm, regexp_replace(evidence, '\s+', '', 'g') AS said FROM i),
n AS (SELECT *, CASE WHEN mm <> '' THEN 'm:' || mm ELSE 'c:' || regexp_replace(component, '\s+', '', 'g') || ':' || side END AS ident, coalesce(regexp_extract_all(upper(model), '[A-Z]{1,8}[0-9]+[A-Z0-9-]*')[-1], mm) AS token FROM m),
d AS (SELECT * FROM n WHERE ord <= 2 QUALIFY row_number() OVER (PARTITION BY k, ident ORDER BY ord) = 1),
r AS (SELECT * FROM n WHERE ord > 2 AND component NOT LIKE 'PROMO%' AND NOT EXISTS (SELECT 1 FROM d WHERE d.k = n.k AND d.ident = n.ident) AND NOT EXISTS (SELECT 1 FROM d WHERE d.k = n.k AND d.said = n.said AND d.said <> '')
  AND NOT EXISTS (SELECT 1 FROM d WHERE d.k = n.k AND d.family = n.family AND d.family IN ('battery', 'driver') AND (d.side = '' OR n.side = '' OR d.side = n.side))
  AND NOT EXISTS (SELECT 1 FROM d WHERE d.k = n.k AND d.family = 'chip' AND n.family = 'chip' AND d.token <> '' AND n.token <> '' AND (starts_with(d.token, n.token) OR starts_with(n.token, d.token)))),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY k, ident ORDER BY ord) = 1),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY k, CASE WHEN said <> '' THEN said ELSE '#' || ord END ORDER BY ord) = 1)
SELECT k, ord AS "order", component, family, side, model, 'detailed' AS kind FROM d UNION ALL SELECT k, ord, component, family, side, model, 'coarse' FROM b
"""


@query(_INVENTORY_SQL, "lineitem", "part")
def cost_inventory_merge(lineitem, part):
    """Parts lists of products from detailed and coarse evidence: an order stands for a product, its first two lines are detailed."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    tasks = tasks if (tasks := -(-lineitem.count() // LINES_A_TASK)) > FEW_TASKS else 0
    lines = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    lines = lines.repartition(tasks, "l_orderkey") if tasks else lines
    base = lines.withColumn("order", place).join(part.select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size"), "l_partkey")
    fourth = F.col("p_size") % 4
    model = F.when(fourth == 1, F.concat(F.lit("AB"), F.floor(F.col("p_size") / 10).cast("string"), F.when(F.col("l_suppkey") % 2 == 0, "X").otherwise(""))).when(fourth == 2, F.concat(F.lit("Q-"), (F.col("l_partkey") % 50).cast("string"))).otherwise("")
    rows = base.select(
        F.col("l_orderkey").alias("k"), "order", F.col("p_type").alias("component"), F.when(fourth == 0, "battery").when(fourth == 1, "chip").when(fourth == 2, "driver").otherwise("other").alias("family"),
        F.when(F.col("l_returnflag") == "A", "left").when(F.col("l_returnflag") == "R", "case").otherwise("").alias("side"), model.alias("model"),
        F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("seen at "), (F.col("p_size") % 3).cast("string"))).otherwise("").alias("evidence"),
    )
    rows = written(rows, "inventory")  # else lines would be numbered anew for each join
    return P.merged_inventory(rows.filter("order <= 2"), rows.filter("order > 2"), ["k"], ("battery", "driver"), ~F.startswith("component", F.lit("PROMO")), tasks)


@query("""
WITH m AS (SELECT l_partkey, l_orderkey AS source, count(*) AS score FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), o AS (SELECT l_partkey, l_suppkey AS source, count(*) - 1 AS score FROM lineitem GROUP BY 1, 2),
a AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, source) = 1), b AS (SELECT * FROM o WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, source) = 1)
SELECT l_partkey, 'main' AS kind, source, score FROM a UNION ALL SELECT l_partkey, 'other', source, score FROM b WHERE l_partkey NOT IN (SELECT l_partkey FROM a)
""", "lineitem")
def market_snapshot_source(lineitem):
    """The best report of each product however sparse it is; a video only where there is no report, and only if it scores."""
    main = lineitem.filter("l_returnflag = 'R'").groupBy("l_partkey", F.col("l_orderkey").alias("source")).agg(F.count("*").alias("score"))
    other = lineitem.groupBy("l_partkey", F.col("l_suppkey").alias("source")).agg((F.count("*") - 1).alias("score"))
    return P.source_or_fallback(main, other, "l_partkey", "score", "source").select("l_partkey", "kind", "source", "score")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, (o_orderkey % 3) + (o_orderkey % 5) AS score FROM orders), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) = 1),
m AS (SELECT b.*, (o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT + (o_orderkey % 5 = 0)::INT AS filled FROM b)
SELECT o_custkey, o_orderkey, filled::BIGINT AS filled, round_even(filled / 3.0, 2) AS completeness, concat_ws(';', CASE WHEN o_orderkey % 2 <> 0 THEN 'packaging' END, CASE WHEN o_orderkey % 3 <> 0 THEN 'case' END, CASE WHEN o_orderkey % 5 <> 0 THEN 'earbuds' END) AS gaps FROM m
""", "orders")
def unboxing_snapshot(orders):
    """The fullest unboxing of each product, how many of its three modules have pictures, and which have none."""
    key = F.col("o_orderkey")
    best = P.best_scored(orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", [], key % 3 + key % 5)
    modules = {"packaging": key % 2 == 0, "case": key % 3 == 0, "earbuds": key % 5 == 0}
    filled = sum((F.when(c, 1).otherwise(0) for c in modules.values()), F.lit(0)).cast("long")
    return best.select("o_custkey", "o_orderkey", filled.alias("filled"), F.bround(filled / F.lit(3.0), 2).alias("completeness"), F.concat_ws(";", *(F.when(~c, F.lit(n)) for n, c in modules.items())).alias("gaps"))


@query("""
WITH f AS (SELECT l_partkey, arg_max('v' || l_suppkey, (l_tax, 'v' || l_suppkey)) AS value, max(l_tax) AS confidence FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT p_partkey, CASE WHEN f.confidence > coalesce(own, 0) THEN f.value ELSE base END AS value, CASE WHEN f.confidence > coalesce(own, 0) THEN f.confidence ELSE own END AS confidence, coalesce(f.confidence > coalesce(own, 0), false) AS overlaid
FROM (SELECT p_partkey, p_brand AS base, CASE WHEN p_size % 6 <> 0 THEN (p_size % 9) / 100.0::DOUBLE END AS own FROM part) LEFT JOIN f ON p_partkey = l_partkey
""", "part", "lineitem")
def ocr_merge(part, lineitem):
    """Values read from pictures win only where they are strictly surer."""
    base = part.select("p_partkey", F.col("p_brand").alias("value"), F.when(F.col("p_size") % 6 != 0, (F.col("p_size") % 9) / F.lit(100.0)).alias("confidence"))
    found = lineitem.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("p_partkey"), F.concat(F.lit("v"), F.col("l_suppkey").cast("string")).alias("value"), F.col("l_tax").alias("confidence"))
    return P.overlaid_if_surer(base, found, ["p_partkey"], "value", "confidence")


@query("""
WITH a AS (SELECT l_orderkey, p_type AS label, l_linenumber::BIGINT AS n, 0 AS layer, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, lower(p_type), l_linenumber::BIGINT, 1, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R'),
b AS (SELECT l_orderkey, lower(label) AS same, min((layer, n)) AS first FROM a GROUP BY 1, 2), c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY first, same) AS place FROM b)
SELECT l_orderkey, same, place FROM c WHERE place <= 7
""", "lineitem", "part")
def parameter_merge(lineitem, part):
    """Parameters of two layers by label, the first layer's before the second's, seven at most."""
    rows = lineitem.join(part, lineitem.l_partkey == part.p_partkey).select("l_orderkey", F.col("p_type").alias("label"), F.struct(F.col("l_linenumber").cast("long").alias("n"), F.lower("p_type").alias("l")).alias("n"), "l_returnflag")
    main, other = rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag <> 'R'").withColumn("label", F.lower("label"))
    return P.united_by_label([main, other], ["l_orderkey"], "label", "n", 7).select("l_orderkey", F.lower("label").alias("same"), "place")


@query("""
SELECT lower(p_name) AS alias, p_brand AS canonical FROM (SELECT DISTINCT p_name, min(p_brand) OVER (PARTITION BY p_name) AS p_brand FROM part) WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size = 7)
UNION ALL SELECT DISTINCT upper(p_name), 'reviewed' FROM part WHERE p_size = 7
""", "part")
def alias_overlay(part):
    """A reviewed dictionary over a base one: what it claims leaves the base."""
    base = part.groupBy(F.lower("p_name").alias("alias")).agg(F.min("p_brand").alias("canonical"))
    reviewed = part.filter("p_size = 7").select(F.upper("p_name").alias("alias"), F.lit("reviewed").alias("canonical")).distinct()
    return P.claimed_aliases(base, reviewed)


_TITLE_SQL = """
WITH t AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Teardown: ' WHEN 1 THEN 'Video: ' ELSE '' END || p_brand || ' ' || p_name || CASE p_size % 4 WHEN 0 THEN ' wireless earbuds' WHEN 1 THEN ' earbuds' ELSE '' END AS title FROM part),
a AS (SELECT *, CASE WHEN starts_with(title, 'Teardown:') THEN 'report' WHEN starts_with(title, 'Video:') THEN 'video' ELSE 'other' END AS kind, CASE WHEN contains(lower(title), 'earbuds') THEN 'in_ear' WHEN contains(lower(title), 'ring') THEN 'ring' ELSE 'unknown' END AS category FROM t),
b AS (SELECT *, trim(CASE kind WHEN 'report' THEN substr(title, 10) WHEN 'video' THEN substr(title, 7) ELSE title END) AS r FROM a), c AS (SELECT *, trim(regexp_replace(r, '(?i)( wireless earbuds| earbuds)$', '')) AS rest FROM b),
d AS (SELECT *, CASE WHEN contains(lower(rest), 'brand#11') THEN 'First' WHEN contains(lower(rest), 'brand#1') THEN 'Ones' ELSE '' END AS brand FROM c)
SELECT p_partkey, kind, category, brand, CASE WHEN starts_with(lower(rest), 'brand#11') THEN trim(substr(rest, 9)) WHEN starts_with(lower(rest), 'brand#1') THEN trim(substr(rest, 8)) ELSE rest END AS model FROM d
"""


@query(_TITLE_SQL, "part")
def title_parse(part):
    """Kind, category, brand and model from made-up titles."""
    begin = F.when(F.col("p_size") % 3 == 0, "Teardown: ").when(F.col("p_size") % 3 == 1, "Video: ").otherwise("")
    end = F.when(F.col("p_size") % 4 == 0, " wireless earbuds").when(F.col("p_size") % 4 == 1, " earbuds").otherwise("")
    titles = part.select("p_partkey", F.concat(begin, "p_brand", F.lit(" "), "p_name", end).alias("title"))
    said = P.parsed_title(F.col("title"), [("Teardown:", "report"), ("Video:", "video")], [(["earbuds"], "in_ear"), (["ring"], "ring")], [("brand#11", "First"), ("brand#1", "Ones")], [" wireless earbuds", " earbuds"])
    return titles.select("p_partkey", *(c.alias(n) for n, c in said.items()))


_SAME_SQL = """
WITH t AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) || '!' WHEN 1 THEN p_name || ' x' WHEN 2 THEN substr(p_name, 1, 4) WHEN 3 THEN reverse(p_name) ELSE replace(p_name, 'e', 'i') END AS b FROM part),
k AS (SELECT p_partkey, regexp_replace(lower(a), '[^0-9a-z]+', '', 'g') AS x, regexp_replace(lower(b), '[^0-9a-z]+', '', 'g') AS y FROM t)
SELECT p_partkey, least(length(x), length(y)) > 0 AND (x = y OR (contains(x, y) OR contains(y, x)) AND least(length(x), length(y)) >= 0.68 * greatest(length(x), length(y)) OR greatest(length(x), length(y)) - levenshtein(x, y) >= 0.76 * greatest(length(x), length(y))) AS same FROM k
"""


@query(_SAME_SQL, "part")
def text_sameness(part):
    fifth, name = F.col("p_partkey") % 5, F.col("p_name")
    other = F.when(fifth == 0, F.concat(F.upper(name), F.lit("!"))).when(fifth == 1, F.concat(name, F.lit(" x"))).when(fifth == 2, F.substring(name, 1, 4)).when(fifth == 3, F.reverse(name)).otherwise(F.replace(name, F.lit("e"), F.lit("i")))
    return part.select("p_partkey", P.same_text(name, other).alias("same"))


@query(r"""
WITH p AS (SELECT item_id, unnest(string_split_regex(text, '[.;!?\n]+')) AS c, unnest(range(len(string_split_regex(text, '[.;!?\n]+'))))::BIGINT AS pos FROM benchmark), q AS (SELECT item_id, pos, trim(c) AS clause FROM p WHERE length(trim(c)) >= 8),
s AS (SELECT *, (CASE WHEN regexp_matches(lower(clause), 'tion|ment') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(clause, '[0-9]') THEN 2 ELSE 0 END + CASE WHEN length(clause) <= 40 THEN 1 ELSE 0 END)::BIGINT AS score FROM q QUALIFY row_number() OVER (PARTITION BY item_id, lower(trim(regexp_replace(clause, '\s+', ' ', 'g'))) ORDER BY pos) = 1)
SELECT item_id, pos, clause, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos) AS rank FROM s QUALIFY rank <= 3
""", "benchmark")
def fact_bullets(benchmark):
    """The three most telling clauses of each item."""
    return P.bullets(benchmark, "item_id", "text", "tion|ment", 8, 3)


@query("""
WITH f AS (SELECT conv_id, role, text, min(turn) AS o FROM conversations GROUP BY 1, 2, 3)
SELECT conv_id, role, md5(string_agg(text, ' | ' ORDER BY o, text)) AS texts, min(o) AS first FROM f GROUP BY 1, 2
""", "conversations")
def tag_grouping(conversations):
    """Texts by tag, each once, in the order of their first place."""
    return P.grouped_texts(conversations, ["conv_id"], "role", "text", "turn").withColumn("texts", F.md5("texts"))


@query("""
WITH a AS (SELECT p_partkey AS path, md5(p_name) AS d FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 11 = 0 THEN 'other' ELSE md5(p_name) END AS d FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'copy' WHEN a.path IS NULL THEN 'only_new' WHEN a.d = b.d THEN 'same' ELSE 'conflict' END AS action FROM a FULL JOIN b ON a.path = b.path
""", "part")
def layout_migration(part):
    digest = F.md5("p_name")
    old = part.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("path"), digest.alias("d"))
    new = part.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 11 == 0, "other").otherwise(digest).alias("d"))
    return P.digest_compare(old, new, "path", "d")


@query("""
SELECT CASE WHEN p_size > 40 THEN 'high' WHEN p_size > 20 AND p_retailprice > 1000 THEN 'verified' ELSE 'low' END AS bucket, count(*) AS products, round_even(avg((p_size % 2 = 0)::INT), 4) AS even_rate, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1
""", "part")
def priority_bucket_counts(part):
    """Products of each priority, and a rate over them."""
    bucket = first_rule([(F.col("p_size") > 40, "high"), ((F.col("p_size") > 20) & (F.col("p_retailprice") > 1000), "verified")], "low")
    return part.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("products"), F.bround(F.avg(F.when(F.col("p_size") % 2 == 0, 1).otherwise(0)), 4).alias("even_rate"), F.count_distinct("p_brand").alias("brands"))


@query("""
WITH g AS (SELECT l_partkey, l_suppkey, count(DISTINCT l_shipdate::DATE) AS stamps, count(*) AS files FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, files, stamps = 1 AS consistent FROM g
""", "lineitem")
def version_consistency(lineitem):
    """Whether all files of a release bear one stamp."""
    days = lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("files"), F.min(F.to_date("l_shipdate")).alias("a"), F.max(F.to_date("l_shipdate")).alias("z"))
    return days.select("l_partkey", "l_suppkey", "files", (F.col("a") == F.col("z")).alias("consistent"))


@query("""
SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'skipped' WHEN o_totalprice >= 92000 AND c_acctbal >= 0 THEN 'publish' ELSE 'review' END AS outcome FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""", "orders", "lineitem", "customer")
def recheck_before_publish(orders, lineitem, customer):
    """What was queued is checked again before it is published: evidence may have come in meanwhile."""
    have = lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("_have", F.lit(True))
    held = orders.join(have, "o_orderkey", "left").join(customer, orders.o_custkey == customer.c_custkey, "left")
    outcome = first_rule([(F.col("_have").isNotNull(), "skipped"), ((F.col("o_totalprice") >= 92_000) & (F.col("c_acctbal") >= 0), "publish")], "review")
    return held.select("o_orderkey", outcome.alias("outcome"))


@query("""
SELECT o_custkey, o_totalprice, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_custkey DESC, o_orderkey DESC) AS place, o_orderstatus FROM orders QUALIFY place <= 10
""", "orders")
def all_keys_descending(orders):
    """A multi-key sort in which every key falls: ten of each status; every task keeps its own ten before statuses are dealt out."""
    from pyspark.sql import Window

    order = [F.desc("o_totalprice"), F.desc("o_custkey"), F.desc("o_orderkey")]
    ranked = orders.withColumn("place", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(*order))).filter(F.col("place") <= 10).withColumn("place", F.col("place").cast("long"))
    return ranked.select("o_custkey", "o_totalprice", "o_orderkey", "place", "o_orderstatus")


@query("""
SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END), ''), 'unresolved') AS source, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_retailprice END AS price FROM part
WHERE p_size % 4 = 0 OR p_size % 3 = 0 OR p_brand = 'Brand#11'
""", "part")
def unresolved_prices(part):
    """Products without a price, or with one whose source is not settled."""
    source = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand"))
    price = F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice"))
    rows = part.select("p_partkey", F.coalesce(F.nullif(F.trim(source), F.lit("")), F.lit("unresolved")).alias("source"), price.alias("price"))
    return rows.filter("price is null or source in ('unresolved', 'Brand#11')")


@query("""
WITH seen AS (SELECT p_partkey, md5(p_name) AS h FROM part WHERE p_partkey % 4 = 0)
SELECT p_partkey, md5(p_name || CASE WHEN p_partkey % 8 = 0 THEN '!' ELSE '' END) AS h FROM part p WHERE p_size % 4 <> 3 AND (p_partkey, md5(p_name || CASE WHEN p_partkey % 8 = 0 THEN '!' ELSE '' END)) NOT IN (SELECT (p_partkey, h) FROM seen)
""", "part")
def missing_manufacturer_candidates(part):
    """Rows that still need work: those that were seen with the same content are skipped."""
    from partledger.operators.records import changed_rows

    rows = part.filter("p_size % 4 <> 3").select("p_partkey", F.md5(F.concat("p_name", F.when(F.col("p_partkey") % 8 == 0, "!").otherwise(""))).alias("h"))
    return changed_rows(rows, part.filter("p_partkey % 4 = 0").select("p_partkey", F.md5("p_name").alias("h")), "p_partkey", "h")


@query("""
WITH c AS (SELECT l_orderkey, l_partkey, 1.0 * (p_brand = 'Brand#11')::INT + 0.5 * (p_size > 25)::INT + 0.5 * contains(p_name, 'ring')::INT AS score FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_partkey, score::DOUBLE AS score FROM c WHERE score >= 1.0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey) = 1
""", "lineitem", "part")
def official_link_ranking(lineitem, part):
    """The best link candidate of each row, if it scores 1 or more. Scores are counted in halves."""
    held = lineitem.select("l_orderkey", "l_partkey").join(part, lineitem.l_partkey == part.p_partkey)
    rules = [(F.col("p_brand") == "Brand#11", 2), (F.col("p_size") > 25, 1), (F.contains("p_name", F.lit("ring")), 1)]
    return P.best_scored(held, ["l_orderkey"], "l_partkey", rules, F.lit(0), 2).withColumn("score", F.col("score") / 2.0)


@query("""
SELECT o_orderkey::VARCHAR AS report_id, coalesce(c_custkey, -1) AS product_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 6 <> 0
""", "orders", "customer")
def report_product_resolution(orders, customer):
    known = customer.filter("c_custkey % 6 <> 0").select("c_custkey")
    held = orders.join(known, orders.o_custkey == known.c_custkey, "left")
    return held.select(F.col("o_orderkey").cast("string").alias("report_id"), F.coalesce("c_custkey", F.lit(-1)).alias("product_id"))


@query("""
SELECT conv_id, turn, list_aggregate(list_transform(range(1, length(k)), lambda i: substr(k, i, 2)), 'string_agg', ' ') AS pairs FROM (SELECT conv_id, turn, regexp_replace(lower(min(text)), '[^0-9a-z]+', '', 'g') AS k FROM conversations GROUP BY 1, 2) WHERE length(k) > 1
""", "conversations")
def character_pairs(conversations):
    """Tokens of two characters of a text without blanks: how texts without word breaks are matched."""
    k = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text")).select("conv_id", "turn", identity_key("text").alias("k")).filter(F.length("k") > 1)
    return k.select("conv_id", "turn", F.array_join(F.transform(F.sequence(F.lit(1), F.length("k") - 1), lambda i: F.substring("k", i, F.lit(2))), " ").alias("pairs"))
