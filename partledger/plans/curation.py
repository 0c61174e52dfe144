"""Queries for reconciliation, precedence, review, guards and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from partledger.functions.text import blank_to_null, first_rule, ratio
from partledger.operators import curation as C
from partledger.operators import sequence as S
from partledger.operators.graph import shared_key_components
from partledger.sources.readers import with_overlay
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
WITH s AS (SELECT c_custkey, o_orderkey, CASE WHEN o_orderkey % 7 < 3 THEN c_custkey + 1 WHEN o_orderkey % 7 < 4 THEN c_custkey + 2 END AS target FROM customer LEFT JOIN orders ON c_custkey = o_custkey),
t AS (SELECT c_custkey, coalesce(string_agg(DISTINCT target::VARCHAR, ';' ORDER BY target::VARCHAR), '') AS targets, count(DISTINCT target) AS n, count(o_orderkey) AS sources FROM s GROUP BY 1)
SELECT c_custkey, targets, sources, CASE WHEN n = 1 THEN 'move' WHEN n > 1 THEN 'conflict' WHEN sources > 0 THEN 'retire' ELSE 'preserve' END AS action FROM t
""", "customer", "orders")
def reconciliation_plan(customer, orders):
    target = F.when(F.col("o_orderkey") % 7 < 3, F.col("c_custkey") + 1).when(F.col("o_orderkey") % 7 < 4, F.col("c_custkey") + 2)
    sources = customer.join(orders, customer.c_custkey == orders.o_custkey, "left").select("c_custkey", F.col("o_orderkey").alias("source_id"), target.cast("string").alias("target"))
    return C.reconciliation_plan(sources, "c_custkey", "target").withColumn("targets", F.array_join("targets", ";"))


@query("""
WITH a AS (SELECT p_brand AS brand, count(*) AS archived FROM part WHERE p_size > 25 GROUP BY 1), b AS (SELECT p_brand AS brand, count(*) AS analysed FROM part WHERE p_type = 'PROMO' GROUP BY 1)
SELECT brand, coalesce(archived, 0) AS archived, coalesce(analysed, 0) AS analysed FROM a FULL JOIN b USING (brand)
""", "part")
def archive_merge(part):
    a = part.filter("p_size > 25").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("archived"))
    b = part.filter("p_type = 'PROMO'").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("analysed"))
    return a.join(b, "brand", "full").fillna(0)


@query("""
SELECT ord, id, p_brand, p_partkey IS NULL AS missing FROM (VALUES (0::BIGINT, 5::BIGINT), (1, 999999999), (2, 12), (3, 3)) r(ord, id) LEFT JOIN part ON p_partkey = id
""", "part")
def cross_compare(part):
    """Requested ids in their order, with those that are missing."""
    asked = part.sparkSession.createDataFrame([(i, k) for i, k in enumerate((5, 999_999_999, 12, 3))], "ord long, id long")
    return F.broadcast(asked).join(part, F.col("p_partkey") == F.col("id"), "left").select("ord", "id", "p_brand", F.col("p_partkey").isNull().alias("missing"))


@query("""
WITH g AS (SELECT s_nationkey, list(CASE WHEN s_suppkey % 11 = 0 THEN s_name || '?' ELSE s_name END) AS members FROM supplier GROUP BY 1)
SELECT s_nationkey, len(members)::BIGINT AS members, len(list_filter(members, lambda m: contains(m, '?')))::BIGINT AS unknown, len(list_filter(members, lambda m: contains(m, '?'))) = 0 AS accepted FROM g
""", "supplier")
def supplier_alias_gate(supplier):
    """Groups of names are accepted if all their members are known; unknown ones are found by an anti-join."""
    named = supplier.select("s_nationkey", F.when(F.col("s_suppkey") % 11 == 0, F.concat("s_name", F.lit("?"))).otherwise(F.col("s_name")).alias("member"))
    known = supplier.select(F.col("s_name").alias("member"), F.lit(True).alias("known")).distinct()
    groups = named.join(known, "member", "left").groupBy("s_nationkey").agg(F.count("*").alias("members"), F.count_if(F.col("known").isNull()).alias("unknown"))
    return groups.withColumn("accepted", F.col("unknown") == 0)


@query("""
WITH RECURSIVE k AS (SELECT c_custkey AS node, 'a' || floor(c_acctbal / 4)::BIGINT AS key FROM customer UNION ALL SELECT c_custkey, 'b' || floor((c_acctbal + 2) / 4)::BIGINT FROM customer),
e AS (SELECT DISTINCT x.node AS a, y.node AS b FROM k x JOIN k y ON x.key = y.key), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS node, min(b) AS component FROM r GROUP BY a
""", "customer")
def alias_components(customer):
    """Customers joined by near balances: chains of shared keys."""
    keys = F.array(F.concat(F.lit("a"), F.floor(F.col("c_acctbal") / 4).cast("string")), F.concat(F.lit("b"), F.floor((F.col("c_acctbal") + 2) / 4).cast("string")))
    return shared_key_components(customer.select("c_custkey", F.explode(keys).alias("key")), "c_custkey", "key")


@query("""
SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_totalprice > 300000 THEN 0 ELSE 1 END, o_orderdate, o_orderkey) <= 12
""", "orders")
def sample_stratified(orders):
    """A sampling operator: twelve orders of each priority, difficult ones first."""
    return C.stratified_sample(orders, ["o_orderpriority"], F.col("o_totalprice") > 300000, [F.col("o_orderdate"), F.col("o_orderkey")], 12).select("o_orderpriority", "o_orderkey")


@query("""
SELECT c_nationkey, c_custkey, ((row_number() OVER w - 1) // 25)::BIGINT AS page, ((row_number() OVER w - 1) % 25)::BIGINT AS place FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)
""", "customer")
def review_packets(customer):
    return C.pages(customer.select("c_nationkey", "c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 25, ["c_nationkey"]).drop("c_acctbal")


@query("""
SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier
""", "customer", "orders", "part", "supplier")
def release_counts(*tables):
    one = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in zip(("customer", "orders", "part", "supplier"), tables, strict=True)]
    return one[0].unionByName(one[1]).unionByName(one[2]).unionByName(one[3])


@query("""
WITH a AS (SELECT p_brand, count(*) AS before FROM part GROUP BY 1), b AS (SELECT p_brand, count(*) AS after FROM part WHERE p_partkey % 10 > 2 GROUP BY 1)
SELECT p_brand, before, coalesce(after, 0) AS after, 100 * (before - coalesce(after, 0)) > 30 * before AS blocked FROM a LEFT JOIN b USING (p_brand)
""", "part")
def count_drop_guard(part):
    count = lambda df: df.groupBy("p_brand").agg(F.count("*").alias("n"))
    return C.drop_guard(count(part), count(part.filter("p_partkey % 10 > 2")), "p_brand", "n", 30)


@query("""
SELECT 'too_long' AS rule, count(*) FILTER (length(text) > 10000) AS found FROM documents UNION ALL SELECT 'address', count(*) FILTER (regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+')) FROM documents
UNION ALL SELECT 'secret', count(*) FILTER (contains(text, 'token = ')) FROM documents UNION ALL SELECT 'no_source', count(*) FILTER (coalesce(source, '') = '') FROM documents
""", "documents")
def boundary_scan(documents):
    rules = {"too_long": F.length("text") > 10000, "address": F.col("text").rlike("[a-z0-9.]+@[a-z0-9.]+"), "secret": F.contains("text", F.lit("token = ")), "no_source": blank_to_null("source").isNull()}
    return C.boundary_scan(documents, rules)


@query("""
SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) AS g FROM (SELECT DISTINCT l_orderkey, l_partkey, max(l_quantity) OVER (PARTITION BY l_orderkey, l_partkey) AS l_quantity FROM lineitem)) WHERE g <= 3
""", "lineitem")
def capped_union(lineitem):
    """Rows of two layers united, the surer one of equal keys kept, three for an order."""
    rows = lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    a, b = rows.filter("l_partkey % 2 = 0"), rows.filter("l_partkey % 2 = 1")
    return C.by_precedence(a.unionByName(b), ["l_orderkey", "l_partkey"], [F.desc("l_quantity"), F.col("l_partkey")], 3, ["l_orderkey"])


@query("""
SELECT p_brand, p_type, max_by(p_name, (length(p_name), p_name)) AS model, count(*) AS merged FROM part GROUP BY 1, 2
""", "part")
def longest_model(part):
    best = part.groupBy("p_brand", "p_type").agg(F.max(F.struct(F.length("p_name").alias("n"), "p_name")).alias("b"), F.count("*").alias("merged"))
    return best.select("p_brand", "p_type", F.col("b.p_name").alias("model"), "merged")


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 = 0 THEN DATE '2020-01-01' END, CASE WHEN c_acctbal > 5000 THEN DATE '2021-01-01' END, first_order, DATE '1900-01-01') AS launched,
  CASE WHEN c_custkey % 5 = 0 THEN 'official' WHEN c_acctbal > 5000 THEN 'researched' WHEN first_order IS NOT NULL THEN 'first_seen' ELSE 'unknown' END AS status
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate)::DATE AS first_order FROM orders GROUP BY 1) ON c_custkey = o_custkey
""", "customer", "orders")
def launch_fallback(customer, orders):
    first = orders.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("first_order"))
    held = customer.join(first, customer.c_custkey == first.o_custkey, "left")
    day = lambda s: F.lit(s).cast("date")
    official, researched = F.when(F.col("c_custkey") % 5 == 0, day("2020-01-01")), F.when(F.col("c_acctbal") > 5000, day("2021-01-01"))
    status = first_rule([(official.isNotNull(), "official"), (researched.isNotNull(), "researched"), (F.col("first_order").isNotNull(), "first_seen")], "unknown")
    return held.select("c_custkey", F.coalesce(official, researched, "first_order", day("1900-01-01")).alias("launched"), status.alias("status"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'reviewed' WHEN p_type IN ('SMALL', 'PROMO') THEN lower(p_type) ELSE 'pending' END AS category, CASE WHEN p_partkey % 50 = 0 THEN 'override' WHEN p_type IN ('SMALL', 'PROMO') THEN 'fixed' ELSE 'legacy' END AS status FROM part
""", "part")
def category_resolution(part):
    """A reviewed override, else a fixed category, else pending."""
    overrides = part.filter("p_partkey % 50 = 0").select("p_partkey", F.lit("reviewed").alias("override"))
    held = part.select("p_partkey", "p_type").join(overrides, "p_partkey", "left")
    fixed = F.when(F.col("p_type").isin("SMALL", "PROMO"), F.lower("p_type"))
    status = first_rule([(F.col("override").isNotNull(), "override"), (fixed.isNotNull(), "fixed")], "legacy")
    return held.select("p_partkey", F.coalesce("override", fixed, F.lit("pending")).alias("category"), status.alias("status"))


@query("""
SELECT w AS word, count(*) AS documents, sum(len(string_split(lower(text), w)) - 1)::BIGINT AS mentions FROM documents, (VALUES ('license'), ('token'), ('example.com'), ('under the')) l(w) WHERE contains(lower(text), w) GROUP BY 1
""", "documents")
def component_mentions(documents):
    return C.lexicon_mentions(documents, "text", ["license", "token", "example.com", "under the"])


@query("""
SELECT doc_id, len(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9]+\\.[a-z.]+'))::BIGINT AS addresses, coalesce(nullif(regexp_extract(text, '([0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3})', 1), ''), '') AS first_ip,
  regexp_extract(text, 'version ([0-9]+(?:\\.[0-9]+)?)', 1) AS version FROM documents
""", "documents")
def spec_extraction(documents):
    return documents.select(
        "doc_id", F.regexp_count("text", F.lit(r"[a-z0-9.]+@[a-z0-9]+\.[a-z.]+")).cast("long").alias("addresses"),
        F.regexp_extract("text", r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})", 1).alias("first_ip"), F.regexp_extract("text", r"version ([0-9]+(?:\.[0-9]+)?)", 1).alias("version"),
    )


@query("""
SELECT o_custkey, CASE count(DISTINCT o_orderpriority) FILTER (o_totalprice > 150000) WHEN 0 THEN 'unclear' WHEN 1 THEN min(o_orderpriority) FILTER (o_totalprice > 150000) ELSE 'conflict' END AS hint FROM orders GROUP BY 1
""", "orders")
def rule_hint(orders):
    """The one label that the evidence names, conflict for several, unclear for none."""
    strong = F.when(F.col("o_totalprice") > 150000, F.col("o_orderpriority"))
    both = orders.groupBy("o_custkey").agg(F.min(strong).alias("low"), F.max(strong).alias("high"))
    return both.select("o_custkey", F.when(F.col("low").isNull(), "unclear").when(F.col("low") == F.col("high"), F.col("low")).otherwise("conflict").alias("hint"))


@query("""
WITH n AS (SELECT conv_id, turn, role, length(text)::BIGINT AS score, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p FROM conversations), s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN p <= 2 THEN 1 ELSE 0 END, score DESC, p) AS k FROM n)
SELECT conv_id, p::BIGINT AS pos, score FROM s WHERE p <= 2 OR k <= 2
""", "conversations")
def segment_selection(conversations):
    """The first two turns of a conversation and the two longest of the others."""
    from pyspark.sql import Window

    rows = conversations.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")).select("conv_id", "pos", F.length("text").cast("long").alias("score"))
    return C.first_and_best(rows, ["conv_id"], "pos", "score", 2, 2)


@query("""
SELECT o_custkey, o_orderkey, greatest(n - 3, 0) AS remaining FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE k <= 3
""", "orders")
def highlight_pick(orders):
    return C.highlights(orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], F.col("o_orderstatus") == "O", [F.col("o_orderdate"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "remaining")


@query("""
SELECT p_brand, p_type, string_agg(DISTINCT p_name, '; ' ORDER BY p_name) AS names, count(*) AS rows, max(p_size) AS max_size FROM part GROUP BY 1, 2
""", "part")
def bom_grouping(part):
    return part.groupBy("p_brand", "p_type").agg(F.array_join(F.sort_array(F.collect_set("p_name")), "; ").alias("names"), F.count("*").alias("rows"), F.max("p_size").alias("max_size"))


@query("""
WITH k AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM k))
SELECT 'customer' AS name, (SELECT count(*) FROM k) AS kept, (SELECT count(*) FROM customer) - (SELECT count(*) FROM k) AS removed UNION ALL SELECT 'orders', (SELECT count(*) FROM o), (SELECT count(*) FROM orders) - (SELECT count(*) FROM o)
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)), (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o))
""", "customer", "orders", "lineitem")
def cascade_prune(customer, orders, lineitem):
    """What stays and what goes if only one segment's customers, and what hangs on them, are kept."""
    kept = customer.filter("c_mktsegment = 'MACHINERY'").select("c_custkey")
    flagged = orders.join(kept, orders.o_custkey == kept.c_custkey, "left").select("o_orderkey", F.col("c_custkey").isNotNull().alias("stays"))
    lines = lineitem.select("l_orderkey").join(flagged, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.coalesce("stays", F.lit(False)).alias("stays"))
    count = lambda name, df: df.agg(F.count_if("stays").alias("kept"), F.count_if(~F.col("stays")).alias("removed")).select(F.lit(name).alias("name"), "kept", "removed")
    return count("customer", customer.select((F.col("c_mktsegment") == "MACHINERY").alias("stays"))).unionByName(count("orders", flagged)).unionByName(count("lineitem", lines))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal, s_name FROM supplier
""", "supplier")
def overlay_price(supplier):
    """An overlay's values stand for the record's own where they are not null."""
    overlay = supplier.filter("s_suppkey % 2 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, F.col("s_acctbal") + 1).alias("s_acctbal"), F.lit(None).cast("string").alias("s_name"))
    return with_overlay(supplier.select("s_suppkey", "s_acctbal", "s_name"), overlay, "s_suppkey", ["s_acctbal", "s_name"])


@query("""
SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'X' ELSE '' END AS new_label FROM supplier WHERE CASE WHEN s_nationkey = 3 THEN 'X' ELSE '' END <> CASE WHEN s_suppkey % 2 = 0 THEN 'X' ELSE '' END
""", "supplier")
def backfill_changes(supplier):
    """Rows that a recomputation changes, and no others."""
    rows = supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "X").otherwise("").alias("label"), F.when(F.col("s_nationkey") == 3, "X").otherwise("").alias("new_label"))
    return rows.filter(~F.col("label").eqNullSafe(F.col("new_label"))).drop("label")


@query("""
WITH m AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 1 ELSE 0 END) AS complete, max(o_totalprice) AS best, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN complete = 1 THEN 'skipped_report_exists' WHEN coalesce(best, 0) < 50000 THEN 'match_needs_review' WHEN n > 12 THEN 'candidate_secondary_video' ELSE 'queued' END AS outcome FROM customer LEFT JOIN m ON c_custkey = o_custkey
""", "customer", "orders")
def discovery_gate(customer, orders):
    """What becomes of a discovered item: skipped, for review, secondary or queued."""
    per = orders.groupBy("o_custkey").agg(F.max(F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000), 1).otherwise(0)).alias("complete"), F.max("o_totalprice").alias("best"), F.count("*").alias("n"))
    held = customer.select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    outcome = first_rule([(F.col("complete") == 1, "skipped_report_exists"), (F.coalesce("best", F.lit(0.0)) < 50000, "match_needs_review"), (F.col("n") > 12, "candidate_secondary_video")], "queued")
    return held.select("c_custkey", outcome.alias("outcome"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
z AS (SELECT doc_id, last_value(CASE WHEN contains(line, 'icense') THEN 'legal' WHEN contains(line, '@') THEN 'contact' WHEN contains(line, '%%%') THEN 'junk' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS zone, length(line) AS n FROM l)
SELECT doc_id, coalesce(zone, 'body') AS zone, count(*) AS lines, sum(n)::BIGINT AS chars FROM z GROUP BY 1, 2
""", "documents")
def zone_machine(documents):
    """Lines by the zone that the last marker line opened."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    mark = F.when(F.contains("line", F.lit("icense")), "legal").when(F.contains("line", F.lit("@")), "contact").when(F.contains("line", F.lit("%%%")), "junk")
    zoned = S.carried_forward(lines, ["doc_id"], ["pos"], mark.isNotNull(), mark, "zone")
    return zoned.groupBy("doc_id", F.coalesce("zone", F.lit("body")).alias("zone")).agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("""
SELECT source, count(*) AS documents, round_even(avg(least(1.0, n_chars / 3000.0)), 3) AS size_score, round_even(count(*) FILTER (contains(text, chr(10))) / count(*), 4) AS with_lines FROM documents GROUP BY 1
""", "documents")
def module_scores(documents):
    """Scores of a source clamped to 1, rounded half to even."""
    score = F.least(F.lit(1.0), F.col("n_chars") / 3000.0)
    found = documents.groupBy("source").agg(F.count("*").alias("documents"), F.bround(F.avg(score), 3).alias("size_score"), F.count_if(F.contains("text", F.lit("\n"))).alias("_l"))
    return found.withColumn("with_lines", ratio(F.col("_l"), F.col("documents"))).drop("_l")


@query("""
SELECT l_returnflag, count(*) AS rows, quantile_disc(l_quantity, 0.5) AS median_quantity, min(l_extendedprice) AS cheapest, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1 HAVING count(*) > 10
""", "lineitem")
def bom_verification(lineitem):
    found = lineitem.groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity)").alias("median_quantity"), F.min("l_extendedprice").alias("cheapest"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))
    return found.filter("rows > 10")
