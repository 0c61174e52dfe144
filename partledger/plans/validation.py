"""Queries that judge extracted statements by their evidence, and the release gate over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from partledger.functions.text import collapse_spaces, sentences
from partledger.operators import evidence as E
from partledger.operators import records as R
from partledger.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str, *names: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))
        ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return keep


def claims_of(benchmark):
    """(item_id, pos, claim, source): the sentences of the items; what the queries make of them stands for a reader's output."""
    return benchmark.select("item_id", F.col("text").alias("source"), F.posexplode(sentences("text")).alias("pos", "claim")).withColumn("pos", F.col("pos").cast("long"))


_SENTENCES = r"""
c AS (SELECT item_id, text AS source, unnest(l) AS claim, unnest(range(len(l)))::BIGINT AS pos FROM (SELECT item_id, text, list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda s: trim(s)), lambda s: length(s) >= 6) AS l FROM benchmark))
"""
_NORM = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_NUMBERS = r"regexp_extract_all({0}, '[0-9]+(?:\.[0-9]+)?')"


def _in(whole: str, part: str) -> str:
    return f"coalesce({_NORM.format(part)} <> '' AND contains({_NORM.format(whole)}, {_NORM.format(part)}), false)"


def _beyond(a: str, b: str) -> str:
    return f"coalesce(len(list_filter({_NUMBERS.format(a)}, lambda x: NOT list_contains({_NUMBERS.format(b)}, x))) > 0, false)"


def _judged(rows: str, cap: int, part: str, identity: str, order: str) -> str:
    """The end of a statement: duplicates and the cap among rows without a reason."""
    return f"""
f AS (SELECT *, why IS NULL AND row_number() OVER (PARTITION BY {part}, why IS NULL, {identity} ORDER BY {order}) = 1 AS fresh FROM {rows}),
u AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY {part} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS upto,
  CASE WHEN why IS NOT NULL THEN why WHEN NOT fresh THEN 'duplicate' WHEN sum(fresh::INT) OVER (PARTITION BY {part} ORDER BY {order} ROWS UNBOUNDED PRECEDING) > {cap} THEN 'over_cap' END AS reason FROM f)
"""


_GENERIC_LABELS = ("parameter", "feature")
_PARAMETER_SQL = f"""
WITH {_SENTENCES},
k AS (SELECT *, CASE WHEN pos % 6 = 5 THEN item_id + 1000000 ELSE item_id END AS row_id, CASE WHEN pos % 9 = 8 THEN NULL WHEN pos % 7 = 6 THEN 'feature' ELSE substr(claim, 1, 40) END AS label,
  CASE WHEN pos % 9 = 8 THEN NULL WHEN pos % 4 = 3 THEN claim || ' 42' ELSE substr(claim, 1, 12) END AS value, CASE WHEN pos % 9 = 8 THEN NULL WHEN pos % 5 = 4 THEN reverse(claim) ELSE claim END AS quote FROM c),
j AS (SELECT k.*, b.item_id AS known, b.text AS row_text FROM k LEFT JOIN benchmark b ON b.item_id = k.row_id),
r AS (SELECT *, CASE WHEN known IS NULL THEN 'unknown_row_key' WHEN label IS NULL AND value IS NULL AND quote IS NULL THEN 'parameter_not_an_object' WHEN length(trim(label)) < 2 OR trim(label) IN ('parameter', 'feature') THEN 'invalid_label' WHEN trim(value) = '' THEN 'missing_value'
  WHEN NOT {_in('row_text', 'quote')} THEN 'evidence_not_in_row' WHEN NOT {_in('quote', 'value')} THEN 'value_not_in_evidence' WHEN {_beyond("label || ' ' || value", 'quote')} THEN 'unsupported_number' END AS why FROM j),
{_judged('r', 3, 'item_id', "lower(" + _NORM.format("coalesce(value, '')") + ")", 'pos')}
SELECT item_id, pos, reason FROM u
"""


@query(_PARAMETER_SQL, "benchmark")
def parameter_validation(benchmark):
    """Parameters read from rows, some for rows that don't exist, some without a shape: every reason in its order."""
    odd = F.col("pos") % 9 == 8
    given = claims_of(benchmark).select(
        "item_id", "pos", F.when(F.col("pos") % 6 == 5, F.col("item_id") + 1_000_000).otherwise(F.col("item_id")).alias("row_id"),
        F.when(odd, None).when(F.col("pos") % 7 == 6, "feature").otherwise(F.substring("claim", 1, 40)).alias("label"),
        F.when(odd, None).when(F.col("pos") % 4 == 3, F.concat("claim", F.lit(" 42"))).otherwise(F.substring("claim", 1, 12)).alias("value"),
        F.when(odd, None).when(F.col("pos") % 5 == 4, F.reverse("claim")).otherwise(F.col("claim")).alias("quote"),
    )
    rows = benchmark.select(F.col("item_id").alias("known"), F.col("text").alias("row_text"))
    held = given.join(rows, given.row_id == rows.known, "left")
    rules = E.parameter_rules("label", "value", "quote", "row_text", _GENERIC_LABELS, "known")
    return E.validated(held, ["item_id"], ["pos"], rules, F.lower(collapse_spaces(F.coalesce("value", F.lit("")))), 3).select("item_id", "pos", "reason")


_CLAIM_SQL = f"""
WITH {_SENTENCES},
k AS (SELECT *, CASE WHEN pos % 7 = 6 THEN substr(claim, 1, 5) WHEN pos % 8 = 7 THEN '42 MHZ-7 A1B2' WHEN pos % 11 = 10 THEN claim || ' in 99 hours' ELSE claim END AS t, CASE pos % 6 WHEN 5 THEN 'other' WHEN 0 THEN 'sound' WHEN 3 THEN 'sound' WHEN 1 THEN 'comfort' ELSE 'battery' END AS category,
  CASE WHEN pos % 5 = 4 THEN reverse(claim) ELSE claim END AS quote, CASE WHEN pos % 10 = 3 THEN NULL ELSE 0.7 + 0.1 * (pos % 3) END AS confidence FROM c),
r AS (SELECT *, CASE WHEN length({_NORM.format('t')}) < 8 THEN 'claim_too_short' WHEN category NOT IN ('sound', 'comfort', 'battery') THEN 'invalid_category' WHEN NOT {_in('source', 'quote')} THEN 'evidence_not_in_report'
  WHEN regexp_matches(trim(t), '^[0-9A-Z .%-]+$') OR regexp_matches(trim(quote), '^[0-9A-Z .%-]+$') THEN 'pure_technical_fact' WHEN {_beyond('t', 'quote')} THEN 'unsupported_number' WHEN coalesce(confidence, 0.8) < 0.75 THEN 'low_confidence' END AS why FROM k),
{_judged('r', 7, 'item_id', 'lower(' + _NORM.format('t') + ')', 'pos')}
SELECT item_id, pos, category, reason FROM u
"""


@query(_CLAIM_SQL, "benchmark")
def claim_validation(benchmark):
    """Consumer claims, seven at most of an item."""
    text = F.when(F.col("pos") % 7 == 6, F.substring("claim", 1, 5)).when(F.col("pos") % 8 == 7, "42 MHZ-7 A1B2").when(F.col("pos") % 11 == 10, F.concat("claim", F.lit(" in 99 hours"))).otherwise(F.col("claim"))
    sixth = F.col("pos") % 6
    given = claims_of(benchmark).select(
        "item_id", "pos", "source", text.alias("t"), F.when(sixth == 5, "other").when(sixth.isin(0, 3), "sound").when(sixth == 1, "comfort").otherwise("battery").alias("category"),
        F.when(F.col("pos") % 5 == 4, F.reverse("claim")).otherwise(F.col("claim")).alias("quote"), F.when(F.col("pos") % 10 != 3, 0.7 + 0.1 * (F.col("pos") % 3)).alias("confidence"),
    )
    rules = E.claim_rules("t", "category", "quote", "source", "confidence", ("sound", "comfort", "battery"), "^[0-9A-Z .%-]+$")
    return E.validated(given, ["item_id"], ["pos"], rules, F.lower(collapse_spaces("t")), 7).select("item_id", "pos", "category", "reason")


_SUMMARY_SQL = f"""
WITH {_SENTENCES},
m AS (SELECT item_id, pos % 2 AS module, string_agg(claim, ' | ' ORDER BY pos) AS corpus FROM c GROUP BY 1, 2),
k AS (SELECT c.item_id, c.pos, c.pos % 2 AS module, corpus, CASE WHEN c.pos % 7 = 6 THEN substr(claim, 1, 4) WHEN c.pos % 9 = 8 THEN 'as shown here' WHEN c.pos % 6 = 5 THEN claim || ' 77' ELSE claim END AS t, CASE WHEN c.pos % 5 = 4 THEN reverse(claim) ELSE claim END AS quote FROM c JOIN m ON c.item_id = m.item_id AND c.pos % 2 = m.module),
r AS (SELECT *, CASE WHEN length({_NORM.format('t')}) < 6 THEN 'summary_too_short' WHEN NOT {_in('corpus', 'quote')} THEN 'evidence_not_in_module' WHEN contains(t, 'ing ') OR contains(t, 'solder') THEN 'foreign_fact' WHEN {_beyond('t', 'quote')} THEN 'unsupported_number' WHEN trim(t) IN ('as shown here', 'overview') THEN 'generic_caption' END AS why FROM k),
{_judged('r', 2, 'item_id, module', 'lower(' + _NORM.format('t') + ')', 'pos')}
SELECT item_id, module, pos, reason FROM u
"""


@query(_SUMMARY_SQL, "benchmark")
def summary_validation(benchmark):
    """Summaries of the modules of an item, two at most of each; evidence counts only from the module itself."""
    c = claims_of(benchmark).withColumn("module", F.col("pos") % 2)
    corpus = c.groupBy("item_id", "module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "claim"))), lambda s: s["claim"]), " | ").alias("corpus"))
    text = F.when(F.col("pos") % 7 == 6, F.substring("claim", 1, 4)).when(F.col("pos") % 9 == 8, "as shown here").when(F.col("pos") % 6 == 5, F.concat("claim", F.lit(" 77"))).otherwise(F.col("claim"))
    given = c.join(corpus, ["item_id", "module"]).select("item_id", "module", "pos", "corpus", text.alias("t"), F.when(F.col("pos") % 5 == 4, F.reverse("claim")).otherwise(F.col("claim")).alias("quote"))
    rules = E.summary_rules("t", "quote", "corpus", ("ing ", "solder"), ("as shown here", "overview"))
    return E.validated(given, ["item_id", "module"], ["pos"], rules, F.lower(collapse_spaces("t")), 2).select("item_id", "module", "pos", "reason")


_IDENTITY_SQL = r"""
WITH k AS (SELECT p_partkey % 500 AS record, p_partkey, p_brand AS brand, CASE WHEN p_partkey % 7 = 6 THEN '' ELSE p_name END AS model, CASE WHEN p_partkey % 5 = 4 THEN 0.85 ELSE 0.95 END AS confidence,
  'The ' || p_name || '  of ' || p_brand || ' was opened.' AS source_text, CASE WHEN p_partkey % 9 = 8 THEN 'unseen ' || p_name ELSE p_name || ' of ' || CASE WHEN p_partkey % 11 = 10 THEN 'nobody' ELSE p_brand END END AS quote FROM part),
n AS (SELECT *, regexp_replace(lower(quote), '[^0-9a-z]+', '', 'g') AS q, regexp_replace(lower(brand), '[^0-9a-z]+', '', 'g') AS b, regexp_replace(lower(model), '[^0-9a-z]+', '', 'g') AS m FROM k),
o AS (SELECT record, trim(brand) <> '' AND trim(model) <> '' AND confidence >= 0.9 AND contains(trim(regexp_replace(source_text, '\s+', ' ', 'g')), trim(regexp_replace(quote, '\s+', ' ', 'g'))) AND contains(q, b) AND contains(q, m) AS ok FROM n),
g AS (SELECT record, count(*) FILTER (ok) AS n, CASE record % 4 WHEN 0 THEN 'single' WHEN 1 THEN 'multi' WHEN 2 THEN 'none' ELSE 'odd' END AS d FROM o GROUP BY record),
e AS (SELECT *, CASE WHEN d = 'single' AND n = 1 OR d = 'multi' AND n >= 2 OR d = 'none' THEN d ELSE 'needs_review' END AS decision FROM g)
SELECT record, decision, CASE WHEN decision IN ('single', 'multi') THEN n ELSE 0 END AS products FROM e
"""


@query(_IDENTITY_SQL, "part")
def identity_validation(part):
    """Readings of which products a record shows: what of them its quotes support, and whether the decision stands."""
    key, record = F.col("p_partkey"), F.col("p_partkey") % 500
    fourth = record % 4
    given = part.select(
        record.alias("record"), F.when(fourth == 0, "single").when(fourth == 1, "multi").when(fourth == 2, "none").otherwise("odd").alias("decision"), F.col("p_brand").alias("brand"),
        F.when(key % 7 == 6, "").otherwise(F.col("p_name")).alias("model"), F.when(key % 5 == 4, 0.85).otherwise(0.95).alias("confidence"),
        F.concat(F.lit("The "), "p_name", F.lit("  of "), "p_brand", F.lit(" was opened.")).alias("source_text"),
        F.when(key % 9 == 8, F.concat(F.lit("unseen "), "p_name")).otherwise(F.concat("p_name", F.lit(" of "), F.when(key % 11 == 10, "nobody").otherwise(F.col("p_brand")))).alias("quote"),
    )
    return E.reviewed_identities(given, "record", "decision", F.array("brand"))


@query(r"""
WITH k AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN 'guessed' ELSE 'verified' END AS status, CASE o_orderkey % 4 WHEN 0 THEN substr(o_orderdate::VARCHAR, 1, 4) WHEN 1 THEN substr(o_orderdate::VARCHAR, 1, 7) WHEN 2 THEN substr(o_orderdate::VARCHAR, 1, 10) ELSE 'spring' END AS value,
  CASE WHEN o_orderkey % 7 = 6 THEN 0.5 ELSE 0.93 END AS confidence, 'sold  from ' || substr(o_orderdate::VARCHAR, 1, 10) || ' on' AS article, CASE WHEN o_orderkey % 6 = 5 THEN 'sold until' ELSE 'sold from ' || substr(o_orderdate::VARCHAR, 1, 10) END AS quote FROM orders),
v AS (SELECT *, status IN ('verified', 'year_only') AND regexp_matches(value, '^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$') AND confidence >= 0.9 AND contains(trim(regexp_replace(article, '\s+', ' ', 'g')), quote) AS ok FROM k)
SELECT o_orderkey, CASE WHEN NOT ok THEN 'not_found' WHEN length(value) >= 7 THEN 'verified' ELSE 'year_only' END AS status, CASE WHEN ok THEN value ELSE '' END AS launch_date FROM v
""", "orders")
def launch_date_validation(orders):
    """Readings of launch dates: shape, certainty and evidence."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    value = F.when(key % 4 == 0, F.substring(day, 1, 4)).when(key % 4 == 1, F.substring(day, 1, 7)).when(key % 4 == 2, day).otherwise("spring")
    given = orders.select(
        "o_orderkey", F.when(key % 5 == 4, "guessed").otherwise("verified").alias("status"), value.alias("value"), F.when(key % 7 == 6, 0.5).otherwise(0.93).alias("confidence"),
        F.concat(F.lit("sold  from "), day, F.lit(" on")).alias("article"), F.when(key % 6 == 5, "sold until").otherwise(F.concat(F.lit("sold from "), day)).alias("quote"),
    )
    return E.reviewed_dates(given).select("o_orderkey", "status", "launch_date")


@query(r"""
WITH s AS (SELECT conv_id, turn, min(text) AS raw FROM conversations GROUP BY 1, 2),
e AS (SELECT conv_id, CASE WHEN turn % 5 = 4 THEN turn + 1000 ELSE turn END AS turn, turn * 10 + i AS ord, CASE WHEN turn % 3 = 2 THEN ' ' ELSE CASE i WHEN 0 THEN '  ' || raw ELSE raw END END AS fact, CASE WHEN turn % 4 = 3 THEN raw || ' 512' END AS corrected,
  CASE WHEN turn % 6 = 5 THEN NULL ELSE turn - 1 END AS importance, turn % 7 = 6 AS needs_review FROM s, (SELECT unnest([0, 1]) AS i)),
j AS (SELECT e.conv_id, e.turn, ord, importance, needs_review, raw, coalesce(nullif(trim(corrected), ''), trim(raw)) AS corrected, coalesce(nullif(trim(fact), ''), nullif(trim(corrected), ''), trim(raw)) AS fact FROM e JOIN s ON e.conv_id = s.conv_id AND e.turn = s.turn),
d AS (SELECT * FROM j WHERE fact <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(trim(regexp_replace(fact, '\s+', ' ', 'g'))) ORDER BY ord) = 1)
SELECT conv_id, turn, ord, least(greatest(coalesce(importance, 3), 1), 5)::BIGINT AS importance,
  needs_review OR list_sort(list_distinct(regexp_extract_all(corrected, '[0-9]+(?:\.[0-9]+)?'))) <> list_sort(list_distinct(regexp_extract_all(raw, '[0-9]+(?:\.[0-9]+)?'))) AS needs_review FROM d
""", "conversations")
def event_validation(conversations):
    """Events read from segments: unknown segments and repeated facts go, changed numbers are for review."""
    segments = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("raw"))
    turn = F.col("turn")
    twice = segments.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    given = twice.select(
        "conv_id", F.when(turn % 5 == 4, turn + 1000).otherwise(turn).alias("turn"), (turn * 10 + F.col("i")).alias("ord"), F.when(turn % 3 == 2, " ").when(F.col("i") == 0, F.concat(F.lit("  "), "raw")).otherwise(F.col("raw")).alias("fact"),
        F.when(turn % 4 == 3, F.concat("raw", F.lit(" 512"))).alias("corrected"), F.when(turn % 6 != 5, turn - 1).alias("importance"), (turn % 7 == 6).alias("needs_review"),
    )
    return E.reviewed_events(given, segments, ["conv_id"], "turn", "ord").select("conv_id", "turn", "ord", F.col("importance").cast("long").alias("importance"), "needs_review")


@query(r"""
WITH s AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2), f AS (SELECT conv_id, min(turn) AS a, max(turn) AS z FROM s GROUP BY 1),
k AS (SELECT f.conv_id, CASE f.conv_id % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'ending' WHEN 2 THEN 'article' ELSE 'nonsense' END AS category, CASE WHEN f.conv_id % 5 = 4 THEN 'not said' ELSE substr(s.text, 1, 24) END AS quote, CASE WHEN f.conv_id % 3 = 2 THEN z ELSE a END AS segment FROM f JOIN s ON s.conv_id = f.conv_id AND s.turn = f.a),
h AS (SELECT k.conv_id, count(*) AS hits, max(CASE WHEN s.turn = k.segment THEN s.turn END) AS own, min(s.turn) AS only_ FROM k JOIN s USING (conv_id) WHERE trim(regexp_replace(quote, '\s+', ' ', 'g')) <> '' AND contains(trim(regexp_replace(s.text, '\s+', ' ', 'g')), trim(regexp_replace(quote, '\s+', ' ', 'g'))) GROUP BY 1),
j AS (SELECT k.*, coalesce(own, CASE WHEN hits = 1 THEN only_ END) AS resolved, list_filter([CASE WHEN contains(lower(quote), 'the') THEN 'article' END, CASE WHEN contains(lower(quote), 'ing') THEN 'ending' END], lambda x: x IS NOT NULL) AS named FROM k LEFT JOIN h USING (conv_id))
SELECT conv_id, CASE WHEN category IN ('article', 'ending') THEN category ELSE 'invalid_output' END AS category, resolved AS segment, CASE WHEN category IN ('article', 'ending') AND resolved IS NOT NULL AND list_contains(named, category) AND len(named) = 1 THEN 'candidate' ELSE 'needs_review' END AS status FROM j
""", "conversations")
def category_validation(conversations):
    """Category readings: an exact quote, in the segment named or the only one that has it, that names this category alone."""
    segments = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    ends = segments.groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("a"), F.max("turn").alias("z"))
    k = F.col("conv_id")
    given = ends.select(
        "conv_id", F.when(k % 4 == 1, "ending").when(k % 4 == 3, "nonsense").otherwise("article").alias("category"), F.when(k % 5 == 4, "not said").otherwise(F.substring("a.text", 1, 24)).alias("quote"),
        F.when(k % 3 == 2, F.col("z")).otherwise(F.col("a.turn")).alias("segment"),
    )
    return E.reviewed_categories(given, segments, "conv_id", "turn", {"article": "the", "ending": "ing"})


_GATE = r"""
WITH p AS (SELECT * FROM part WHERE p_size >= 5), s AS (SELECT * FROM supplier WHERE s_suppkey % 9 <> 0), o AS (SELECT * FROM orders WHERE o_orderkey % 50 <> 0), c AS (SELECT * FROM customer WHERE c_custkey % 40 <> 0), e AS (SELECT * FROM events WHERE event_type <> 'error')
SELECT 'orphan_product_report_links' AS check_name, count(*) AS found, true AS blocking FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM p) OR l_suppkey NOT IN (SELECT s_suppkey FROM s)
UNION ALL SELECT 'orphan_product_video_links', count(*), true FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM p) OR l_orderkey NOT IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'orphan_video_facts', count(*), true FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM c)
UNION ALL SELECT 'orphan_bom_items', count(*), true FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM p)
UNION ALL SELECT 'orphan_bom_parameters', count(*), true FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'broken_video_bom_provenance', count(*), true FROM lineitem WHERE l_returnflag = 'R' AND (l_orderkey % 3 <> 0 AND l_orderkey NOT IN (SELECT o_orderkey FROM o) OR l_suppkey NOT IN (SELECT s_suppkey FROM s))
UNION ALL SELECT 'broken_video_product_pointers', count(*), true FROM orders WHERE o_custkey % 2 = 0 AND o_custkey NOT IN (SELECT c_custkey FROM c) OR o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'orphan_product_images', count(*), true FROM events WHERE event_type LIKE 'p%' AND user_id NOT IN (SELECT user_id FROM e WHERE value >= 50)
UNION ALL SELECT 'orphan_report_images', count(*), true FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT c_custkey FROM c)
UNION ALL SELECT 'duplicate_links', (SELECT count(*) FROM (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)), true
UNION ALL SELECT 'suspicious_models', count(*), false FROM part WHERE p_name LIKE '%ring%' OR length(p_name) < 9
UNION ALL SELECT 'products_without_evidence', count(*), false FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT 'missing_expected', count(*), true FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM s)
UNION ALL SELECT 'migration_marker_missing', CASE WHEN (SELECT count(*) FROM region WHERE r_name = 'MIGRATED') = 0 THEN 1 ELSE 0 END, true
"""


@query(_GATE, "lineitem", "part", "supplier", "orders", "customer", "events", "nation", "region")
def release_validation(lineitem, part, supplier, orders, customer, events, nation, region):
    """The release gate: thirteen checks and the migration marker, in one table; some only warn. Parents are thinned out first,
    so that there is something to find; the tables stand for links, facts, parts lists and images."""
    p, s, o, c = part.filter("p_size >= 5"), supplier.filter("s_suppkey % 9 <> 0"), orders.filter("o_orderkey % 50 <> 0"), customer.filter("c_custkey % 40 <> 0")
    line = lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_returnflag")
    users = events.filter("event_type <> 'error' and value >= 50").select("user_id")

    def parent(frame, key, name):
        return frame.select(F.col(key).alias(f"_{name}")).distinct()

    # Each line once against its three parents; all checks of lines are counts over that one join.
    joined = line.join(parent(p, "p_partkey", "p"), F.col("l_partkey") == F.col("_p"), "left").join(parent(s, "s_suppkey", "s"), F.col("l_suppkey") == F.col("_s"), "left").join(parent(o, "o_orderkey", "o"), F.col("l_orderkey") == F.col("_o"), "left")
    no = {k: F.col(f"_{k}").isNull() for k in "pso"}
    of_lines = {
        "orphan_product_report_links": no["p"] | no["s"], "orphan_product_video_links": no["p"] | no["o"], "orphan_bom_items": no["p"], "orphan_bom_parameters": no["o"],
        "broken_video_bom_provenance": (F.col("l_returnflag") == "R") & (((F.col("l_orderkey") % 3 != 0) & no["o"]) | no["s"]),
    }
    held = orders.join(parent(c, "c_custkey", "c"), F.col("o_custkey") == F.col("_c"), "left").join(parent(o, "o_orderkey", "o"), F.col("o_orderkey") == F.col("_o"), "left")
    of_orders = {"orphan_video_facts": F.col("_c").isNull(), "broken_video_product_pointers": ((F.col("o_custkey") % 2 == 0) & F.col("_c").isNull()) | ((F.col("o_orderkey") % 2 == 0) & F.col("_o").isNull())}

    def counted(frame, checks, blocking=True):
        totals = frame.agg(*(F.count_if(cond).alias(n) for n, cond in checks.items()))
        return totals.select(F.explode(F.create_map(*(x for n in checks for x in (F.lit(n), F.col(n))))).alias("check_name", "found")).withColumn("blocking", F.lit(blocking))

    all_ = {"found": F.lit(True)}
    one = lambda name, frame, blocking=True: counted(frame, all_, blocking).withColumn("check_name", F.lit(name))
    parts = [
        counted(joined, of_lines), counted(held, of_orders),
        one("orphan_product_images", R.orphans(events.select("user_id", "event_type"), users, "user_id", "user_id", F.col("event_type").like("p%"))),
        one("orphan_report_images", R.orphans(events.select("user_id", "event_type"), c, "user_id", "c_custkey", F.col("event_type") == "click")),
        one("duplicate_links", line.groupBy("l_partkey", "l_suppkey").count().filter("count > 1")),
        counted(part, {"suspicious_models": F.contains("p_name", F.lit("ring")) | (F.length("p_name") < 9)}, False),
        one("products_without_evidence", R.orphans(part, line, "p_partkey", "l_partkey"), False),
        one("missing_expected", R.orphans(nation, s, "n_nationkey", "s_nationkey")),
        region.agg(F.when(F.count_if(F.col("r_name") == "MIGRATED") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("found")).select(F.lit("migration_marker_missing").alias("check_name"), "found", F.lit(True).alias("blocking")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
