"""Queries over scores of records, rates of classifiers and crawls, and identities after review."""

from __future__ import annotations

from pyspark.sql import functions as F

from partledger.operators import scores as S
from partledger.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str, *names: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))
        ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return keep


def _views_sql() -> str:
    filled = {f: f"p_partkey % {k + 2} = 0" for k, (_, f, _) in enumerate(S.FILLED)}
    views = []
    for v in S.VIEWS:
        points = [f"CASE WHEN {filled[f]} THEN {p} ELSE 0 END" for w, f, p in S.FILLED if w == v]
        points += [f"least({cap}, {p} * ((p_size + {k}) % 9))" for k, (w, _, p, cap) in enumerate(S.LISTED) if w == v]
        views.append(f"least(1.0, ({' + '.join(points)})::DOUBLE)")
    return f"SELECT p_partkey, round_even(({' + '.join(views)}) / 5.0, 3)::DOUBLE AS completeness FROM part"


@query(_views_sql(), "part")
def view_completeness(part):
    """Completeness over five views, fields and list lengths by the rows' numbers."""
    filled = {f: F.col("p_partkey") % (k + 2) == 0 for k, (_, f, _) in enumerate(S.FILLED)}
    sizes = {f: (F.col("p_size") + k) % 9 for k, (_, f, _, _) in enumerate(S.LISTED)}
    return part.select("p_partkey", S.view_completeness(filled, sizes).alias("completeness"))


@query("""
WITH m AS (SELECT p_partkey, p_partkey % 3 = 0 AS pack, least(100, floor(length(p_name || repeat('x', p_size * 3))::DOUBLE / 120 * 100 + 0.5))::INT AS d, least(100, floor((p_size % 7)::DOUBLE / greatest(p_size % 6, p_size % 5, 1) * 100 + 0.5))::INT AS i, least(100, floor((p_size % 8)::DOUBLE / 5 * 100 + 0.5))::INT AS a, least(100, floor((p_size % 4)::DOUBLE / greatest(p_size % 6, 1) * 100 + 0.5))::INT AS t FROM part)
SELECT p_partkey, d AS description, i AS images, CASE WHEN pack THEN a ELSE t END AS third, floor((d + i + CASE WHEN pack THEN a ELSE t END) / 3.0 + 0.5)::INT AS overall FROM m
""", "part")
def unboxing_scores(part):
    """Scores of unboxing modules in percent."""
    size = F.col("p_size")
    module = F.when(F.col("p_partkey") % 3 == 0, "packaging").otherwise("earbuds")
    said = S.unboxing_scores(module, F.concat("p_name", F.repeat(F.lit("x"), size * 3)), size % 7, size % 6, size % 5, size % 8, size % 4)
    return part.select("p_partkey", said.alias("s")).select("p_partkey", "s.*")


_RESULTS_SQL = """
r AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'ear_clip' WHEN 1 THEN 'ear_hook' WHEN 2 THEN 'unclear' ELSE 'conflict' END AS rule_hint, CASE o_custkey % 3 WHEN 0 THEN 'ear_clip' WHEN 1 THEN 'ear_hook' ELSE 'wired' END AS label, CASE o_custkey % 7 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'invalid_output' ELSE 'ear_clip' END AS resolved,
  o_orderkey % 5 > 0 AS allowed, o_orderkey % 3 > 0 AS evidence, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 6 > 1 END AS segment, CASE o_orderkey % 9 WHEN 0 THEN 'high_confidence_candidate' WHEN 1 THEN 'medium_confidence_candidate' ELSE 'low' END AS status, o_custkey % 2 = 0 AS agree FROM orders)
"""


def results(orders):
    pick = lambda c, n, *names: F.element_at(F.array(*map(F.lit, names)), F.least(F.col(c) % n, F.lit(len(names) - 1)).cast("int") + 1)
    key = F.col("o_orderkey")
    return orders.select(
        pick("o_orderkey", 4, "ear_clip", "ear_hook", "unclear", "conflict").alias("rule_hint"), pick("o_custkey", 3, "ear_clip", "ear_hook", "wired").alias("label"), pick("o_custkey", 7, "needs_review", "invalid_output", "ear_clip").alias("resolved"), (key % 5 > 0).alias("allowed"), (key % 3 > 0).alias("evidence"),
        F.when(key % 11 > 0, key % 6 > 1).alias("segment"), pick("o_orderkey", 9, "high_confidence_candidate", "medium_confidence_candidate", "low").alias("status"), (F.col("o_custkey") % 2 == 0).alias("agree"),
    )


def _rate(condition: str, of: str = "true") -> str:
    return f"round_even(count(*) FILTER ({condition}) / greatest(count(*) FILTER ({of}), 1), 4)::DOUBLE"


_ASSIGNED, _EXPLICIT, _READY = "resolved NOT IN ('needs_review', 'invalid_output')", "rule_hint IN ('ear_clip', 'ear_hook')", "status IN ('high_confidence_candidate', 'medium_confidence_candidate')"


@query(f"""
WITH {_RESULTS_SQL}
SELECT count(*) AS sample, {_rate("allowed")} AS allowed_rate, {_rate("evidence")} AS evidence_rate, {_rate("segment")} AS segment_rate, {_rate("status LIKE 'high%'")} AS high_rate, count(*) FILTER ({_ASSIGNED}) AS assigned, count(*) FILTER (resolved = 'needs_review') AS abstained,
  {_rate(f"{_ASSIGNED} AND evidence", _ASSIGNED)} AS assigned_evidence_rate, {_rate(f"{_ASSIGNED} AND segment", _ASSIGNED)} AS assigned_segment_rate, {_rate(f"{_ASSIGNED} AND status LIKE 'high%'", _ASSIGNED)} AS assigned_high_rate, count(*) FILTER (status LIKE 'medium%') AS medium, {_rate(_READY)} AS ready_rate,
  {_rate(f"{_EXPLICIT} AND agree", _EXPLICIT)} AS agreement_rate, count(*) FILTER ({_EXPLICIT}) AS compared, count(*) FILTER (NOT {_READY}) AS manual_review FROM r
""", "orders")
def classifier_summary(orders):
    """Rates and counts over a classifier's results; orders stand for them."""
    return S.classifier_summary(results(orders), ("ear_clip", "ear_hook"))


@query(f"""
WITH {_RESULTS_SQL} SELECT of_, label, count(*) AS count FROM (SELECT unnest(['rule_hint', 'label', 'resolved']) AS of_, unnest([rule_hint, label, resolved]) AS label FROM r) GROUP BY ALL
""", "orders")
def classifier_distributions(orders):
    return S.label_counts(results(orders), ["rule_hint", "label", "resolved"]).withColumnRenamed("of", "of_")


@query("""
SELECT user_id, count(*) AS items, count(*) FILTER (event_type = 'error') AS errors, round_even(count(*) FILTER (event_type = 'error') / count(*), 4)::DOUBLE AS rate, count(*) FILTER (event_type = 'error') > 0.2 * count(*) AS blocked FROM events GROUP BY 1
""", "events")
def error_rate_guard(events):
    """Runs (users) of whose items more than a fifth failed."""
    return S.error_guard(events, "user_id", "event_type", "error", 0.2)


@query("""
WITH r AS (SELECT c_custkey AS record, CASE WHEN c_custkey % 4 = 0 THEN '耳挂式耳机' ELSE c_mktsegment END AS category, c_custkey % 5 AS d FROM customer)
SELECT record, 'own' AS brand, 'm' || record AS model, category, false AS reviewed FROM r WHERE d IN (0, 4) OR d = 3 AND category <> '耳挂式耳机' AND record % 3 = 0
UNION ALL SELECT record, 'b1', 'x', CASE WHEN category = '耳挂式耳机' THEN category ELSE '有线耳机' END, true FROM r WHERE d = 2 OR d = 3 AND (category = '耳挂式耳机' OR record % 3 <> 0)
UNION ALL SELECT record, 'b2', 'y', CASE WHEN category = '耳挂式耳机' THEN category ELSE '有线耳机' END, true FROM r WHERE d = 2
""", "customer")
def identity_overrides(customer):
    """Records (customers) that review split, confirmed, excluded or left."""
    key, fifth = F.col("c_custkey"), F.col("c_custkey") % 5
    category = F.when(key % 4 == 0, "耳挂式耳机").otherwise(F.col("c_mktsegment"))
    records = customer.select(key.alias("record"), F.lit("own").alias("brand"), F.concat(F.lit("m"), key.cast("string")).alias("model"), category.alias("category"))
    item = lambda brand, model, kind, sure: F.struct(F.lit(brand).alias("brand"), F.lit(model).alias("model"), kind.alias("category"), F.lit(sure).alias("confidence"))
    wired = F.lit("有线耳机")
    one = F.array(item("b1 ", "x", F.when(key % 3 == 0, "音箱").otherwise(wired), 0.95))
    two = F.array(item("b1", " x", wired, 0.9), item("b2", "y", wired, 0.99), item("b3", "z", wired, 0.8), item(" ", "w", wired, 1.0))
    overrides = customer.filter("c_custkey % 5 <> 0").select(key.alias("record"), F.when(fifth == 1, "not_headphone").when(fifth == 2, "multi_headphone").when(fifth == 3, "single_headphone").otherwise("unsure").alias("decision"), F.when(fifth == 2, two).otherwise(one).alias("products"))
    return S.record_identities(records, overrides, ("耳挂式耳机", "有线耳机"))
