"""Queries over raw JSON: strings at any depth, objects in prose, candidates with odd shapes, evaluation of ways of extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partledger.functions.text import collapse_spaces
from partledger.operators import evidence as E
from partledger.operators import nested as N
from partledger.plans.extraction import expected_sql, rendered
from partledger.sources.tables import dealt

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str, *names: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(dealt(spark, sf_dir, n) for n in names))
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return keep


@query("""
WITH t AS (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY 1, 2)
SELECT conv_id, 'turns[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '].said.text' AS path, text FROM t
UNION ALL SELECT conv_id, 'turns[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '].role' AS path, role FROM t
UNION ALL SELECT DISTINCT conv_id, 'meta.deep[1][0].name', 'c' || conv_id FROM conversations
""", "conversations")
def display_strings(conversations):
    """Every string of a nested record, without links: conversations as JSON, four levels deep."""
    turns = conversations.groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    turn = F.struct("turn", "role", F.struct("text", F.concat(F.lit("https://x.test/"), "turn").alias("url")).alias("said"))
    deep = F.concat(F.lit('[1, [{"name": "c'), "conv_id", F.lit('", "url": ["u"]}], null, true]'))
    rows = turns.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(turn))).alias("turns"))
    json = F.concat(F.lit('{"turns": '), "turns", F.lit(', "meta": {"deep": '), deep, F.lit(', "n": 3}}'))
    return N.display_strings(rows.select("conv_id", json.alias("json")), "conv_id", "json")


ANSWERS = (
    ("Here it is: {\"id\": {a}, \"in\": {\"text\": \"a } and \\\" {\", \"list\": [{\"x\": {b}}]}} and another {\"id\": 0}", "{\"id\": {a}, \"in\": {\"text\": \"a } and \\\" {\", \"list\": [{\"x\": {b}}]}}"),
    ("```json\n{\"id\": {a}, \"empty\": {}}\n```", "{\"id\": {a}, \"empty\": {}}"),
    ("[{\"id\": {a}}]", None),
    ("no object at all", None),
    ("{\"id\": {a}, \"open\": [1, 2", None),
    ("{not json {b}} {\"id\": {a}}", None),
    ("{\"id\": {a}} tail", "{\"id\": {a}}"),
)


@query(expected_sql("part", "p_partkey", ("object",), [((a,),) for _, a in ANSWERS], ("object",)), "part")
def json_objects_in_text(part):
    """The first JSON object of an answer, nested, with fences or prose around it."""
    return part.select("p_partkey", N.first_object(rendered("p_partkey", [t for t, _ in ANSWERS])).alias("object"))


RESPONSES = (
    ('{"items": [{"key": "k", "parameters": [{"label": "容量：", "value": "{a}mAh。", "evidence_quote": "容量 {a}mAh"}, "x", {"label": "a", "value": "{b}", "evidence_quote": "q"}, {"label": "电压", "value": "", "evidence_quote": "q"}]}]}'),
    ('{"items": {"key": "k"}}'),
    ('[7, {"key": "other", "parameters": []}, {"key": "k", "parameters": "p"}, {"key": "k"}]'),
    ('not json'),
    ('[{"key": "k", "parameters": [{"label": "容量", "value": "{a}mAh", "evidence_quote": "容量{a}mAh"}, {"label": "容量", "value": "{a} mAh", "evidence_quote": "容量 {a}mAh"}, {"label": "数量", "value": "容量", "evidence_quote": "容量 x9"}, {"label": "第{b}号", "value": "容量", "evidence_quote": "容量"}, {"label": "高度", "value": "容量", "evidence_quote": "容量"}]}]'),
)
_JUDGED = (
    ((0, 0, None), (0, 1, "parameter_not_an_object"), (0, 2, "invalid_label"), (0, 3, "missing_value")),
    ((-1, -1, "response_items_not_a_list"),),
    ((0, -1, "item_not_an_object"), (1, -1, "unknown_row_key"), (2, -1, "parameters_not_a_list")),
    ((-1, -1, "response_items_not_a_list"),),
    ((0, 0, None), (0, 1, "duplicate"), (0, 2, "evidence_not_in_row"), (0, 3, "unsupported_number"), (0, 4, None)),
)


def judged_parameters(part: DataFrame) -> DataFrame:
    """(p_partkey, item, place, label, value, quote, reason) of the responses' parameters."""
    rows = part.select("p_partkey", rendered("p_partkey", RESPONSES).alias("json"))
    keys = part.select("p_partkey", F.lit("k").alias("row_key"))
    squeezed = lambda c: F.regexp_replace(c, r"\s+", "")
    given = N.parameter_candidates(rows, "p_partkey", "json", keys).withColumn("row_text", rendered("p_partkey", ["某电池容量 {a}mAh，标称。"]))
    tight = given.withColumns({c: squeezed(F.col(c)) for c in ("value", "quote", "row_text")})
    rules = [(F.col("shape") == s, s) for s in ("response_items_not_a_list", "item_not_an_object", "unknown_row_key", "parameters_not_a_list", "parameter_not_an_object")]
    rules += [r for r in E.parameter_rules("label", "value", "quote", "row_text") if r[1] != "parameter_not_an_object"]
    return E.validated(tight, ["p_partkey", "item"], ["place"], rules, F.lower(F.concat_ws(":", "label", "value")), 7).select("p_partkey", "item", "place", "label", "value", "quote", "reason")


@query(expected_sql("part", "p_partkey", ("item", "place", "reason"), _JUDGED, ()), "part")
def raw_parameter_validation(part):
    """Parameters from raw JSON: three shapes that are none, rows that don't exist, and what the evidence doesn't bear out."""
    return judged_parameters(part).select("p_partkey", "item", "place", "reason")


CLAIMS = (
    '[{"text": "佩戴很舒适，全天{b}小时无感", "category": "佩戴体验", "evidence_quote": "全天{b}小时无感", "confidence": 0.9}, {"claim": "佩戴很舒适，全天{b}小时无感", "tag": "佩戴体验", "evidence_quote": "全天{b}小时无感"}, "x", {"text": "短", "category": "佩戴体验"}]',
    '{"text": "不是列表"}',
    '[{"text": "音质清晰且有{a}种均衡", "category": "音质体验", "evidence_quote": "音质清晰", "confidence": "0.95"}, {"text": "音质清晰而且自然耐听", "category": "音质体验", "evidence_quote": "音质清晰", "confidence": 0.5}, {"text": "音质清晰而且自然好听", "category": "别的", "evidence_quote": "音质清晰"}, {"text": "音质清晰而且自然动听", "category": "音质体验", "evidence_quote": "没有这句"}]',
    '[]',
)
_JUDGED_CLAIMS = (
    ((0, None), (1, "duplicate"), (2, "row_not_an_object"), (3, "claim_too_short")),
    ((-1, "response_not_a_list"),),
    ((0, "unsupported_number"), (1, "low_confidence"), (2, "invalid_category"), (3, "evidence_not_in_report")),
    (),
)


def judged_claims(part: DataFrame) -> DataFrame:
    rows = part.select("p_partkey", rendered("p_partkey", CLAIMS).alias("json"))
    given = N.claim_candidates(rows, "p_partkey", "json").withColumn("source", rendered("p_partkey", ["佩戴时全天{b}小时无感。音质清晰。"]))
    rules = [(F.col("shape") == s, s) for s in ("response_not_a_list", "row_not_an_object")]
    rules += E.claim_rules("text", "category", "quote", "source", "confidence", ("佩戴体验", "音质体验"), "^[0-9A-Z .%-]+$")
    return E.validated(given, ["p_partkey"], ["place"], rules, F.lower(collapse_spaces("text")), 7)


@query(expected_sql("part", "p_partkey", ("place", "reason"), _JUDGED_CLAIMS, ()), "part")
def raw_claim_validation(part):
    """Consumer claims from raw JSON, with the two shapes that are none."""
    return judged_claims(part).select("p_partkey", "place", "reason")


_SENTENCE_SQL = r"""
s AS (SELECT item_id, unnest(list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: length(x) >= 6)) AS claim, unnest(range(len(list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: length(x) >= 6)))) AS pos FROM benchmark)
"""


@query(f"""
WITH {_SENTENCE_SQL}, b AS (SELECT item_id, pos, claim, 0 AS rank FROM s WHERE pos % 3 <> 1), a AS (SELECT item_id, pos, CASE WHEN pos % 2 = 0 THEN claim ELSE claim || '!' END AS claim, 1 AS rank FROM s),
f AS (SELECT item_id, lower(regexp_replace(claim, '\\s+', '', 'g')) AS k, min({{'rank': rank, 'pos': pos, 'claim': claim}}) AS f FROM (FROM b UNION ALL FROM a) GROUP BY ALL),
n AS (SELECT item_id, f.rank AS rank, f.pos AS pos, f.claim AS claim, row_number() OVER (PARTITION BY item_id ORDER BY f.rank, f.pos, f.claim) - 1 AS place FROM f)
SELECT item_id, pos, claim, CASE rank WHEN 0 THEN 'baseline' ELSE 'addition' END AS source, place FROM n WHERE place < 6
""", "benchmark")
def evidence_merge(benchmark):
    """Sentences that rules found, and those that another way added: each once, six of an item at most."""
    from partledger.functions.text import sentences

    rows = benchmark.select("item_id", F.posexplode(sentences("text")).alias("pos", "claim"))
    changed = F.when(F.col("pos") % 2 == 0, F.col("claim")).otherwise(F.concat("claim", F.lit("!")))
    merged = N.merged_evidence(rows.filter("pos % 3 <> 1"), rows.withColumn("claim", changed), ["item_id"], "pos", F.col("claim"), 6)
    return merged.select("item_id", F.col("pos").cast("long").alias("pos"), "claim", "source", F.col("place").cast("long").alias("place"))


def counts_sql(name: str, kinds, at: int) -> str:
    rows = ", ".join(f"({k}, {'NULL::VARCHAR' if r[at] is None else repr(r[at])})" for k, of_kind in enumerate(kinds) for r in of_kind)
    return f"SELECT '{name}' AS variant, reason FROM part JOIN (VALUES {rows}) e(kind, reason) ON p_partkey % {len(kinds)} = kind"


@query(f"""
WITH r AS ({counts_sql("parameters", _JUDGED, 2)} UNION ALL {counts_sql("claims", _JUDGED_CLAIMS, 1)})
SELECT variant, count(*) FILTER (reason IS NULL) AS accepted, count(reason) AS rejected, (SELECT string_agg(reason || '=' || n, ', ' ORDER BY reason) FROM (SELECT reason, count(*) AS n FROM r x WHERE x.variant = r.variant AND reason IS NOT NULL GROUP BY reason)) AS reasons FROM r GROUP BY variant
""", "part")
def extraction_evaluation(part):
    """What each way of extraction gives and why the rest was rejected."""
    found = N.evaluation({"parameters": judged_parameters(part), "claims": judged_claims(part)}, "reason")
    return found.withColumn("reasons", F.concat_ws(", ", F.transform(F.map_entries("reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))))
