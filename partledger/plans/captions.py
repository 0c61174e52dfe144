"""Queries over captions and facts of videos. Suppliers stand for videos, their line items in order for captions; texts are rendered
from the rows' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partledger.operators import captions as C
from partledger.operators import lexicons as L
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


CAPTIONS = (
    "这是一颗电源管理芯片", "型号 IP{a}TS", "额定电压{c}V", "用于整机供电", "扬声器特写", "容量{a}mAh", "来自泉声电子", "内置电池", "丝印 HL{b}00", "无线音频传输IC", "最后来看一下外观", "内部主要配置方面", "接着往下拆", "以上就是它的拆解", "麦克风放大器", "32位MCU CH{a}", "总结一下全部内容", "工作频率{b}MHz", "蓝牙音频SoC BT{a}9", "",
)


def captions(lineitem: DataFrame) -> DataFrame:
    """(video, start, end, id, text): each supplier's line items by order number, an eighth of a second for an order."""
    rows = lineitem.select(F.col("l_suppkey").alias("video"), (F.col("l_orderkey") / 8.0).alias("start"), (F.col("l_orderkey") * 1000 + F.col("l_partkey") % 100 * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") + F.col("l_linenumber")).alias("k"))
    return rows.select("video", "start", (F.col("start") + 1.0).alias("end"), "id", rendered("k", CAPTIONS).alias("text"))


@query("", "lineitem")
def caption_context(lineitem):
    """Each caption with the block of captions that describe the same component."""
    return C.context_blocks(captions(lineitem).distinct(), "video", "start", "end", "id", "text")


_CAPTION_SQL = f"""
t(k, template) AS (VALUES {", ".join(f"({k}, '{t}')" for k, t in enumerate(CAPTIONS))}),
c AS (SELECT l_suppkey AS video, l_orderkey / 8.0::DOUBLE AS start, l_orderkey * 1000 + l_partkey % 100 * 10 + l_linenumber AS id, replace(replace(replace(template, '{{a}}', (100 + kk % 900)::VARCHAR), '{{b}}', (30 + kk % 60)::VARCHAR), '{{c}}', (6 + kk % 9)::VARCHAR) AS text
  FROM (SELECT *, l_partkey + l_linenumber AS kk FROM lineitem) JOIN t ON kk % {len(CAPTIONS)} = k)
"""


@query(f"""
WITH {_CAPTION_SQL}, d AS (SELECT *, max(start) OVER (PARTITION BY video) AS duration FROM c),
h AS (SELECT *, start >= duration * {L.SUMMARY_FROM} AND regexp_matches(text, '{"|".join(L.SUMMARY_STRONG)}') AS strong, start >= duration * {L.SUMMARY_FROM} AND NOT regexp_matches(text, '{"|".join(L.SUMMARY_STRONG)}') AND regexp_matches(text, '{"|".join(L.SUMMARY_WEAK)}') AS weak FROM d),
f AS (SELECT video, arg_min(struct_pack(start, text), (start, id)) FILTER (strong AND video % 3 <> 0) AS s, arg_min(struct_pack(start, text), (start, id)) FILTER (weak AND regexp_matches(text, '{L.SUMMARY_OPENING}')) AS w, max(start) FILTER (weak AND contains(text, '{L.SUMMARY_OUTRO}')) AS outro,
  count(*) FILTER (strong AND video % 3 <> 0) AS strong, count(*) FILTER (weak) AS weak FROM h GROUP BY video),
g AS (SELECT *, coalesce(s, CASE WHEN outro > w.start THEN w END) AS chosen FROM f)
SELECT video, chosen IS NOT NULL AS detected, chosen.start AS summary_start, chosen.text AS evidence, strong, weak FROM g
""", "lineitem")
def summary_starts(lineitem):
    """Where each video's summary begins; a third of the videos have no strong cue."""
    rows = captions(lineitem)
    text = F.when((F.col("video") % 3 == 0) & F.col("text").rlike("|".join(L.SUMMARY_STRONG)), "").otherwise(F.col("text"))
    whole = rows.groupBy("video").agg(F.max("start").alias("duration"))
    return C.summary_start(rows.withColumn("text", text).join(whole, "video"), "video", "start", "id", "text", "duration")


FACTS = (
    "包装盒内有充电线与{b}条配件", "充电盒为{c}色磨砂外观", "佩戴稳固，重{c}克", "耳罩表面材质柔软", "支持{a}毫秒游戏模式", "音效有{c}种", "兼容{b}款设备，连接方式便捷", "内置{c}mm单元", "人体工学设计舒适", "充电仓续航{b}小时", "接口防水 IPX{c}",
)
_SECTIONS, _GIVEN_TOPICS = ("", "", "", "market", "", "specification", "unboxing_earbuds"), ("", "音质体验", "其他")


@query(f"""
WITH t(k, template) AS (VALUES {", ".join(f"({k}, '{t}')" for k, t in enumerate(FACTS))}),
f AS (SELECT l_suppkey AS product, l_orderkey * 10 + l_linenumber AS place, CASE kk % 7 WHEN 3 THEN 'market' WHEN 5 THEN 'specification' WHEN 6 THEN 'unboxing_earbuds' ELSE '' END AS given, CASE kk % 3 WHEN 1 THEN '音质体验' WHEN 2 THEN '其他' ELSE '' END AS topic0,
  CASE WHEN l_suppkey % 2 = 0 THEN '耳挂式耳机' ELSE '头戴式耳机' END AS category, replace(replace(replace(template, '{{a}}', (100 + kk % 900)::VARCHAR), '{{b}}', (30 + kk % 60)::VARCHAR), '{{c}}', (6 + kk % 9)::VARCHAR) AS text
  FROM (SELECT *, l_partkey + l_suppkey AS kk FROM lineitem) JOIN t ON (kk % {len(FACTS)}) = k AND (l_suppkey % 5 <> 0 OR k > 3)),
s AS (SELECT *, CASE WHEN given = 'market' OR given LIKE 'unboxing_%' THEN given WHEN regexp_matches(text, '{L.SECTION_RULES[0][1]}') THEN 'unboxing_packaging' WHEN regexp_matches(text, '{L.SECTION_RULES[1][1]}') THEN 'unboxing_charging_case'
  WHEN regexp_matches(text, '{L.SECTION_RULES[2][1]}') THEN 'unboxing_earbuds' WHEN regexp_matches(text, '{L.SECTION_RULES[3][1]}') THEN 'market' WHEN given <> '' THEN given ELSE 'specification' END AS section FROM f),
m AS (SELECT *, CASE WHEN section = 'market' THEN CASE WHEN topic0 = '音质体验' THEN topic0 {" ".join(f"WHEN regexp_matches(text, '{p}') THEN '{t}'" for t, p in L.TOPIC_RULES)} ELSE '{L.TOPIC_DEFAULT}' END END AS topic FROM s),
o AS (SELECT product, section, text, min(place) AS place FROM m WHERE section LIKE 'unboxing_%' GROUP BY ALL),
d AS (SELECT product, coalesce(string_agg(text, '；' ORDER BY place, text) FILTER (section = 'unboxing_packaging'), '') AS packaging, coalesce(string_agg(text, '；' ORDER BY place, text) FILTER (section = 'unboxing_charging_case'), '') AS charging_case, coalesce(string_agg(text, '；' ORDER BY place, text) FILTER (section = 'unboxing_earbuds'), '') AS earbuds FROM o GROUP BY product),
c AS (SELECT product, count(*) AS facts, max(category) AS category, coalesce(bool_or(section = 'market' AND contains(text, '游戏')), false) AS games, {", ".join(f"count(*) FILTER (topic = '{t}') AS t{i}" for i, t in enumerate(L.TOPICS))} FROM m GROUP BY product)
SELECT product, facts, concat_ws(', ', {", ".join(f"CASE WHEN t{i} > 0 THEN '{t}:' || t{i} END" for i, t in enumerate(L.TOPICS))}) AS topics, CASE WHEN games THEN '游戏' ELSE '' END AS scenarios, coalesce(packaging, '') AS packaging, coalesce(charging_case, '') AS charging_case, coalesce(earbuds, '') AS earbuds,
  least(1.0, ((coalesce(packaging, '') <> '')::INT + (coalesce(charging_case, '') <> '')::INT + (coalesce(earbuds, '') <> '')::INT) / CASE WHEN category = '耳挂式耳机' THEN 3 ELSE 2 END)::DOUBLE AS completeness
FROM c LEFT JOIN d USING (product)
""", "lineitem")
def video_profiles(lineitem):
    """Profiles of products (suppliers here) from their facts (line items): topics, scenarios, what was unboxed."""
    k = F.col("l_partkey") + F.col("l_suppkey")
    rows = lineitem.withColumn("k", k).filter("l_suppkey % 5 <> 0 or k % 11 > 3")
    given = F.element_at(F.array(*map(F.lit, _SECTIONS)), (F.col("k") % len(_SECTIONS) + 1).cast("int"))
    topic = F.element_at(F.array(*map(F.lit, _GIVEN_TOPICS)), (F.col("k") % len(_GIVEN_TOPICS) + 1).cast("int"))
    facts = rows.select(F.col("l_suppkey").alias("product"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), rendered("k", FACTS).alias("text"), given.alias("given"), topic.alias("topic0"), F.when(F.col("l_suppkey") % 2 == 0, "耳挂式耳机").otherwise("头戴式耳机").alias("category"))
    found = C.video_profile(facts, "product", "at", "text", F.col("given"), F.col("topic0"), "category")
    listed = F.concat_ws(", ", F.transform(F.map_entries("topics"), lambda e: F.concat_ws(":", e["key"], e["value"])))
    return found.withColumns({"topics": listed, "scenarios": F.array_join("scenarios", ",")})


#: (context, narrative side), and component, brand, model, side, role and parameters.
SOURCES = (
    (("蓝牙音频SoC；JL杰理科技AC{a}F6蓝牙音频SoC；工作频率{b}MHz", "耳机"), ("bluetooth_audio_soc", "JL杰理科技", "AC{a}F6", "耳机", "core", "频率={b}MHz")),
    (("充电盒内置锂离子电池；容量{a}mAh；标称电压3.8V；能量{c}.1Wh；来自紫建电子", ""), ("battery", "紫建电子", "", "充电盒", "core", "容量={a}mAh|能量={c}.1Wh|电压=3.8V|功率={c}.1W")),
    (("霍尔元件；丝印 HL{b}00；尺寸为{c}x5", "别处"), ("sensor", "", "HL{b}00", "", "auxiliary", "尺寸={c}x5")),
    (("外壳特写；型号：{a}000", "充电盒"), ("enclosure", "", "{a}000", "充电盒", "structure", "")),
    (("没有部件", ""), None),
    (("一块电池", ""), None),
)
_SOURCE_COLUMNS = ("component_key", "brand", "model", "side", "role", "parameters")


@query(expected_sql("part", "p_partkey", _SOURCE_COLUMNS, [() if s[1] is None else (s[1],) for s in SOURCES], ("model", "parameters")), "part")
def caption_parts(part):
    """Parts of caption blocks, all of it verbatim."""
    kind = (F.col("p_partkey") % len(SOURCES) + 1).cast("int")
    blocks = part.select("p_partkey", rendered("p_partkey", [s[0][0] for s in SOURCES]).alias("context"), F.element_at(F.array(*(F.lit(s[0][1]) for s in SOURCES)), kind).alias("told"))
    found = C.caption_parts(blocks, "context", F.col("told"))
    listed = F.array_join(F.transform("parameters", lambda p: F.concat_ws("=", p["label"], p["value"])), "|")
    return found.withColumn("parameters", listed).select("p_partkey", *_SOURCE_COLUMNS)


#: (text, component, brand, model, side), and what is left of the proposal.
PROPOSALS = (
    (("耳机主板采用高通QCC{a}蓝牙音频SoC", "蓝牙音频SoC", "高通", "QCC{a}", "主板"), ("bluetooth_audio_soc", "高通", "QCC{a}", "主板")),
    (("耳机主板采用高通QCC{a}蓝牙音频SoC", "蓝牙音频SoC", "恒玄", "BES2500", "左耳"), ("bluetooth_audio_soc", "", "", "耳机")),
    (("耳机主板采用高通QCC{a}蓝牙音频SoC", "麦克风", "高通", "QCC{a}", ""), None),
    (("充电盒电池容量{a}mAh", "电池", "", "{a}mAh", ""), ("battery", "", "", "充电盒")),
    (("电池特写", "电池", "", "", ""), None),
    (("某存储器，型号：{a}55", "存储器", "", "{a}55", ""), ("memory", "", "{a}55", "")),
)


@query(expected_sql("part", "p_partkey", ("component_key", "brand", "model", "side"), [() if s[1] is None else (s[1],) for s in PROPOSALS], ("model",)), "part")
def proposed_parts(part):
    """Proposals of parts that their captions bear out."""
    column = lambda i, name: rendered("p_partkey", [p[0][i] for p in PROPOSALS]).alias(name)
    rows = part.select("p_partkey", column(0, "context"), column(1, "component"), column(2, "brand"), column(3, "model"), column(4, "side"), F.lit("").alias("narrative_side"), F.lit(0.99).alias("confidence"))
    return C.gated_proposals(rows, "context").select("p_partkey", "component_key", "brand", "model", "side")
