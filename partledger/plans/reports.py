"""Queries over what reports say outside their teardown, and over texts, links, captions and records of other layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from partledger.functions.text import mixed_tokens
from partledger.operators import captions as C
from partledger.operators import lexicons as L
from partledger.operators import records as R
from partledger.operators import repair
from partledger.operators import reports as P
from partledger.operators.blocks import html_media
from partledger.plans.extraction import expected_sql, rendered
from partledger.sources import readers, writers
from partledger.sources.shared import shared_path
from partledger.sources.tables import dealt, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str, *names: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(dealt(spark, sf_dir, n) for n in names))
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return keep


REPORTS = (
    "包装盒内部结构固定得很好一览无遗。内部结构由{a}颗螺丝固定在一起！机身内部由卡扣与胶水固定{b}处。供应商来自{a}号工厂。IPX{c}级的处理。佩戴起来很舒适。短句。内部结构由{a}颗螺丝固定在一起！",
    "螺丝一共有一颗。螺丝一共有两颗。螺丝一共有三颗。螺丝一共有四颗。螺丝一共有五颗。螺丝一共有六颗。充电接口为Type-C与usb-a。额定输入：5V，认证：CE。长度：{b}，宽度：{c}",
    "没有相关内容的一段话",
)
_FILTERED = (
    (("structure", 1, "内部结构由{a}颗螺丝固定在一起"), ("structure", 2, "机身内部由卡扣与胶水固定{b}处"), ("fasteners", 1, "内部结构由{a}颗螺丝固定在一起"), ("fasteners", 2, "机身内部由卡扣与胶水固定{b}处"), ("fasteners", 3, "内部结构由{a}颗螺丝固定在一起"),
     ("supply_hints", 1, "供应商来自{a}号工厂"), ("wear", 1, "佩戴起来很舒适")),
    tuple(("fasteners", k + 1, f"螺丝一共有{n}颗") for k, n in enumerate("一两三四五")),
    (),
)


@query(expected_sql("part", "p_partkey", ("filter", "place", "sentence"), _FILTERED, ("sentence",)), "part")
def report_filters(part):
    """Sentences about suppliers, fasteners, sealing, wear and structure, a few of each."""
    docs = part.select("p_partkey", F.replace(rendered("p_partkey", REPORTS), F.lit("IPX"), F.lit("等级")).alias("text"))
    return P.sentence_filters(docs, "p_partkey", "text")


_TECH = (
    (),
    (("charging_port", 1, "充电接口为Type-C与usb-a"), ("product_markings", 1, "额定输入：5V，认证：CE"), ("raw_candidates", 1, "长度：{b}，宽度：{c}"), ("ports", 1, "Type-C"), ("ports", 2, "usb-a")),
    (),
)


@query(expected_sql("part", "p_partkey", ("field", "place", "value"), _TECH, ("value",)), "part")
def report_tech_specs(part):
    """Sentences under the technical fields whose words they have, candidates for review, and ports."""
    docs = part.select("p_partkey", F.replace(rendered("p_partkey", REPORTS), F.lit("IPX"), F.lit("等级")).alias("text"))
    return P.tech_specs(docs, "p_partkey", "text")


IMAGES = (
    "电池 {a}mAh\n重量{c}.5g 尺寸 {b}mm\nBluetooth V5.3 type-c {a} MAH",
    "主控|恒玄|BES{a}\n主控 ｜ 恒玄 | BES{a}\n旭航诚电池{b}mAh\nIP{a}8与SY{b}88芯片\nab",
    "蓝牙版本5.{c} IPX{c}",
    "",
)
_IMAGE_SPECS = (
    ((1, "电池", "{a}", "mAh", 0.85), (2, "尺寸", "{b}", "mm", 0.7), (3, "重量", "{c}.5", "g", 0.75), (4, "充电接口", "type-c", "", 0.85), (5, "蓝牙", "5.3", "", 0.85)),
    ((1, "电池", "{b}", "mAh", 0.85), (2, "防护等级", "IP{a}8", "", 0.9)),
    ((1, "防护等级", "IPX{c}", "", 0.9), (2, "蓝牙", "5.{c}", "", 0.85)),
    (),
)


@query(expected_sql("part", "p_partkey", ("place", "part", "value", "unit", "confidence"), _IMAGE_SPECS, ("value",)), "part")
def image_specs(part):
    """Specifications in text read from images; a protection class has two digits at most."""
    texts = part.select("p_partkey", rendered("p_partkey", IMAGES).alias("text"))
    found = P.image_specs(texts, "p_partkey", "text")
    whole = F.when(F.col("part") == "防护等级", F.regexp_extract(F.col("text"), r"(?i)IP[X0-9]*", 0)).otherwise(F.col("value"))
    return found.join(texts, "p_partkey").select("p_partkey", "place", "part", whole.alias("value"), "unit", "confidence")


_IMAGE_PARTS = (
    ((1, "电池", "电池", "{a}mAh", ""),),
    ((1, "主控", "恒玄", "BES{a}", ""), (2, "电池", "旭航诚电池", "{b}mAh", ""), (3, "芯片/模组", "", "IP{a}8", "PMIC/充电仓管理")),
    (),
    (),
)


@query(expected_sql("part", "p_partkey", ("place", "component", "brand", "model", "role"), _IMAGE_PARTS, ("model",)), "part")
def image_parts(part):
    """Parts lists in text read from images: tables, batteries and chips."""
    return P.image_parts(part.select("p_partkey", rendered("p_partkey", IMAGES).alias("text")), "p_partkey", "text")


FORMS = (
    ("由半入耳式改为入耳式设计", "full_in_ear"), ("第{a}款半入耳式耳机", "semi_in_ear"), ("耳夹式与耳挂式都有", "ear_clip"), ("名为耳挂式，但实际是颈挂式运动耳机", "neckband"), ("头戴式降噪耳机，有线耳机模式", "headphone,wired"),
    ("从{a}代升级为更好的耳机，仍是骨传导耳机", "bone_conduction"), ("全入耳式", "full_in_ear"), ("普通产品", ""),
)


@query(expected_sql("part", "p_partkey", ("labels",), [((x,),) for _, x in FORMS], ()), "part")
def form_labels(part):
    """Forms that a text names, of what something was changed to or differs in."""
    return part.select("p_partkey", F.array_join(P.form_labels(rendered("p_partkey", [t for t, _ in FORMS])), ",").alias("labels"))


_UNBOXED = (
    (("packaging", 0, "包装正面印有{a}字样"), ("packaging", 1, "充电线与耳塞套{b}对"), ("earbuds", 0, "耳机重{c}克，外观小巧精致。采用磨砂质感处理；内部芯片特写")),
    (("packaging", 0, "只有描述的包装，{a}"),),
    (),
)
_BULLETS = ((("packaging", 1, "包装正面印有{a}字样", 3), ("earbuds", 1, "耳机重{c}克，外观小巧精致", 3), ("earbuds", 2, "采用磨砂质感处理", 3)), (("packaging", 1, "只有描述的包装，{a}", 3),), ())


def unboxed(part):
    """(p_partkey, module, description, accessories, captions) of two modules of each product."""
    of = lambda *texts: rendered("p_partkey", texts)
    none = F.array().cast("array<string>")
    kind = F.col("p_partkey") % 3
    packaging = part.select("p_partkey", F.lit("packaging").alias("module"), of("整体描述会被忽略", "只有描述的包装，{a}", "短").alias("description"), F.when(kind == 0, F.array(of("充电线与耳塞套{b}对", "", ""))).otherwise(none).alias("accessories"), F.when(kind == 0, F.array(of("包装正面印有{a}字样", "", ""), F.lit("拆解报告：某耳机"), of("包装 正面印有{a}字样", "", ""))).alias("captions"))
    earbuds = part.select("p_partkey", F.lit("earbuds").alias("module"), of("耳机重{c}克，外观小巧精致。采用磨砂质感处理；内部芯片特写", "特写", "").alias("description"), none.alias("accessories"), none.alias("captions"))
    return packaging.unionByName(earbuds)


@query(expected_sql("part", "p_partkey", ("module", "place", "text"), ((("packaging", 0, "充电线与耳塞套{b}对"), ("packaging", 1, "包装正面印有{a}字样"), _UNBOXED[0][2]), *_UNBOXED[1:]), ("text",)), "part")
def unboxing_sources(part):
    """Texts of an unboxing by module, each once."""
    return P.unboxing_source(unboxed(part), "p_partkey")


@query(expected_sql("part", "p_partkey", ("module", "place", "text", "priority"), ((("packaging", 1, "充电线与耳塞套{b}对", 3), ("packaging", 2, "包装正面印有{a}字样", 3), *_BULLETS[0][1:]), *_BULLETS[1:]), ("text",)), "part")
def unboxing_bullets(part):
    """What the texts of an unboxing say of the outside, with numbers first."""
    return P.unboxing_bullets(P.unboxing_source(unboxed(part), "p_partkey"), "p_partkey").drop("quote")


DIGESTS = (
    ('{"overview": " 共{a}款 ", "key_findings": [{"title": "", "text": "发现{b}"}, {"title": "空"}, {"title": "标题", "text": " 文 "}], "image_highlights": [{"url": "https://x.test/{a}"}, {"caption": "无"}, {"url": "u", "caption": "图"}]}', "共{a}款;关键发现=发现{b}|标题=文;https://x.test/{a}=原文配图|u=图"),
    ('{}', ";;"),
    ('not json', None),
)


@query(expected_sql("part", "p_partkey", ("digest",), [((x,),) for _, x in DIGESTS], ("digest",)), "part")
def roundup_digests(part):
    """Digests of roundups without findings that say nothing and images without a link."""
    d = part.select("p_partkey", P.roundup_digest(rendered("p_partkey", [t for t, _ in DIGESTS])).alias("d"))
    pairs = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x[a], x[b])), "|")
    return d.select("p_partkey", F.when(F.col("d").isNotNull(), F.concat_ws(";", "d.overview", pairs(F.col("d.key_findings"), "title", "text"), pairs(F.col("d.image_highlights"), "url", "caption"))).alias("digest"))


@query(r"""
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split(t, ' '), lambda w: length(w) >= 2), list_filter(list_transform(range(1, greatest(length(t), 2)), lambda i: substr(t, i, 2)), lambda p: regexp_matches(p, '^[\x{4e00}-\x{9fff}].$'))))), '|') AS tokens
FROM (SELECT conv_id, turn, trim(regexp_replace(lower('耳机' || conv_id || ' 拆解 ' || min(text)), '[^\p{L}\p{N}_]+', ' ', 'g')) AS t FROM conversations GROUP BY 1, 2)
""", "conversations")
def mixed_token_sets(conversations):
    """Tokens of texts that have ideographs and words."""
    turns = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    tokens = mixed_tokens(F.rtrim(F.regexp_replace(F.concat(F.lit("耳机"), F.col("conv_id").cast("string"), F.lit(" 拆解 "), "text"), r"[^\p{L}\p{N}_]+$", "")))
    return turns.select("conv_id", "turn", F.array_join(tokens, "|").alias("tokens"))


@query(r"""
SELECT doc_id, doc_id % 7 = 0 AND regexp_matches(text, '[^\x00-\x7F]') AS repaired, md5(text) AS digest FROM documents
""", "documents")
def windows_repair(documents):
    """Texts whose UTF-8 was read as Windows-1252 beside ideographs that were not, as every seventh is made here, as they were."""
    shown = F.translate(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), repair.CONTROLS, repair.WINDOWS)
    broken = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("拆解："), shown)).otherwise(F.concat(F.lit("拆解："), "text"))
    given = documents.select("doc_id", broken.alias("text"))
    again = repair.repaired_text(F.col("text"))
    return given.select("doc_id", (again != F.col("text")).alias("repaired"), F.md5(F.substring(again, F.lit(4), F.length(again))).alias("digest"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'https://x.test/é' || p_partkey WHEN 1 THEN 'https://x.test/' || p_partkey ELSE 'é' || p_partkey END AS link FROM part
""", "part")
def link_repair(part):
    """Links whose UTF-8 was read as Latin-1."""
    wrong = F.decode(F.encode(F.concat(F.lit("https://x.test/é"), F.col("p_partkey").cast("string")), "UTF-8"), "ISO-8859-1")
    link = F.when(F.col("p_partkey") % 3 == 0, wrong).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("https://x.test/"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("é"), F.col("p_partkey").cast("string")))
    return part.select("p_partkey", repair.repaired_link(link).alias("link"))


@query("""
WITH m AS (SELECT page_id, unnest([('image', 0, 'https://x.test/' || page_id || '.png', 'A b'), ('image', 1, 'c.jpg', ''), ('frame', 0, 'https://player.test/' || page_id, '')]) AS m FROM pages)
SELECT page_id, m[1] AS kind, m[2]::INT AS place, m[3] AS link, m[4] AS alt FROM m
""", "pages")
def page_media(pages):
    """Images and frames of pages, links without a scheme completed, what stands in scripts left out."""
    tail = F.concat(F.lit('<img alt="A b" src="//x.test/'), F.col("page_id").cast("string"), F.lit(".png\"><script>'<img src=no.png>'</script><IMG SRC=c.jpg><img alt=none><iframe class='x' src='//player.test/"), F.col("page_id").cast("string"), F.lit("'></iframe>"))
    return html_media(pages.select("page_id", F.concat(F.coalesce("html", F.lit("")), tail).alias("html")), "page_id", "html")


_CITIES = ("重庆", "北京", "安徽", "广州", "张家口", "李村", "apple", "Banana", "阿里", "上海")


@query(f"""
WITH c AS (SELECT p_partkey, p_type, list_value({", ".join(f"'{c}'" for c in _CITIES)})[p_partkey % {len(_CITIES)} + 1] || p_size AS name FROM part)
SELECT p_partkey, p_type, name, row_number() OVER (PARTITION BY p_type ORDER BY name COLLATE zh, p_partkey) - 1 AS place FROM c
""", "part")
def collated_places(part):
    """Places of names within a type, sorted as readers of Chinese expect; types are cut into ranges, not sorted in one task."""
    name = F.concat(F.element_at(F.array(*map(F.lit, _CITIES)), (F.col("p_partkey") % len(_CITIES) + 1).cast("int")), F.col("p_size").cast("string"))
    rows = part.select("p_partkey", "p_type", name.alias("name"))
    return R.numbered(rows, ["p_type"], [F.collate("name", "zh"), F.col("p_partkey")], "place")


@query("""
WITH t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(min(text), '[<>{}&]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM conversations GROUP BY 1, 2)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS cue, turn * 2.5::DOUBLE AS start, turn * 2.5 + 2::DOUBLE AS "end", md5(text || ' & co') AS digest FROM t
""", "conversations")
def source_json_captions(conversations):
    """Captions in the two layouts of JSON, with tags, styles and entities."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.min("text"), "[<>{}&]", " "), r"\s+", " "))
    turns = conversations.groupBy("conv_id", "turn").agg(text.alias("text"))
    said = F.concat(F.lit("<b>"), "text", F.lit("</b>\n{\\an8}&nbsp;&amp; co"))
    start, end = F.col("turn") * 2.5, F.col("turn") * 2.5 + 2
    cue = F.struct("turn", F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(start.alias("from"), end.alias("to"), said.alias("content")))).otherwise(F.to_json(F.struct(start.alias("start"), end.alias("end"), said.alias("text")))).alias("cue"))
    files = turns.groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(cue)), lambda c: c["cue"]), ","), F.lit("]")).alias("list"))
    content = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('﻿{"body": '), "list", F.lit("}"))).otherwise(F.col("list"))
    return readers.json_cues(files.select("conv_id", content.alias("content")), "conv_id", "content").select("conv_id", "cue", "start", "end", F.md5("text").alias("digest"))


@query("", "lineitem")
def caption_merge(lineitem):
    """Captions that follow at once and say the same, merged: suppliers' line items, a second for an order, texts by order numbers."""
    rows = lineitem.select(F.col("l_suppkey").alias("video"), (F.col("l_orderkey") * 1.0).alias("start"), (F.col("l_orderkey") + F.when(F.col("l_partkey") % 3 == 0, 0.5).otherwise(0.9)).alias("end"), rendered("l_partkey", ("这是耳机的主板", "这是耳机的主板特写", "另一段话", "这是耳机的主板。", "", "这是耳机主板")).alias("text"), F.lit(1).cast("long").alias("samples"))
    return C.merged_captions(rows.distinct(), "video", "start", "end", "text", "samples")


@query("""
SELECT s_suppkey::VARCHAR AS id, 'report' AS type, CASE WHEN s_suppkey % 2 = 0 THEN 'audio52' ELSE 'other' END AS source_id, s_name AS title, least(s_suppkey % 9, 6) AS points, CASE WHEN s_suppkey % 9 > 0 THEN 'p0' ELSE '' END AS summary, 2 AS specs, least(s_suppkey % 7, 5) AS notes, 'seen' AS captured_at FROM supplier
""", "supplier")
def upgraded_reports(supplier):
    """Records of the older layout in the present one."""
    texts = lambda n, name: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit(name), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    points, notes = texts((F.col("s_suppkey") % 9).cast("int"), "p"), texts((F.col("s_suppkey") % 7).cast("int"), "n")
    old = F.to_json(F.struct(
        F.col("s_suppkey").cast("string").alias("id"), F.when(F.col("s_suppkey") % 2 == 1, "other").alias("source_id"), F.lit("u").alias("url"), F.col("s_name").alias("title"), F.lit("seen").alias("first_seen_at"), F.transform(points, lambda p: F.struct(p.alias("text"))).alias("selling_points"),
        F.struct(F.array(F.lit("有线")).alias("charging_method"), F.array(F.lit("Type-C")).alias("charging_port"), notes.alias("manual_notes")).alias("tech_specs"),
    ))
    new = P.upgraded_reports(supplier.select(old.alias("json")), "json")
    v = "views"
    return new.select("id", "type", "source_id", "title", F.size(f"{v}.market.selling_points").cast("long").alias("points"), F.col(f"{v}.market.positioning_summary").alias("summary"), F.size(f"{v}.hardware.specs").alias("specs"), F.size(f"{v}.cost.packaging_notes").cast("long").alias("notes"), "captured_at")


@query("""
SELECT page_id, page_id % 4 = 0 AS reused, CASE WHEN page_id % 4 = 0 THEN 'i' || page_id ELSE '' END AS images FROM pages
""", "pages")
def image_reuse(pages):
    """Images that need not be fetched again: the page is as it was and had some."""
    old = pages.filter("page_id % 3 <> 7").select("page_id", F.when(F.col("page_id") % 2 == 1, F.concat("html", F.lit(" "))).otherwise(F.col("html")).alias("html"), F.when(F.col("page_id") % 4 == 2, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("i"), F.col("page_id").cast("string")))).alias("images"))
    return P.reused_images(pages, old, "page_id", "html", "images").withColumn("images", F.concat_ws(",", "images"))


@query("""
WITH s(source, layer, priority) AS (VALUES ('audio52', 'technical', 4), ('channel_multi', 'channel', 2), ('official_consumer', 'official', 3)), r AS (SELECT o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'audio52' WHEN 1 THEN 'channel_multi' WHEN 2 THEN 'official_consumer' ELSE 'review_stub' END AS source FROM orders)
SELECT o_custkey, arg_max(source, priority) AS best, max(priority) AS priority, count(*) AS records FROM r JOIN s USING (source) GROUP BY 1
""", "orders")
def source_registry(orders):
    """Each customer's most trusted source; sources that are not in use don't count."""
    names = F.array(*(F.lit(s) for s in ("audio52", "channel_multi", "official_consumer", "review_stub")))
    rows = orders.select("o_custkey", F.element_at(names, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("source"))
    held = rows.join(F.broadcast(P.source_layers(orders.sparkSession)), "source")  # one row for each source
    return held.groupBy("o_custkey").agg(F.max_by("source", "priority").alias("best"), F.max("priority").alias("priority"), F.count("*").alias("records"))


def sink_marked_csv(spark, sf_dir):
    """Evidence for spreadsheets, read back as text: a byte-order mark, a header and quoted rows."""
    path = shared_path(spark, "marked-csv")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.array(F.lit("a"), F.lit('b"')).alias("features"))
    writers.write_marked_csv(rows.coalesce(1), path, ["features"])
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(F.decode("content", "UTF-8").alias("c"))  # lines lose the mark
    return whole.select(F.explode(F.split(F.regexp_replace("c", "\n$", ""), "\n")).alias("line"))


QUERIES["sink_marked_csv"] = sink_marked_csv
ORACLE_SQL["sink_marked_csv"] = """
SELECT chr(65279) || '"s_suppkey","s_name","features"' AS line UNION ALL SELECT '"' || s_suppkey || '","' || s_name || '","a;b' || repeat('"', 3) FROM supplier
"""
