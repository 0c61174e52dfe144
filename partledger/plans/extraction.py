"""Queries that extract parts, sides and makers from reports. The tables hold no such reports, so their text is rendered from the
rows' numbers; the SQL says which rows each kind of report gives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from partledger.operators import extraction as E
from partledger.operators.blocks import html_blocks
from partledger.sources.tables import dealt

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: What {a}, {b} and {c} in a template stand for, from a row's id.
NUMBERS = {"{a}": (100, 900), "{b}": (30, 60), "{c}": (6, 9)}


def query(sql: str, *names: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(dealt(spark, sf_dir, n) for n in names))
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return keep


def rendered(key: str, templates: Sequence[str]) -> Column:
    """The template of a row's kind (its id modulo their number) with its numbers in it."""
    text = F.element_at(F.array(*map(F.lit, templates)), (F.col(key) % len(templates) + 1).cast("int"))
    for name, (least, span) in NUMBERS.items():
        text = F.replace(text, F.lit(name), (F.lit(least) + F.col(key) % span).cast("string"))
    return text


def quoted(value) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def expected_sql(name: str, key: str, columns: Sequence[str], kinds: Sequence[Sequence[tuple]], texts: Sequence[str]) -> str:
    """SQL for the rows that each kind of report gives; columns in texts have numbers in them."""
    rows = ", ".join(f"({k}, {', '.join(map(quoted, r))})" for k, of_kind in enumerate(kinds) for r in of_kind)

    def filled(c: str) -> str:
        for n, (least, span) in NUMBERS.items():
            c = f"replace({c}, '{n}', ({least} + {key} % {span})::VARCHAR)"
        return c

    shown = ", ".join(f"{filled(c)} AS {c}" if c in texts else c for c in columns)
    return f"WITH e(kind, {', '.join(columns)}) AS (VALUES {rows}) SELECT {key}, {shown} FROM {name} JOIN e ON {key} % {len(kinds)} = kind"


TEARDOWNS = (
    "<h4>一、产品开箱</h4><p>Type-C接口外观一览。</p><h4>二、产品拆解</h4><h4>充电盒拆解</h4><figure><img src=\"https://x.test/{a}/p.jpg\" alt=\"PMIC\"></figure><p>SinhMicro昇生微电子SSP{a}电源管理芯片，用于内置电池充电。</p>"
    "<figure><img src=\"https://x.test/{a}/m.jpg\" alt=\"MCU\"></figure><p>GigaDevice兆易创新GD32E{a}微控制器，用于整机控制。</p><p>丝印H{c}的TVS保护管，用于输入过压保护。</p><h4>耳机拆解</h4>"
    "<p>AIROHA达发（络达）AB{a}M蓝牙音频SoC，用于无线连接和音频处理。</p><p>丝印5V A{c}的IC。</p><p>连接天线的金属弹片。</p><h4>三、总结</h4><p>Type-C接口总结，不应重复进入清单。</p>",
    "<p>高通CSR{a}蓝牙音频SoC用于音频处理；内置电池容量{a}mAh。</p><p>我爱音频网总结：耳罩为硅胶材质，主控芯片为高通CSR8675，内置电池容量1200mAh，晶振。</p><p>晶振。</p>",
    "<h2>产品拆解</h2><h3>充电盒拆解</h3><p>充电盒内置锂电池组，型号：{a}130，额定容量：{a}mAh，额定能量：1.{b}Wh，标称电压：3.85V。</p><p>短</p><p>丝印G{a}的MEMS麦克风，旁边是骨传导麦克风。充电盒与耳机之间的Pogo Pin连接器！</p><p>同样的Pogo  Pin连接器。</p>",
    "<h2>耳机拆解</h2><p>Cirrus Logic凌云逻辑CS{b}L90，是一款低功耗音频编解码器。</p><p>耳机内有一个{b}mm的动圈单元和一个动铁单元。</p><h2>拆解全家福</h2><p>黑色泡棉，用于缓冲。主板通过BTB连接器连接。</p>",
)
_AUTO, _CASE, _EARBUD = "auto_extracted", "充电盒", "耳机"
_PARTS = (
    (
        ("电源管理芯片", "core", "SinhMicro昇生微电子", "SSP{a}", _CASE, "resolved", "", "SinhMicro昇生微电子SSP{a}电源管理芯片，用于内置电池充电。", "https://x.test/{a}/p.jpg", _AUTO),
        ("微控制器", "core", "GigaDevice兆易创新", "GD32E{a}", _CASE, "resolved", "", "GigaDevice兆易创新GD32E{a}微控制器，用于整机控制。", "https://x.test/{a}/m.jpg", _AUTO),
        ("TVS保护管", "key", "", "H{c}", _CASE, "resolved", "", "丝印H{c}的TVS保护管，用于输入过压保护。", "https://x.test/{a}/m.jpg", _AUTO),
        ("蓝牙音频SoC", "core", "AIROHA达发（络达）", "AB{a}M", _EARBUD, "resolved", "", "AIROHA达发（络达）AB{a}M蓝牙音频SoC，用于无线连接和音频处理。", "https://x.test/{a}/m.jpg", _AUTO),
        ("待识别器件", "unidentified_marking", "", "5VA{c}", _EARBUD, "resolved", "5V", "丝印5V A{c}的IC。", None, "needs_review"),
        ("天线弹片", "key", "", "", _EARBUD, "resolved", "", "连接天线的金属弹片。", None, _AUTO),
    ),
    (
        ("蓝牙音频SoC", "core", "", "CSR{a}", "", "needs_review", "", "高通CSR{a}蓝牙音频SoC用于音频处理；", None, _AUTO),
        ("电池", "core", "", "", "", "needs_review", "{a}mAh", "内置电池容量{a}mAh。", None, _AUTO),
    ),
    (
        ("电池", "core", "", "{a}130", _CASE, "resolved", "{a}mAh / 1.{b}Wh / 3.85V", "充电盒内置锂电池组，型号：{a}130，额定容量：{a}mAh，额定能量：1.{b}Wh，标称电压：3.85V。", None, _AUTO),
        ("MEMS麦克风", "core", "", "G{a}", _CASE, "resolved", "", "丝印G{a}的MEMS麦克风，旁边是骨传导麦克风。", None, _AUTO),
        ("Pogo Pin连接器", "auxiliary", "", "", _CASE, "resolved", "", "充电盒与耳机之间的Pogo Pin连接器！", None, _AUTO),
    ),
    (
        ("音频编解码器/DSP", "core", "Cirrus Logic凌云逻辑", "CS{b}L90", _EARBUD, "resolved", "", "Cirrus Logic凌云逻辑CS{b}L90，是一款低功耗音频编解码器。", None, _AUTO),
        ("动圈单元", "core", "", "", _EARBUD, "resolved", "{b}mm", "耳机内有一个{b}mm的动圈单元和一个动铁单元。", None, _AUTO),
        ("动铁单元", "core", "", "", _EARBUD, "resolved", "{b}mm", "耳机内有一个{b}mm的动圈单元和一个动铁单元。", None, _AUTO),
        ("缓冲泡棉", "structure", "", "", "", "needs_review", "", "黑色泡棉，用于缓冲。", None, _AUTO),
        ("BTB连接器", "auxiliary", "", "", "", "needs_review", "", "主板通过BTB连接器连接。", None, _AUTO),
    ),
)
_PART_COLUMNS = ("component", "classification", "brand", "model", "side", "side_status", "specification", "fact_text", "image", "review_status")


@query(expected_sql("pages", "page_id", _PART_COLUMNS, _PARTS, ("model", "specification", "fact_text", "image")), "pages")
def teardown_inventory(pages):
    """Parts of a teardown that stands at the end of each page's article, from the page's blocks."""
    html = pages.select("page_id", F.concat(F.coalesce("html", F.lit("")), rendered("page_id", TEARDOWNS)).alias("html"))
    return E.teardown_inventory(html_blocks(html, "page_id", "html"), "page_id").select("page_id", *_PART_COLUMNS)


PROSE = (
    "内部主要配置方面，充电盒搭载了WEL旭航诚3.7V/{a}mAh锂电池，采用了INJOINIC英集芯IP5528 TWS耳机充电仓管理SoC；还采用了Prisemi芯导P14C1S过压过流保护IC，保护电路安全。"
    "耳机内部搭载HJ弘捷新能源3.85V/{b}mAh软包扣式电池，采用{c}mm动圈单元，内置两颗MEMS麦克风，主控芯片为Bluetrum中科蓝讯BT89{b}F蓝牙音频SoC。",
    "主控芯片为高通CSR{a}蓝牙音频SoC；此外耳机内置电池容量{a}mAh。",
    "座舱内部设有SY{b}88电源管理芯片，再次提到SY{b}88。耳机采用{c}.5mm双单元。内置加速度传感器与 QCC{a} 芯片，以及麦克风。",
    "没有任何配置的说明。",
)
_PROSE_COLUMNS = ("place", "component", "brand", "model", "qty", "side", "role", "confidence")
_PROSE_PARTS = (
    (
        (1, "芯片/模组", "INJOINIC英集芯", "INJOINIC英集芯IP5528", "1", _CASE, "PMIC/充电仓管理", 0.85),
        (2, "芯片/模组", "Prisemi芯导", "Prisemi芯导P14C1S", "1", _CASE, "保护IC", 0.85),
        (3, "电池", "WEL旭航诚", "3.7V/{a}mAh锂电池", "1", _CASE, "major", 0.85),
        (4, "芯片/模组", "Bluetrum中科蓝讯", "Bluetrum中科蓝讯BT89{b}F", "1", _EARBUD, "主控/蓝牙", 0.85),
        (5, "电池", "HJ弘捷新能源", "3.85V/{b}mAh软包扣式", "1", _EARBUD, "major", 0.85),
        (6, "喇叭单元", "", "{c}mm 动圈单元", "1", _EARBUD, "major", 0.8),
        (7, "麦克风", "", "MEMS麦克风", "2", _EARBUD, "major", 0.78),
    ),
    ((1, "芯片/模组", "Qualcomm高通", "高通CSR{a}", "1", "", "主控/蓝牙", 0.85), (2, "电池", "", "{a}mAh", "1", _EARBUD, "major", 0.85)),
    (
        (1, "芯片/模组", "思远半导体", "SY{b}88", "1", _CASE, "PMIC/充电仓管理", 0.85),
        (2, "芯片/模组", "Qualcomm高通", "QCC{a}", "1", _EARBUD, "传感器", 0.85),
        (3, "喇叭单元", "", "{c}.5mm 双单元", "1", _EARBUD, "major", 0.8),
        (4, "麦克风", "", "麦克风", "", _EARBUD, "major", 0.78),
    ),
    (),
)


@query(expected_sql("part", "p_partkey", _PROSE_COLUMNS, _PROSE_PARTS, ("model",)), "part")
def prose_parts(part):
    """Parts from the prose of a summary, one for each product."""
    texts = part.select("p_partkey", rendered("p_partkey", PROSE).alias("text"))
    return E.prose_parts(texts, "p_partkey", "text").select("p_partkey", *_PROSE_COLUMNS)


#: (component, reported brand, evidence), and the maker, its basis and its quote.
MAKERS = (
    (("bluetooth_audio_soc", "", "JL杰理科技AC{a}F6蓝牙音频SoC，支持双模。"), ("JL杰理科技", "compact_source_component_wording", "JL杰理科技AC{a}F6蓝牙音频SoC")),
    (("battery", "", "充电盒内置锂离子电池，容量{a}mAh，来自紫建电子。"), ("紫建电子", "explicit_source_text", "来自紫建电子")),
    (("battery", "", "盒盖内侧产品信息：耳机型号X{a}，电池容量{b}mAh，制造商：某某科技有限公司。"), ("", "unknown", "")),
    (("mcu", "", "主控来自{a}号厂，型号不详。"), ("{a}号厂", "explicit_source_text", "来自{a}号厂")),
    (("sensor", "Bosch", "其他；内置Bosch的{c}轴加速度计；用于降噪。"), ("Bosch", "reported_component_brand", "内置Bosch的{c}轴加速度计；")),
    (("sensor", "Sony", "没有写厂商。"), ("", "unknown", "")),
    (("battery", "紫建", "{b}mAh电池的生产商紫建，额定。"), ("紫建", "reported_component_brand", "{b}mAh电池的生产商紫建，额定。")),
    (("audio_codec_dsp", "", "高通与恒玄的音频芯片。"), ("", "unknown", "")),
    (("memory", "", "泉声电子，不详供应商：未知。"), ("", "unknown", "")),
    (("battery", "", "采用紫建电子的钢壳电池，充电管理芯片来自思远半导体。"), ("紫建电子", "explicit_source_text", "采用紫建电子的钢壳电池")),
    (("battery", "", "内置{b}mAh软包电池，充电管理芯片来自思远半导体。"), ("", "unknown", "")),
    (("power_management_ic", "", "芯片特写，{a}度；钰泰与微源；昇生微SS{a}MCU。"), ("昇生微", "compact_source_component_wording", "昇生微SS{a}MCU")),
)


@query(expected_sql("part", "p_partkey", ("manufacturer", "basis", "quote"), [(m[1],) for m in MAKERS], ("manufacturer", "quote")), "part")
def manufacturer_evidence(part):
    """Who makes a part, from its evidence: one vendor beside a noun, a relation that no guard forbids, or the reported brand."""
    kind = (F.col("p_partkey") % len(MAKERS) + 1).cast("int")
    of = lambda i: F.element_at(F.array(*(F.lit(m[0][i]) for m in MAKERS)), kind)
    maker = E.manufacturer_from_evidence(rendered("p_partkey", [m[0][2] for m in MAKERS]), of(1), of(0))
    return part.select("p_partkey", maker.alias("m")).select("p_partkey", "m.*")


LABELLED = (
    "最高主频为{a}MHz，{b}KB SRAM，高达{a}KB的片上闪存。",
    "额定容量：{a}mAh，额定能量：{b}.5Wh，标称电压：3.85V，充电限制电压4.4V。",
    "Arm Cortex-M{b} RISC内核，用于整机控制与管理；集成USART+UART与{b}路ADC。",
    "没有参数。",
)
_LABELLED = (
    (("最高主频", "{a}MHz", 0), ("SRAM", "{b}KB", 12), ("片上闪存", "{a}KB", 22)),
    (("额定容量", "{a}mAh", 0), ("额定能量", "{b}.5Wh", 12), ("标称电压", "3.85V", 24), ("充电限制电压", "4.4V", 35)),
    (("处理器内核", "Arm Cortex-M{b} RISC内核", 0), ("主要用途", "用于整机控制与管理", 22), ("集成功能", "集成USART+UART与{b}路ADC", 32), ("接口资源", "集成USART+UART与{b}路ADC", 32)),
    (),
)


@query(expected_sql("part", "p_partkey", ("label", "value", "start"), _LABELLED, ("value",)), "part")
def labelled_parameters(part):
    """Parameters by a table of rules, each with its value and where it stands."""
    texts = part.select(F.col("p_partkey").alias("id"), rendered("p_partkey", LABELLED).alias("text"))
    rules = part.sparkSession.createDataFrame([(label, literal, pattern) for label, literal, pattern in E.L.PARAMETER_RULES], "rule string, literal string, pattern string")
    return E.rule_table_spans(texts, rules).select(F.col("id").alias("p_partkey"), F.col("rule").alias("label"), "value", F.col("start").cast("int").alias("start"))


#: (component, evidence, stated label and value), and the materials.
MADE = (
    (("电池", "电池采用钢壳，容量{a}mAh。", None), "钢壳"),
    (("外壳", "外壳为PC+ABS材质，{b}克。", None), "PC+ABS / PC / ABS"),
    (("固定支架", "支架由塑料制成；屏蔽罩为不锈钢。", None), "塑料"),
    (("振膜", "{c}mm 石墨振膜。", ("材质", "复合")), "石墨"),
    (("硅胶耳塞", "佩戴舒适。", ("材料", "硅胶")), "硅胶"),
    (("麦克风", "陶瓷天线，与麦克风。", None), ""),
    (("主板", "主板为塑料，" + "说明" * 260, None), ""),
)


@query(expected_sql("part", "p_partkey", ("material",), [((m[1],),) for m in MADE], ()), "part")
def material_hints(part):
    """Materials that the evidence ties to a part."""
    kind = (F.col("p_partkey") % len(MADE) + 1).cast("int")
    stated = F.element_at(F.array(*(F.array(F.struct(F.lit((m[0][2] or ("", ""))[0]).alias("label"), F.lit((m[0][2] or ("", ""))[1]).alias("value"), F.lit("").alias("quote"))) for m in MADE)), kind)
    component = F.element_at(F.array(*(F.lit(m[0][0]) for m in MADE)), kind)
    return part.select("p_partkey", E.material_hint(rendered("p_partkey", [m[0][1] for m in MADE]), component, stated).alias("material"))
