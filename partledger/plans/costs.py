"""A query over cost sheets; products stand for reports, whose parts lists are rendered from the rows' numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partledger.operators import costs as C
from partledger.plans.extraction import NUMBERS, expected_sql
from partledger.sources.tables import dealt

#: Of each kind: rows of the parts list and chips (role, component, side, brand, model, evidence), specifications (param, value, unit, model, source).
REPORTS = (
    (
        (("", "电池", "充电盒", "紫建", "B{a}", "盒内电池{a}"), ("", "电池", "右耳", "", "E{b}", "耳内电池"), ("major", "动圈单元", "耳机", "", "", "单元{c}"), ("充电管理", "芯片", "充电盒", "英集芯", "IP{a}", "管理")),
        (("", "音频 SoC", "耳机", "", "AB{a}", "主控{a}"),),
        (("充电接口", "Type-C", "", "", "口"), ("电池容量", "{b}", "mAh", "", "容量")),
    ),
    (
        (("", "电池", "", "", "", "一"), ("", "电池", "", "Z", "{a}", "二"), ("主控/蓝牙", "芯片", "耳机", "高通", "QCC{a}", "三")),
        (("保护IC", "芯片", "", "", "P{b}", "四"), ("", "别的", "", "", "O", "五")),
        (("充电接口", "", "", "USB{c}", "六"),),
    ),
    ((), (("", "某模块", "", "", "", "七"),), (("电池容量", "{a}", "", "", "八"), ("电池容量", "9", "mAh", "", "九"))),
    ((), (), ()),
)
_CELLS = (
    (("main_chip", "AB{a}", "主控{a}"), ("pmic", "英集芯 IP{a}", "管理"), ("battery_ear", "E{b}", "耳内电池"), ("battery_case", "紫建 B{a}", "盒内电池{a}"), ("battery", "E{b}", "耳内电池"), ("speaker", "动圈单元", "单元{c}"), ("case_charging", "Type-C", "口"), ("bom_rows", "4", ""),
     ("battery_mah", "{b} mAh", "容量"), ("charge_interface", "Type-C", "口"), ("materials", "硅胶、铝", ""), ("ip_rating", "IPX4", "")),
    (("main_chip", "高通 QCC{a}", "三"), ("pmic", "P{b}", "四"), ("battery_ear", "电池", "一"), ("battery_case", "Z {a}", "二"), ("battery", "电池", "一"), ("case_charging", "USB{c}", "六"), ("bom_rows", "3", ""), ("materials", "硅胶、铝", ""), ("ip_rating", "IPX4", "")),
    (("main_chip", "某模块", "七"), ("battery_ear", "{a}", "八"), ("battery", "{a}", "八"), ("bom_rows", "0", ""), ("battery_mah", "{a}", "八"), ("materials", "硅胶、铝", ""), ("ip_rating", "IPX4", "")),
    (("main_chip", "备用{c}", ""), ("bom_rows", "0", ""), ("materials", "硅胶、铝", ""), ("ip_rating", "IPX4", "")),
)


def numbered(value: str) -> Column:
    """A text with a row's numbers in it."""
    out = F.lit(value)
    for name, (least, span) in NUMBERS.items():
        if name in value:
            out = F.replace(out, F.lit(name), (F.lit(least) + F.col("p_partkey") % span).cast("string"))
    return out


def of_kind(i: int, names: tuple[str, ...], kind: str) -> Column:
    rows = [F.array(*(F.struct(*(numbered(v).alias(n) for v, n in zip(r, names, strict=True))) for r in report[i])).cast(kind) for report in REPORTS]
    out = rows[-1]
    for k, r in reversed(list(enumerate(rows[:-1]))):
        out = F.when(F.col("p_partkey") % len(REPORTS) == k, r).otherwise(out)
    return out


def cost_sheets(spark, sf_dir):
    """The filled cells of each report's cost sheet."""
    row = ("role", "component", "side", "brand", "model", "evidence")
    fields = {"materials": F.array(F.lit("硅胶"), F.lit(""), F.lit("铝")), "ip_rating": F.lit("IPX4"), "form_factor": F.lit(None).cast("string")}
    cells = C.cost_cells(of_kind(0, row, C.ROWS), of_kind(1, row, C.ROWS), of_kind(2, ("param", "value", "unit", "model", "source_ref"), C.SPECS), fields, F.array(numbered("备用{c}")))
    return dealt(spark, sf_dir, "part").select("p_partkey", F.explode(F.filter(cells, lambda c: c["value"] != "")).alias("c")).select("p_partkey", F.col("c.key").alias("cell"), "c.value", "c.evidence")


QUERIES = {"cost_sheets": cost_sheets}
ORACLE_SQL = {"cost_sheets": expected_sql("part", "p_partkey", ("cell", "value", "evidence"), _CELLS, ("value", "evidence"))}
