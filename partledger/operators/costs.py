"""The cells of a cost sheet from the views of a report: each the first source that has it, with the words that bear it out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from partledger.operators.reports import has_any

# What a row of a parts list is known by, where batteries sit, and names of specifications.
MAIN_WORDS, MAIN_ROW_WORDS = ("主控", "MCU", "SoC", "蓝牙"), ("主控", "蓝牙", "SoC", "MCU")
POWER_ROW_WORDS, POWER_CHIP_WORDS = ("PMIC", "充电仓管理", "电源管理", "PMU", "保护IC", "过压", "充电管理"), ("PMIC", "充电仓管理", "电源管理", "PMU", "保护IC", "过压")
BATTERY, CASE_SIDES, CASE_WORDS, EAR_SIDES, EAR_WORDS = "电池", ("充电盒", "Case", "仓"), ("充电盒", "充电仓", "座舱"), ("耳机", "左耳", "右耳", "L", "R"), ("耳机", "左耳", "右耳")
SPEAKER_WORDS, CAPACITY, PORT, LAYER, JOINT = ("喇叭", "扬声器", "动圈", "单元", "振膜"), "电池容量", "充电接口", "technical", "、"

ROWS = "array<struct<role: string, component: string, side: string, brand: string, model: string, evidence: string>>"
SPECS = "array<struct<param: string, value: string, unit: string, model: string, source_ref: string>>"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_of(rows: Column, holds) -> Column:
    """The first row of an array for which holds; null if there is none."""
    return F.get(F.filter(rows, holds), F.lit(0))


def row_words(row: Column) -> Column:
    return F.concat(text(row["role"]), text(row["component"]), text(row["side"]))


def row_name(row: Column) -> Column:
    """Brand and model of a row, or its component."""
    named = F.trim(F.concat(F.trim(text(row["brand"])), F.lit(" "), F.trim(text(row["model"]))))
    return F.when(named != "", named).otherwise(F.trim(text(row["component"])))


def cost_cells(bom: Column, chips: Column, specs: Column, fields: dict[str, Column], fallback_chips: Column | None = None, lists: Sequence[str] = ("materials", "codecs")) -> Column:
    """Array of (key, value, evidence, layer): the cells of a record's cost sheet, empty ones with empty values.

    bom and chips are ROWS, specs SPECS. A main chip is the first chip known as one, else the first row, else any chip, else a fallback; power chips come
    from rows before chips. A battery goes to the side that its row names; without one the first goes to the earbuds and the next to the
    case, and what is missing is taken from the capacity specification, the earbuds first. fields names the plain cells, values or lists of values.
    """
    bom, chips, specs = F.coalesce(bom, F.array().cast(ROWS)), F.coalesce(chips, F.array().cast(ROWS)), F.coalesce(specs, F.array().cast(SPECS))
    pair = lambda value, evidence: F.struct(text(value).alias("value"), text(evidence).alias("evidence"))
    nothing = F.struct(F.lit("").alias("value"), F.lit("").alias("evidence"))
    found = lambda row, value: F.when(row.isNotNull() & (text(value) != ""), pair(value, row["evidence"]))
    chip_name = lambda c: F.coalesce(F.nullif(c["model"], F.lit("")), c["component"])

    chip, row = first_of(chips, lambda c: has_any(row_words(c), MAIN_WORDS)), first_of(bom, lambda b: has_any(row_words(b), MAIN_ROW_WORDS))
    any_chip = F.get(chips, F.lit(0))
    spare = F.get(fallback_chips, F.lit(0)) if fallback_chips is not None else F.lit(None).cast("string")
    main = F.coalesce(found(chip, chip_name(chip)), found(row, row_name(row)), found(any_chip, chip_name(any_chip)), F.when(text(spare) != "", pair(spare, F.lit(""))), nothing)
    power_row, power_chip = first_of(bom, lambda b: has_any(row_words(b), POWER_ROW_WORDS)), first_of(chips, lambda c: has_any(row_words(c), POWER_CHIP_WORDS))
    power = F.coalesce(found(power_row, row_name(power_row)), found(power_chip, chip_name(power_chip)), nothing)

    side = lambda b: text(b["side"])
    in_case = lambda b: side(b).isin(*CASE_SIDES) | has_any(side(b), CASE_WORDS)
    in_ear = lambda b: ~in_case(b) & (side(b).isin(*EAR_SIDES) | has_any(side(b), EAR_WORDS))
    open_ = F.struct(nothing.alias("ear"), nothing.alias("case"))

    def placed(held: Column, b: Column) -> Column:
        here = pair(row_name(b), b["evidence"])
        no_ear, no_case = held["ear"]["value"] == "", held["case"]["value"] == ""
        nowhere = ~in_case(b) & ~in_ear(b)
        to_ear = no_ear & (in_ear(b) | nowhere)
        to_case = no_case & (in_case(b) | (nowhere & ~no_ear))
        return F.struct(F.when(to_ear, here).otherwise(held["ear"]).alias("ear"), F.when(to_case, here).otherwise(held["case"]).alias("case"))

    batteries = F.aggregate(F.filter(bom, lambda b: F.contains(text(b["component"]), F.lit(BATTERY))), open_, placed)
    capacity, port = first_of(specs, lambda s: s["param"] == CAPACITY), first_of(specs, lambda s: s["param"] == PORT)
    stated = F.when(capacity.isNotNull(), pair(F.trim(F.concat(text(capacity["value"]), F.lit(" "), text(capacity["unit"]))), capacity["source_ref"]))
    no_ear, no_case = batteries["ear"]["value"] == "", batteries["case"]["value"] == ""
    ear = F.when(no_ear, F.coalesce(stated, nothing)).otherwise(batteries["ear"])
    case = F.when(~no_ear & no_case, F.coalesce(stated, nothing)).otherwise(batteries["case"])
    either = F.struct(F.when(ear["value"] != "", ear["value"]).otherwise(case["value"]).alias("value"), F.when(ear["evidence"] != "", ear["evidence"]).otherwise(case["evidence"]).alias("evidence"))
    speaker = first_of(bom, lambda b: has_any(text(b["component"]), SPEAKER_WORDS))
    charging = F.when(port.isNotNull(), pair(F.coalesce(F.nullif(port["value"], F.lit("")), port["model"]), port["source_ref"]))

    cells = {
        "main_chip": main, "pmic": power, "battery_ear": ear, "battery_case": case, "battery": either, "speaker": F.when(speaker.isNotNull(), pair(row_name(speaker), speaker["evidence"])), "case_charging": charging, "bom_rows": pair(F.size(bom).cast("string"), F.lit("")),
        "battery_mah": stated, "charge_interface": F.when(port.isNotNull(), pair(port["value"], port["source_ref"])),
    }
    for name, c in fields.items():
        cells[name] = pair(F.array_join(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda v: text(v) != ""), JOINT) if name in lists else c, F.lit(""))
    return F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(c, nothing)["value"].alias("value"), F.coalesce(c, nothing)["evidence"].alias("evidence"), F.lit(LAYER).alias("layer")) for k, c in cells.items()))
