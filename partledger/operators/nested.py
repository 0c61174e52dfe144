"""Nested records as variants: strings at any depth, objects inside prose, and candidates read from raw JSON with reasons for odd shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partledger.operators.records import numbered
from partledger.sources.shared import written

#: Members whose values are identities, not text to show.
HIDDEN_MEMBERS = ("url",)


def parsed(text: Column | str) -> Column:
    """A text that is JSON, and nothing behind it, as a variant; else null. (The parser alone stops at the first value's end.)"""
    text = F.col(text) if isinstance(text, str) else text
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(alone, "$[1]", "variant").isNull(), F.try_variant_get(alone, "$[0]", "variant"))


def kind(v: Column) -> Column:
    """What a variant is: OBJECT, ARRAY, STRING, VOID or the name of another scalar; null for null."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def text_of(v: Column) -> Column:
    """A string or scalar as text; null for objects, arrays and nulls."""
    return F.when(~kind(v).isin("OBJECT", "ARRAY", "VOID"), F.try_variant_get(v, "$", "string"))


def members(rows: DataFrame, v: str) -> DataFrame:
    """rows with pos, key and value, one for each member of an object or element of an array; others have none."""
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(v).outer()))


def display_strings(rows: DataFrame, key: str, json: str, hidden: Sequence[str] = HIDDEN_MEMBERS) -> DataFrame:
    """(key, path, text) for every string of nested JSON, at any depth, without hidden members and what is in them.

    A path names members by dots and elements by numbers in brackets. A round opens one level of all rows, and rounds end when no
    row has containers left, so they are as many as the deepest record is deep. What isn't JSON has no strings.
    """
    level = rows.select(key, F.lit("").alias("path"), parsed(json).alias("value")).filter("value is not null")
    found = None
    while True:
        level = written(level.withColumn("kind", kind(F.col("value"))).filter(F.col("kind").isin("OBJECT", "ARRAY", "STRING")), "variant-level")
        strings = level.filter("kind = 'STRING'").select(key, "path", F.try_variant_get("value", "$", "string").alias("text"))
        found = strings if found is None else found.unionByName(strings)
        open_ = level.filter("kind <> 'STRING'")
        if open_.limit(1).count() == 0:
            return found
        inner = members(open_.select(key, F.col("path").alias("outer"), F.col("value").alias("v")), "v")
        inner = inner.filter(F.col("key").isNull() | ~F.col("key").isin(*hidden)) if key != "key" else inner
        path = F.when(F.col("key").isNull(), F.concat("outer", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("outer") == "", F.col("key")).otherwise(F.concat_ws(".", "outer", "key"))
        level = inner.select(F.col(key), path.alias("path"), "value")


def first_object(text: Column) -> Column:
    """The first JSON object of a text that may have fences or prose around it, nested as it is; null if there is none.

    A text that is JSON as a whole has to be an object. Else the first brace opens it, and braces outside strings are counted to
    the one that closes it; what lies between has to be JSON.
    """
    bare = F.regexp_replace(F.trim(text), r"(?is)^```(?:json)?\s*|\s*```$", "")
    start = F.instr(bare, "{")
    rest = F.substring(bare, start, F.length(bare))
    begun = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("read"), F.lit(0).alias("end"))

    def read(s: Column, c: Column) -> Column:
        quoted = F.when(s["quoted"], ~((c == '"') & ~s["escaped"])).otherwise(c == '"')
        depth = s["depth"] + F.when(s["quoted"], 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        at = s["read"] + 1
        return F.when(s["end"] > 0, s).otherwise(F.struct(depth.alias("depth"), quoted.alias("quoted"), (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"), at.alias("read"), F.when(depth == 0, at).otherwise(0).alias("end")))

    end = F.aggregate(F.split(rest, ""), begun, read, lambda s: s["end"])
    inside = F.when((start > 0) & (end > 0), F.substring(rest, F.lit(1), end))
    whole = parsed(bare)
    return F.when(whole.isNotNull(), F.when(kind(whole) == "OBJECT", bare)).when(parsed(inside).isNotNull(), inside)


def listed(rows: DataFrame, keep: Sequence[str], v: str, item: str, place: str, not_a_list: str, not_an_object: str) -> DataFrame:
    """(keep, place, item, shape): the elements of a variant that should be a list of objects; shape says what is wrong, and where
    all of it is no list a row without an element says that."""
    held = rows.withColumn("_kind", F.coalesce(kind(F.col(v)), F.lit("VOID")))
    bad = held.filter("_kind <> 'ARRAY'").select(*keep, F.lit(-1).alias(place), F.lit(None).cast("variant").alias(item), F.lit(not_a_list).alias("shape"))
    each = members(held.filter("_kind = 'ARRAY'").select(*keep, F.col(v).alias("_v")), "_v")
    shape = F.when(kind(F.col("value")) != "OBJECT", not_an_object)
    return each.select(*keep, F.col("pos").alias(place), F.col("value").alias(item), shape.alias("shape")).unionByName(bad)


def member_text(v: str, *names: str) -> Column:
    """The first of some members that is not empty, as text; an empty string if there is none."""
    return F.coalesce(*(F.nullif(F.trim(text_of(F.try_variant_get(v, f"$.{n}", "variant"))), F.lit("")) for n in names), F.lit(""))


def parameter_candidates(rows: DataFrame, key: str, json: str, row_keys: DataFrame) -> DataFrame:
    """Parameters in raw JSON, {"items": [{"key", "parameters": [{"label", "value", "evidence_quote"}]}]} or the list alone, as rows (key,
    item, place, row_key, label, value, quote, shape).

    shape is null where there is a parameter to judge; else, in the order of the levels, response_items_not_a_list,
    item_not_an_object, unknown_row_key (not in row_keys, which has key and row_key), parameters_not_a_list or parameter_not_an_object.
    """
    raw = rows.select(key, parsed(json).alias("v"))
    items = F.when(kind(F.col("v")) == "OBJECT", F.try_variant_get("v", "$.items", "variant")).otherwise(F.col("v"))
    level = listed(raw.withColumn("v", items), [key], "v", "i", "item", "response_items_not_a_list", "item_not_an_object").withColumn("row_key", member_text("i", "key"))
    known = row_keys.select(key, "row_key", F.lit(True).alias("known"))
    level = level.join(known, [key, "row_key"], "left").withColumn("shape", F.coalesce("shape", F.when(F.col("known").isNull(), "unknown_row_key")))
    kept = [key, "item", "row_key"]
    over = level.filter("shape is not null").select(*kept, F.lit(-1).alias("place"), F.lit(None).cast("variant").alias("p"), "shape")
    given = level.filter("shape is null").select(*kept, F.try_variant_get("i", "$.parameters", "variant").alias("v")).withColumn("v", F.when(F.coalesce(kind(F.col("v")), F.lit("VOID")) == "VOID", F.parse_json(F.lit("[]"))).otherwise(F.col("v")))
    params = listed(given, kept, "v", "p", "place", "parameters_not_a_list", "parameter_not_an_object").unionByName(over)
    return params.select(*kept, "place", F.rtrim(member_text("p", "label"), F.lit("：:")).alias("label"), F.rtrim(member_text("p", "value"), F.lit("。")).alias("value"), member_text("p", "evidence_quote").alias("quote"), "shape")


def claim_candidates(rows: DataFrame, key: str, json: str) -> DataFrame:
    """Consumer claims in raw JSON, a list of objects, as rows (key, place, text, category, quote, confidence, shape); shape is
    response_not_a_list, row_not_an_object or null."""
    level = listed(rows.select(key, parsed(json).alias("v")), [key], "v", "c", "place", "response_not_a_list", "row_not_an_object")
    sure = F.greatest(F.least(F.coalesce(F.nullif(member_text("c", "confidence").try_cast("double"), F.lit(0.0)), F.lit(0.8)), F.lit(1.0)), F.lit(0.0))
    return level.select(key, "place", member_text("c", "text", "claim").alias("text"), member_text("c", "category", "tag").alias("category"), member_text("c", "evidence_quote").alias("quote"), sure.alias("confidence"), "shape")


def merged_evidence(baseline: DataFrame, additions: DataFrame, keys: Sequence[str], order: str, signature: Column, limit: int) -> DataFrame:
    """Validated rows of two sources with their source: those of the baseline first, then additions, each signature once, limit of a
    key at most. A row without a signature goes."""
    rows = baseline.withColumn("source", F.lit("baseline")).unionByName(additions.withColumn("source", F.lit("addition")))
    signed = rows.withColumn("_s", F.nullif(F.lower(F.regexp_replace(signature, r"\s+", "")), F.lit(""))).filter("_s is not null")
    rest = [c for c in rows.columns if c not in (*keys, "source", order)]
    at = F.when(F.col("source") == "baseline", 0).otherwise(1)
    first = signed.groupBy(*keys, "_s").agg(F.min(F.struct(at.alias("at"), F.col(order).alias(order), "source", *rest)).alias("f")).select(*keys, "f.*")
    return numbered(first, keys, [F.col("at"), F.col(order)], "place").filter(F.col("place") < limit).select(*rows.columns, "place")


def evaluation(variants: dict[str, DataFrame], reason: str) -> DataFrame:
    """(variant, accepted, rejected, reasons): how many candidates each way of extraction gives, and the rejected by reason."""
    rows = None
    for name, df in variants.items():
        one = df.select(F.lit(name).alias("variant"), F.col(reason).alias("reason"))
        rows = one if rows is None else rows.unionByName(one)
    counts = rows.groupBy("variant", "reason").agg(F.count("*").alias("n"))
    by_reason = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))))
    return counts.groupBy("variant").agg(F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("accepted"), F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))), F.lit(0)).alias("rejected"), by_reason.alias("reasons"))
