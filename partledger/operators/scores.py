"""Scores and summaries of records: completeness over views, unboxing modules, classifier rates, crawl errors, and identities after review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a filled field adds to its view (view, field, points), and what each item of a list adds up to a cap (view, field, points, cap).
FILLED = (
    ("market", "brand", 0.15), ("market", "model", 0.1), ("market", "scenarios", 0.1), ("market", "price", 0.15), ("market", "launch_date", 0.15), ("cost", "process_hints", 0.1), ("cost", "summary_images", 0.05), ("cost", "summary_text", 0.05),
    ("structure", "earbud_type", 0.15), ("structure", "materials", 0.15), ("structure", "ip_rating", 0.15), ("structure", "wear_design", 0.1), ("software", "bluetooth_version", 0.25), ("software", "multipoint", 0.15), ("software", "app_features", 0.15), ("software", "ota_support", 0.1),
    ("software", "latency_notes", 0.1),
)
LISTED = (
    ("market", "selling_points", 0.07, 0.35), ("cost", "major_parts", 0.06, 0.35), ("cost", "chip_modules", 0.08, 0.25), ("cost", "bom_table", 0.04, 0.25), ("cost", "ocr_rows", 0.02, 0.1), ("structure", "internal_structure", 0.06, 0.3),
    ("structure", "key_images", 0.03, 0.15), ("hardware", "specs", 0.2, 1.0), ("software", "codecs", 0.08, 0.25),
)
VIEWS = ("market", "cost", "structure", "hardware", "software")
#: A description of so many characters, and so many accessories, are whole.
DESCRIBED, ACCESSORIES = 120, 5
READY = ("high_confidence_candidate", "medium_confidence_candidate")
UNASSIGNED = ("needs_review", "invalid_output")
SURE = 0.9


def view_completeness(filled: dict[str, Column], sizes: dict[str, Column]) -> Column:
    """How complete a record's five views are: of each the points of its filled fields and of its lists up to their caps, 1 at most; the
    mean, in thousandths. filled and sizes name fields (booleans) and lists (their lengths); what isn't named counts as empty."""

    def score(view: str) -> Column:
        points = [F.when(F.coalesce(filled[f], F.lit(False)), p).otherwise(0.0) for v, f, p in FILLED if v == view and f in filled]
        points += [F.least(F.lit(cap), p * F.greatest(F.coalesce(sizes[f], F.lit(0)), F.lit(0))) for v, f, p, cap in LISTED if v == view and f in sizes]
        return F.least(F.lit(1.0), sum(points, F.lit(0.0)))

    return F.bround(sum((score(v) for v in VIEWS[1:]), score(VIEWS[0])) / len(VIEWS), 3)


def percent(part: Column, whole: Column) -> Column:
    """A whole number from 0 to 100, halves up; 0 where there is nothing to divide by."""
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(100), F.floor(part / F.nullif(whole, F.lit(0)) * 100 + 0.5).cast("int"))), F.lit(0))


def unboxing_scores(module: Column, description: Column, shown: Column, images: Column, listed: Column, accessories: Column, teardown: Column) -> Column:
    """(description, images, third, overall) of an unboxing's module in percent: characters of 120, images that are kept of all, and
    of the packaging accessories of five, of other modules images of the teardown."""
    text = F.length(F.trim(F.coalesce(description, F.lit(""))))
    none = lambda c: F.coalesce(c, F.lit(0))
    bars = [percent(text, F.lit(DESCRIBED)), percent(none(shown), F.greatest(none(images), none(listed), F.lit(1))), F.when(module == "packaging", percent(none(accessories), F.lit(ACCESSORIES))).otherwise(percent(none(teardown), F.greatest(none(images), F.lit(1))))]
    return F.struct(bars[0].alias("description"), bars[1].alias("images"), bars[2].alias("third"), F.floor((bars[0] + bars[1] + bars[2]) / 3.0 + 0.5).cast("int").alias("overall"))


def classifier_summary(results: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row of rates (of four digits) and counts over a classifier's results, in one aggregation: (rule_hint, label, resolved, allowed, evidence,
    segment, status, agree). Rates of nothing are 0. Distributions are maps of few labels."""
    assigned, explicit = ~F.col("resolved").isin(*UNASSIGNED), F.col("rule_hint").isin(*labels)
    high, ready = F.col("status") == READY[0], F.col("status").isin(*READY)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    rate = lambda c, of: F.bround(n(c) / F.greatest(n(of), F.lit(1)), 4)
    every = F.lit(True)
    totals = results.agg(
        F.count("*").alias("sample"), rate(F.col("allowed"), every).alias("allowed_rate"), rate(F.col("evidence"), every).alias("evidence_rate"), rate(F.col("segment"), every).alias("segment_rate"), rate(high, every).alias("high_rate"),
        n(assigned).alias("assigned"), n(F.col("resolved") == UNASSIGNED[0]).alias("abstained"), rate(assigned & F.col("evidence"), assigned).alias("assigned_evidence_rate"), rate(assigned & F.col("segment"), assigned).alias("assigned_segment_rate"),
        rate(assigned & high, assigned).alias("assigned_high_rate"), n(F.col("status") == READY[1]).alias("medium"), rate(ready, every).alias("ready_rate"), rate(explicit & F.col("agree"), explicit).alias("agreement_rate"), n(explicit).alias("compared"), n(~ready).alias("manual_review"),
    )
    return totals


def label_counts(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(of, label, count) of several columns, in one pass."""
    return results.select(F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).alias("label")) for c in columns))).alias("e")).groupBy("e.of", "e.label").agg(F.count("*").alias("count"))


def error_guard(outcomes: DataFrame, key: str, outcome: str, failed: str = "error", most: float = 0.5) -> DataFrame:
    """(key, items, errors, rate, blocked) of each run: blocked where more than a share of its items failed, which tells of a changed layout."""
    counts = outcomes.groupBy(key).agg(F.count("*").alias("items"), F.count_if(F.col(outcome) == failed).alias("errors"))
    rate = F.col("errors") / F.greatest(F.col("items"), F.lit(1))
    return counts.select(key, "items", "errors", F.bround(rate, 4).alias("rate"), (rate > most).alias("blocked"))


def record_identities(records: DataFrame, overrides: DataFrame, categories: Sequence[str]) -> DataFrame:
    """(record, brand, model, category, reviewed) of records after review: one row, several, or none for each.

    records has (record, brand, model, category); overrides (record, decision, products: array of brand, model, category, confidence). A record that
    is no headphone goes. A single or a split one becomes the products that are sure (0.9) and whole, with the record's own category where
    that is one of categories; where none is, and without a decision, the record's own identity stays.
    """
    held = records.join(overrides, "record", "left").filter(F.coalesce(F.col("decision") != "not_headphone", F.lit(True)))
    own = F.col("category")
    kind = lambda p: F.when(own.isin(*categories), own).otherwise(p["category"])
    sure = F.filter("products", lambda p: (F.coalesce(p["confidence"], F.lit(0.0)) >= SURE) & (F.trim(p["brand"]) != "") & (F.trim(p["model"]) != "") & kind(p).isin(*categories))
    split = F.transform(F.when(F.col("decision").isin("single_headphone", "multi_headphone"), sure), lambda p: F.struct(F.trim(p["brand"]).alias("brand"), F.trim(p["model"]).alias("model"), kind(p).alias("category"), F.lit(True).alias("reviewed")))
    itself = F.array(F.struct("brand", "model", "category", F.lit(False).alias("reviewed")))
    return held.select("record", F.explode(F.when(F.size(split) > 0, split).otherwise(itself)).alias("i")).select("record", "i.*")
