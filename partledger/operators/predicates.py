"""Predicates that pick rows for work, as expressions, and the gate that decides what becomes of a discovered video."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partledger.functions.spans import any_marker
from partledger.operators import lexicons as L
from partledger.operators.reports import has_any
from partledger.operators.similarity import match_products
from partledger.sources.shared import merged


def is_roundup(title: Column, markers: Sequence[str] = L.ROUNDUP_MARKERS, topics: Sequence[str] = L.HEADPHONE_MARKERS) -> Column:
    """Whether a title announces a round-up of the products that are meant."""
    title = F.coalesce(title, F.lit(""))
    return has_any(title, markers) & any_marker(title, topics)


def roundup_kind(title: Column) -> Column:
    case, yearly, other = L.ROUNDUP_KINDS
    return F.when(has_any(title, L.CASE_STUDY_MARKERS), case).when(F.contains(title, F.lit(L.YEARLY_WORD)) | title.rlike(L.YEAR_IN_TITLE), yearly).otherwise(other)


def is_concrete_part(component: Column, evidence: Column, model: Column, brand: Column) -> Column:
    """Whether a coarse row of a parts list is a physical part with evidence of its own: no packaging, no function, and no long passage
    unless model or brand is named."""
    name, said = F.trim(F.coalesce(component, F.lit(""))), F.trim(F.coalesce(evidence, F.lit("")))
    unnamed = (F.coalesce(model, F.lit("")) == "") & (F.coalesce(brand, F.lit("")) == "")
    return (name != "") & (said != "") & ~has_any(said, L.PACKAGING_EVIDENCE) & ~name.isin(*L.NO_PARTS) & ~((F.length(said) > L.LONGEST_UNNAMED) & unnamed) & name.rlike(L.CONCRETE_PART)


def is_automatic_price(source: Column) -> Column:
    """Whether a price came from a listing that was matched by a program, so that it may be refreshed."""
    source = F.coalesce(source, F.lit(""))
    return source.isin(*L.AUTOMATIC_PRICES) | F.startswith(source, F.lit(L.AUTOMATIC_PREFIX))


def is_technical(sentence: Column, chips: Sequence[str] = L.CHIP_PATTERNS) -> Column:
    """Whether a sentence is about technology: two of its words, or one and a chip, a Bluetooth version, or a codec without a benefit."""
    low = F.lower(sentence)
    hits = sum((F.when(F.contains(low, F.lit(w.lower())), 1).otherwise(0) for w in L.TECH_WORDS), F.lit(0))
    chip = sentence.rlike(f"(?iu)(?:{'|'.join(f'(?:{p})' for p in chips)})")
    return (hits >= 2) | ((hits == 1) & chip) | sentence.rlike(L.BLUETOOTH_VERSION) | (sentence.rlike(L.CODEC) & ~has_any(sentence, L.CODEC_BENEFITS))


def is_packaging(sentence: Column) -> Column:
    return has_any(sentence, L.PACKAGING_WORDS)


def needs_identity_repair(brand: Column, model: Column, title: Column, reason: Column) -> Column:
    """Whether a record's identity has to be looked at: no brand, a model too long to be one, a reason for review, or a title that compares."""
    return (F.coalesce(brand, F.lit("")) == "") | (F.length(F.coalesce(model, F.lit(""))) > L.LONGEST_MODEL) | (F.coalesce(reason, F.lit("")) != "") | any_marker(F.coalesce(title, F.lit("")), L.COMPARISON_MARKERS)


def is_quarantined(model_status: Column, category: Column, location: Column) -> Column:
    """Rows that no comparison shows: a model that is a parameter, or a category or place that is not trusted."""
    return (F.coalesce(model_status, F.lit("")) == "invalid_parameter_value") | ~F.coalesce(category.isin(*L.TRUSTED_CATEGORIES), F.lit(False)) | ~F.coalesce(location.isin(*L.TRUSTED_LOCATIONS), F.lit(False))


def well_named(media: Column, video: Column | None = None) -> Column:
    """Whether a media name is one (of a video, if its id is given): nothing else reaches the store."""
    if video is None:
        return F.coalesce(media.rlike(L.MEDIA_NAME), F.lit(False))
    return F.coalesce(media.rlike(L.VIDEO_MEDIA_NAME) & video.rlike(L.VIDEO_ID), F.lit(False))


def complete_reports(reports: DataFrame, inventory: str, images: str, least: int = L.INVENTORY_ROWS) -> DataFrame:
    """(product) with a report of so many inventory rows and an image, so that a video can add nothing."""
    return reports.filter((F.col(inventory) >= least) & (F.col(images) >= 1)).select("product").distinct()


def discovered_videos(videos: DataFrame, known: DataFrame, products: DataFrame, reports: DataFrame) -> DataFrame:
    """(video, status, product, confidence, reason) for each discovered video.

    videos has (item, canonical, title, brand, model) as match_products takes them; known (video, canonical, status, created); products as
    match_products takes them; reports (product, inventory, images). A video that is known and not open again keeps its status. A
    sure match (0.92) with a complete report is skipped; a sure one without, and one that no product matches but that names itself, is
    queued, or secondary where another active video stands for the same candidate (the first by time, then id); everything else is for
    review. Of the active videos of a candidate the first two are kept, since one may be the video itself.
    """
    matched = match_products(videos, products).withColumnRenamed("item", "video")
    done = complete_reports(reports, "inventory", "images").withColumn("done", F.lit(True))
    rank = F.row_number().over(Window.partitionBy("canonical").orderBy("created", "video"))
    active = known.filter(F.col("status").isin(*L.ACTIVE_STATUSES) & (F.col("canonical") != "")).withColumn("n", rank).filter("n <= 2")
    primary = active.groupBy("canonical").agg(F.sort_array(F.collect_list(F.struct("n", F.col("video").alias("id")))).alias("first"))
    old = known.filter(~F.col("status").isin(*L.OPEN_STATUSES)).select("video", F.col("status").alias("old"))
    held = videos.select(F.col("item").alias("video"), F.coalesce("canonical", F.lit("")).alias("canonical")).join(merged(matched), "video").join(merged(done), "product", "left").join(merged(primary), "canonical", "left").join(merged(old), "video", "left")
    other = F.get(F.filter("first", lambda f: f["id"] != F.col("video")), F.lit(0))["id"]
    sure = F.col("product").isNotNull() & (F.col("confidence") >= L.SURE)
    queued = lambda reason: F.when(other.isNotNull(), F.struct(F.lit("candidate_secondary_video").alias("status"), F.concat(F.lit("primary_video:"), other.cast("string")).alias("reason"))).otherwise(F.struct(F.lit("queued").alias("status"), F.lit(reason).alias("reason")))
    said = lambda status, reason: F.struct(status.alias("status"), reason.alias("reason"))
    outcome = (
        F.when(F.col("old").isNotNull(), said(F.col("old"), F.lit("video_already_registered")))
        .when(sure & F.col("done"), said(F.lit("skipped_report_exists"), F.lit("complete_teardown_report_exists")))
        .when(sure, queued("existing_product_missing_complete_teardown_report"))
        .when(F.col("product").isNotNull(), said(F.lit("match_needs_review"), F.col("reason")))
        .when(F.col("canonical") == "", said(F.lit("match_needs_review"), F.lit("brand_or_model_missing")))
        .otherwise(queued("product_not_found_in_library"))
    )
    return held.withColumn("o", outcome).select("video", "o.status", "product", "confidence", "o.reason")
