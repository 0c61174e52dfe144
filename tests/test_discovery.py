"""Predicates on odd values, and every outcome of the discovery gate."""

from pyspark.sql import functions as F

from partledger.operators import predicates as P


def test_predicates_on_nothing(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    t = F.col("t")
    got = df.select(P.is_roundup(t), P.is_concrete_part(t, t, t, t), P.is_automatic_price(t), P.well_named(t), P.well_named(t, t), P.is_quarantined(t, t, t), P.needs_identity_repair(t, t, t, t)).collect()
    assert [tuple(r) for r in got] == [(False, False, False, False, False, True, True)] * 2


def test_concrete_parts(spark):
    long = "说" * 221
    rows = [("主板", "x", "", ""), ("主板", long, "", ""), ("主板", long, "M1", ""), ("音质", "x", "", ""), ("主板", "外包装与主板", "", ""), ("盒子", "x", "", ""), ("usb接口", "x", "", "")]
    got = spark.createDataFrame(rows, "c string, e string, m string, b string").select(P.is_concrete_part(F.col("c"), F.col("e"), F.col("m"), F.col("b"))).collect()
    assert [r[0] for r in got] == [True, False, True, False, False, False, True]


def test_every_outcome(spark):
    products = [(1, "acme--q30", "acme", "q30"), (2, "acme--q40", "acme", "q40"), (3, "", "zeta", "air7")]
    videos = [(10, "acme--q30", "", "acme", "q30"), (11, "acme--q40", "", "acme", "q40"), (12, "acme--q40", "", "acme", "q40"), (13, "", "seenair7", "", ""), (14, "", "nothing", "", ""), (15, "new--x900", "", "new", "x900"), (16, "new--x900", "", "new", "x900"), (17, "", "x", "", ""), (18, "other--y77", "", "other", "y77")]
    known = [(11, "acme--q40", "queued", 5), (15, "new--x900", "failed", 1), (16, "new--x900", "processing", 2), (17, "", "published", 3), (18, "other--y77", "discovered", 4)]
    reports = [(1, 5, 1), (2, 9, 0), (2, 4, 3)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = P.discovered_videos(
        make(videos, "item long, canonical string, title string, brand string, model string"), make(known, "video long, canonical string, status string, created long"),
        make(products, "product long, canonical string, brand string, model string"), make(reports, "product long, inventory long, images long"),
    )
    assert {r.video: (r.status, r.product, r.reason) for r in got.collect()} == {
        10: ("skipped_report_exists", 1, "complete_teardown_report_exists"), 11: ("queued", 2, "video_already_registered"), 12: ("candidate_secondary_video", 2, "primary_video:11"), 13: ("match_needs_review", 3, "model_only_needs_review"),
        14: ("match_needs_review", None, "brand_or_model_missing"), 15: ("candidate_secondary_video", None, "primary_video:16"), 16: ("processing", None, "video_already_registered"), 17: ("published", None, "video_already_registered"), 18: ("queued", None, "product_not_found_in_library"),
    }
