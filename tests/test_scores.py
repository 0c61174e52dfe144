"""Scores and identities on odd rows."""

from pyspark.sql import functions as F

from partledger.operators import scores as S


def test_completeness_bounds(spark):
    everything = {f: F.lit(True) for _, f, _ in S.FILLED}
    many = {f: F.lit(99) for _, f, _, _ in S.LISTED}
    full = min(1.0, 0.65 + 0.35), min(1.0, 0.2 + 0.95), min(1.0, 0.55 + 0.45), 1.0, min(1.0, 0.75 + 0.25)
    got = spark.range(1).select(S.view_completeness(everything, many).alias("all"), S.view_completeness({}, {}).alias("none"), S.view_completeness({"brand": F.lit(None).cast("boolean")}, {"specs": F.lit(-1), "codecs": F.lit(None).cast("int")}).alias("odd")).first()
    assert (got["all"], got["none"], got["odd"]) == (round(sum(full) / 5, 3), 0.0, 0.0)


def test_unboxing_scores_without_values(spark):
    null = F.lit(None).cast("int")
    got = spark.range(1).select(S.unboxing_scores(F.lit("packaging"), F.lit(None).cast("string"), null, null, null, null, null).alias("s"), S.unboxing_scores(F.lit("earbuds"), F.lit(" " + "x" * 300 + " "), F.lit(3), F.lit(2), F.lit(1), null, F.lit(1)).alias("t")).first()
    assert tuple(got.s) == (0, 0, 0, 0) and tuple(got.t) == (100, 100, 50, 83)


def test_identities_of_records_without_overrides(spark):
    records = spark.createDataFrame([(1, "a", "b", "x"), (2, "c", "d", None), (3, "e", "f", "x")], "record long, brand string, model string, category string")
    product = "array<struct<brand: string, model: string, category: string, confidence: double>>"
    overrides = spark.createDataFrame([(1, "multi_headphone", [("p", "q", "w", 0.95), ("r", "", "w", 1.0), (None, "s", "w", 1.0)]), (2, "single_headphone", None), (3, "multi_headphone", [("p", "q", "other", None)])], f"record long, decision string, products {product}")
    got = sorted(map(tuple, S.record_identities(records, overrides, ("w",)).collect()))
    assert got == [(1, "p", "q", "w", True), (2, "c", "d", None, False), (3, "e", "f", "x", False)]
    assert S.record_identities(records, overrides.limit(0), ("w",)).count() == 3


def test_summaries_of_nothing(spark):
    empty = spark.createDataFrame([], "rule_hint string, label string, resolved string, allowed boolean, evidence boolean, segment boolean, status string, agree boolean")
    row = S.classifier_summary(empty, ("a",)).first()
    assert (row["sample"], row.allowed_rate, row.agreement_rate, row.manual_review) == (0, 0.0, 0.0, 0)
    assert S.error_guard(spark.createDataFrame([("a", None), ("b", "error")], "k string, o string"), "k", "o").filter("blocked").select("k").first().k == "b"
