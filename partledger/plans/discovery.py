"""Queries over predicates of titles, parts and names, and over what becomes of discovered videos."""

from __future__ import annotations

from pyspark.sql import functions as F

from partledger.functions.identity import folded_key
from partledger.functions.text import canonical_id
from partledger.operators import predicates as P
from partledger.plans.extraction import expected_sql, rendered
from partledger.plans.names import _MATCH_SQL
from partledger.sources.tables import dealt

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str, *names: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(dealt(spark, sf_dir, n) for n in names))
        ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return keep


#: (title, sentence, component, evidence, model, source, media, video, category, location), and what holds of them.
WORK = (
    (("202{c}年度TWS耳机汇总", "采用蓝牙 5.{c} 芯片", "蓝牙芯片", "原文{a}", "", "jd", "0123456789abcdef.webp", "BV{a}", "头戴式耳机", "耳机"), (True, "年度汇总", True, False, True, True, True, True, False, True)),
    (("蓝牙音箱方案盘点", "包装盒里有说明书", "降噪系统", "原文{a}", "M{a}", "zol_{a}", "x.webp", "a b", "音箱", "耳机"), (True, "方案案例", False, True, False, True, False, False, True, True)),
    (("某耳机拆解", "支持LDAC认证", "外壳", "包装盒上的外壳", "", "report", "0123456789abcdef.jpg", "v{b}", "有线耳机", "别处"), (False, "品类汇总", False, False, False, False, False, True, True, False)),
    (("Top {b} 合集", "LDAC编码", "按键", "长" * 221, "", "", "", "", "半入耳式耳机", "充电盒"), (False, "品类汇总", True, False, False, False, False, False, False, True)),
    (("音箱汇总", "主控为QCC{a}", "按键", "长" * 221, "K{a}", "manual", "0123456789abcdeg.webp", "v", "耳挂式耳机", "充电盒"), (False, "品类汇总", True, False, True, False, False, False, False, True)),
)
_WORK = ("roundup", "round_kind", "technical", "packaging", "concrete", "automatic", "media", "video_media", "quarantined", "repair")


@query(expected_sql("part", "p_partkey", _WORK, [(w[1],) for w in WORK], ()), "part")
def work_predicates(part):
    """Predicates over titles, sentences, parts, prices and names, in one projection."""
    of = lambda i: rendered("p_partkey", [w[0][i] for w in WORK])
    title, sentence, component, evidence, model, source, media, video, category, location = map(of, range(10))
    return part.select(
        "p_partkey", P.is_roundup(title).alias("roundup"), P.roundup_kind(title).alias("round_kind"), P.is_technical(sentence).alias("technical"), P.is_packaging(sentence).alias("packaging"), P.is_concrete_part(component, evidence, model, F.lit("")).alias("concrete"),
        P.is_automatic_price(source).alias("automatic"), P.well_named(media).alias("media"), P.well_named(media, video).alias("video_media"), P.is_quarantined(F.lit("reported"), category, location).alias("quarantined"), P.needs_identity_repair(F.lit("b"), model, title, F.lit("")).alias("repair"),
    )


@query(_MATCH_SQL.strip().removesuffix("FROM k LEFT JOIN best USING (item)").rsplit("SELECT item, product", 1)[0].rstrip() + """, m AS (
  SELECT item AS video, k.canonical, product, CASE step WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.98 WHEN 3 THEN 0.82 ELSE NULL END::DOUBLE AS confidence, CASE step WHEN 3 THEN 'model_only_needs_review' END AS why FROM k LEFT JOIN best USING (item)
), done AS (
  SELECT DISTINCT l_partkey AS product FROM (SELECT l_partkey, l_suppkey, count(*) * 3 AS inventory, count(*) FILTER (l_tax > 0.04) AS images FROM lineitem GROUP BY 1, 2) WHERE inventory >= 5 AND images >= 1 AND l_partkey % 2 = 0
), known AS (
  SELECT item AS video, canonical, CASE p_size % 4 WHEN 0 THEN 'published' WHEN 1 THEN 'failed' WHEN 2 THEN 'queued' ELSE 'discovered' END AS status, p_size AS created FROM k JOIN part ON item = p_partkey WHERE p_partkey % 3 = 1
), f AS (
  SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY created, video) AS n FROM known WHERE status IN ('queued', 'published') AND canonical <> ''
), o AS (
  SELECT m.video, min(struct_pack(n, id := f.video)).id AS other FROM m JOIN f ON m.canonical = f.canonical AND f.video <> m.video GROUP BY 1
)
SELECT m.video, CASE WHEN known.status IN ('published', 'queued') THEN known.status WHEN confidence >= 0.92 AND done.product IS NOT NULL THEN 'skipped_report_exists' WHEN confidence >= 0.92 OR m.product IS NULL AND m.canonical <> '' THEN CASE WHEN other IS NULL THEN 'queued' ELSE 'candidate_secondary_video' END ELSE 'match_needs_review' END AS status,
  m.product, confidence, CASE WHEN known.status IN ('published', 'queued') THEN 'video_already_registered' WHEN confidence >= 0.92 AND done.product IS NOT NULL THEN 'complete_teardown_report_exists' WHEN (confidence >= 0.92 OR m.product IS NULL AND m.canonical <> '') AND other IS NOT NULL THEN 'primary_video:' || other
    WHEN confidence >= 0.92 THEN 'existing_product_missing_complete_teardown_report' WHEN m.product IS NOT NULL THEN why WHEN m.canonical = '' THEN 'brand_or_model_missing' ELSE 'product_not_found_in_library' END AS reason
FROM m LEFT JOIN done USING (product) LEFT JOIN known USING (video) LEFT JOIN o USING (video)
""", "part", "lineitem")
def video_discovery(part, lineitem):
    """What becomes of videos whose titles name products in several ways: skipped, queued, secondary, for review, or as they were."""
    size = F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 50).otherwise(0)
    title = F.concat(F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("New "), "p_brand", F.lit(": "))), "p_name", F.lit(" "), size, F.lit(", taken apart ("), "p_type", F.lit(")"))
    brand = F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).when(F.col("p_partkey") % 4 == 1, "Brand#3").otherwise("")
    whole = F.concat_ws(" ", "p_name", "p_size")
    model = F.when(F.col("p_partkey") % 5 == 0, whole).otherwise("")
    canonical = F.when((brand != "") & (model != ""), canonical_id(brand, model)).otherwise("")
    videos = part.select(F.col("p_partkey").alias("item"), canonical.alias("canonical"), folded_key(title).alias("title"), folded_key(brand).alias("brand"), folded_key(model).alias("model"))
    other = F.when(F.col("p_partkey") % 11 == 0, F.col("p_size").cast("string")).otherwise(folded_key(whole))
    products = part.select(F.col("p_partkey").alias("product"), F.when(F.col("p_partkey") % 2 == 0, canonical_id("p_brand", whole)).otherwise("").alias("canonical"), folded_key("p_brand").alias("brand"), other.alias("model"))
    reports = lineitem.filter("l_partkey % 2 = 0").groupBy(F.col("l_partkey").alias("product"), "l_suppkey").agg((F.count("*") * 3).alias("inventory"), F.count_if(F.col("l_tax") > 0.04).alias("images"))
    fourth = F.col("p_size") % 4
    status = F.when(fourth == 0, "published").when(fourth == 1, "failed").when(fourth == 2, "queued").otherwise("discovered")
    known = part.filter("p_partkey % 3 = 1").select(F.col("p_partkey").alias("video"), canonical.alias("canonical"), status.alias("status"), F.col("p_size").alias("created"))
    return P.discovered_videos(videos, known, products, reports)
