"""What reports say outside their teardown: sentences by their words, specifications and parts lists read from images, forms of products,
sources of unboxing texts, digests, and records of an older layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partledger.functions.spans import all_spans
from partledger.operators import lexicons as L
from partledger.operators.extraction import rule_spans

SENTENCE_END, SHORTEST = r"[。！？!?\n]+", 6


def report_sentences(text: Column) -> Column:
    """The sentences of a report, trimmed, of six characters or more."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda s: F.trim(s)), lambda s: F.length(s) >= SHORTEST)


def has_any(text: Column, words: Sequence[str], pattern: str = "") -> Column:
    """Whether a text has one of some words as they are written, or a pattern."""
    found = F.rlike(text, F.lit(pattern)) if pattern else F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def sentence_filters(docs: DataFrame, key: str, text: str, filters: Sequence[tuple] = L.SENTENCE_FILTERS, unless: Sequence[str] = L.PACKAGING_WORDS, guarded: Sequence[str] = ("structure",), longer: int = 12) -> DataFrame:
    """(key, filter, place, sentence): the first sentences of each text that a filter (name, words, pattern, most) lets through.

    Texts are cut once for all filters. Guarded filters take no sentence that has one of the words of unless, only those of more than
    longer characters, and sentences that begin alike (60 characters) once. place counts from 1 within a filter, up to its most.
    """
    rows = docs.select(key, F.posexplode(report_sentences(F.col(text))).alias("at", "sentence"))
    said = F.col("sentence")
    held = [has_any(said, words, pattern) & ((~has_any(said, unless) & (F.length(said) > longer)) if name in guarded else F.lit(True)) for name, words, pattern, _ in filters]
    rows = rows.withColumn("filter", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(f[0])) for c, f in zip(held, filters, strict=True))))))
    alike = F.when(F.col("filter").isin(*guarded), F.substring(said, 1, 60)).otherwise(F.col("at").cast("string"))
    rows = rows.groupBy(key, "filter", alike.alias("_alike")).agg(F.min(F.struct("at", "sentence")).alias("s")).select(key, "filter", "s.*")
    most = F.create_map(*(F.lit(x) for name, _, _, n in filters for x in (name, n)))[F.col("filter")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key, "filter").orderBy("at"))).filter(F.col("place") <= most).select(key, "filter", "place", "sentence")


def tech_specs(docs: DataFrame, key: str, text: str, fields: Sequence[tuple] = L.TECH_FIELDS) -> DataFrame:
    """(key, field, place, value): each sentence once under every field whose words it has; sentences of no field with two colons or
    more are candidates for review (raw_candidates); and the ports that the whole text names (ports), as it writes them."""
    rows = docs.select(key, F.posexplode(report_sentences(F.col(text))).alias("at", "value"))
    of = F.array_compact(F.array(*(F.when(has_any(F.col("value"), words), F.lit(name)) for name, words in fields)))
    colons = F.regexp_count("value", F.lit("[：:]"))
    named = rows.withColumn("field", F.explode(F.when(F.size(of) > 0, of).when(colons >= 2, F.array(F.lit("raw_candidates"))).otherwise(F.array().cast("array<string>"))))
    once = named.groupBy(key, "field", "value").agg(F.min("at").alias("at"))
    ports = F.array_distinct(F.array_compact(F.array(*(F.nullif(F.regexp_extract(F.col(text), f"(?i){p}", 0), F.lit("")) for p in L.PORT_PATTERNS))))
    found = once.unionByName(docs.select(key, F.lit("ports").alias("field"), F.posexplode(ports).alias("at", "value")))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(key, "field").orderBy("at")).cast("int")).select(key, "field", "place", "value")


def image_specs(texts: DataFrame, key: str, text: str, rules: Sequence[tuple] = L.IMAGE_SPECS) -> DataFrame:
    """(key, place, part, value, unit, confidence, raw): specifications in text read from images, by pattern and then by place; a part's
    value once."""
    groups = F.element_at(F.array(*(F.struct(F.lit(part).alias("part"), F.lit(unit).alias("unit"), F.lit(sure).alias("confidence")) for part, _, unit, sure in rules)), F.col("rule") + 1)
    # Patterns have their value as a group, which the spans of rules don't take: it is read from the match.
    rows = rule_spans(texts.select(key, text), text, [p for _, p, _, _ in rules]).withColumn("of", groups)
    value = F.coalesce(*(F.when(F.col("rule") == i, F.trim(F.regexp_extract("span.match", f"(?iu){p}", 1))) for i, (_, p, _, _) in enumerate(rules)))
    rows = rows.select(key, F.struct("rule", "span.start").alias("at"), "of.*", value.alias("value"), F.trim("span.match").alias("raw"))
    first = rows.groupBy(key, "part", F.upper("value").alias("_v")).agg(F.min(F.struct("at", "value", "unit", "confidence", "raw")).alias("f"))
    return first.select(key, F.row_number().over(Window.partitionBy(key).orderBy("f.at")).alias("place"), "part", "f.value", "f.unit", "f.confidence", "f.raw")


def image_parts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, component, brand, model, role): a parts list in text read from images, at most forty rows of a text.

    A line of three cells or more is a row; else a line with a battery's capacity gives that, with the first word as its vendor, and
    every chip that a line names is one. A component, brand and model comes once.
    """
    rows = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n|\r")).alias("line", "said")).withColumn("said", F.trim("said")).filter(F.length("said") >= 4)
    said = F.col("said")
    cells = F.filter(F.transform(F.split(said, L.LIST_CELLS), lambda c: F.trim(c)), lambda c: c != "")
    row = lambda component, brand, model, role, at: F.struct(component.alias("component"), brand.alias("brand"), model.alias("model"), role.alias("role"), at.alias("at"))
    none, zero = F.lit(""), F.lit(0)
    table = F.array(row(F.get("cells", F.lit(0)), F.get("cells", F.lit(1)), F.get("cells", F.lit(2)), none, zero))
    capacity = F.regexp_extract(said, r"(?iu)[0-9]+\s*mAh", 0)
    battery = F.when(F.contains(said, F.lit(L.BATTERY)) & F.contains(said, F.lit("mAh")), F.array(row(F.lit(L.BATTERY), F.regexp_extract(said, L.LIST_VENDOR, 1), capacity, none, zero))).otherwise(F.array().cast("array<struct<component:string,brand:string,model:string,role:string,at:int>>"))
    model = lambda m: F.regexp_extract(m["match"], L.LIST_CHIP_MODEL, 1)
    role = lambda m: F.when(F.startswith(F.upper(model(m)), F.lit("IP")), L.POWER_ROLE).otherwise(L.CHIP_ROLE)
    chips = F.transform(F.filter(all_spans(said, f"(?iu){L.LIST_CHIP}"), lambda m: model(m) != ""), lambda m: row(F.lit(L.CHIP_PART), none, model(m), role(m), m["start"] + 1))
    found = rows.withColumn("cells", cells).select(key, "line", F.explode(F.when(F.size("cells") >= 3, table).otherwise(F.concat(battery, chips))).alias("r")).select(key, "line", "r.*")
    first = found.groupBy(key, "component", "brand", "model").agg(F.min(F.struct("line", "at", "role")).alias("f"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("f.line", "f.at")))
    return placed.filter(F.col("place") <= L.LIST_ROWS).select(key, "place", "component", "brand", "model", "f.role")


def form_labels(text: Column) -> Column:
    """The forms of an earphone that a text names, sorted: of what it was changed to, if that has one; else of what a contrast leads to; else
    of all of it. Fixed forms go before others, and a clip before a hook before the rest."""
    text = F.coalesce(text, F.lit(""))

    def named(part: Column) -> Column:
        found = F.array_compact(F.array(*(F.when(part.rlike(f"(?iu){p}"), F.lit(label)) for label, p in sorted(L.FORM_LABELS))))
        fixed = F.filter(found, lambda x: x.isin(*L.FIXED_FORMS))
        ruled = F.when(F.size(fixed) > 0, fixed)
        for label in L.FIRST_FORMS:
            ruled = ruled.when(F.array_contains(found, label), F.array(F.lit(label)))
        return ruled.otherwise(found)

    final = [named(F.regexp_extract(text, p, 1)) for p in (L.FORM_CHANGE, L.FORM_CONTRAST)]
    return F.when(F.size(final[0]) > 0, final[0]).when(F.size(final[1]) > 0, final[1]).otherwise(named(text))


def unboxing_source(modules: DataFrame, key: str) -> DataFrame:
    """(key, module, place, text) of the texts that an unboxing's modules have, from (key, module, description, accessories, captions).

    A packaging with captions is described by those, not by its description. Blanks are collapsed; texts under four characters without
    blanks, titles of reports and repeated texts go.
    """
    none = F.array().cast("array<string>")
    captions, extras = (F.coalesce(c, none) for c in ("captions", "accessories"))
    own = F.when((F.col("module") == "packaging") & (F.size(captions) > 0), none).otherwise(F.array(F.coalesce("description", F.lit(""))))
    texts = F.transform(F.concat(own, extras, captions), lambda t: F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " ")))
    bare = lambda t: F.regexp_replace(t, r"\s+", "")
    kept = modules.select(key, "module", F.filter(texts, lambda t: (F.length(bare(t)) >= 4) & ~F.startswith(t, F.lit(L.REPORT_TITLE))).alias("texts"))
    first = F.filter("texts", lambda t, i: F.array_position(F.transform("texts", bare), bare(t)) == i + 1)
    return kept.select(key, "module", F.posexplode(first).alias("place", "text"))


def unboxing_bullets(source: DataFrame, key: str) -> DataFrame:
    """(key, module, place, text, priority, quote): the clauses of unboxing texts that say something of the outside; with a number 4, else 3,
    the higher first and then in order."""
    rows = source.select(key, "module", F.col("place").alias("from"), F.col("text").alias("quote"), F.posexplode(F.split("text", "[。；;]+")).alias("at", "text")).withColumn("text", F.trim("text"))
    said = F.col("text")
    rows = rows.filter((F.length(F.regexp_replace(said, r"\s+", "")) >= 8) & ~has_any(said, L.TEARDOWN_WORDS) & ~said.isin(*L.GENERIC_CAPTIONS)).withColumn("priority", F.when(said.rlike(L.BULLET_NUMBER), 4).otherwise(3))
    place = F.row_number().over(Window.partitionBy(key, "module").orderBy(F.desc("priority"), "from", "at"))
    return rows.select(key, "module", place.alias("place"), "text", "priority", "quote")


DIGEST = "overview string, key_findings array<struct<title: string, text: string>>, image_highlights array<struct<url: string, caption: string, description: string>>"


def roundup_digest(json: Column) -> Column:
    """(overview, key_findings, image_highlights) of a digest in JSON: findings without a text and images without a link go, missing titles
    and captions get a general one. Null if it is no JSON object."""
    d = F.from_json(json, DIGEST)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    none = lambda k: F.array().cast(f"array<struct<{k}>>")
    findings = F.transform(F.filter(d["key_findings"], lambda f: blank(f["text"]).isNotNull()), lambda f: F.struct(F.coalesce(blank(f["title"]), F.lit(L.FINDING)).alias("title"), F.trim(f["text"]).alias("text")))
    images = F.transform(F.filter(d["image_highlights"], lambda i: blank(i["url"]).isNotNull()), lambda i: F.struct(i["url"].alias("url"), F.trim(F.coalesce(F.nullif(i["caption"], F.lit("")), F.nullif(i["description"], F.lit("")), F.lit(L.ARTICLE_IMAGE))).alias("caption")))
    whole = F.struct(F.coalesce(F.trim(d["overview"]), F.lit("")).alias("overview"), F.coalesce(findings, none("title:string,text:string")).alias("key_findings"), F.coalesce(images, none("url:string,caption:string")).alias("image_highlights"))
    return F.when(d.isNotNull() & F.startswith(F.ltrim(json), F.lit("{")), whole)


OLD_REPORT = """id string, source_id string, url string, title string, brand string, model string, category string, date string, author string, summary string, crawled_at string, first_seen_at string,
selling_points array<struct<text: string>>, components_major array<struct<name: string>>, tech_specs struct<charging_method: array<string>, charging_port: array<string>, manual_notes: array<string>>"""


def upgraded_reports(rows: DataFrame, json: str) -> DataFrame:
    """Report records of the older layout (JSON) in the present one: views by role, with what each took from the flat record."""
    o = lambda name: F.coalesce(F.col(f"o.{name}"), F.lit(""))
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(c, none)
    points = listed(F.transform("o.selling_points", lambda p: F.coalesce(p["text"], F.lit(""))))
    specs = lambda part, c: F.transform(listed(c), lambda s: F.struct(F.lit(part).alias("part"), s.alias("value"), F.lit("migrated").alias("source_ref")))
    views = F.struct(
        F.struct(o("brand").alias("brand"), o("model").alias("model"), o("category").alias("category"), F.slice(points, 1, 6).alias("selling_points"), F.coalesce(F.get(points, F.lit(0)), F.lit("")).alias("positioning_summary")).alias("market"),
        F.struct(listed(F.transform("o.components_major", lambda c: F.coalesce(c["name"], F.lit("")))).alias("major_parts"), F.slice(listed(F.col("o.tech_specs.manual_notes")), 1, 5).alias("packaging_notes")).alias("cost"),
        F.struct(o("category").alias("form_factor")).alias("structure"),
        F.struct(F.concat(specs("充电方式", F.col("o.tech_specs.charging_method")), specs("充电接口", F.col("o.tech_specs.charging_port"))).alias("specs")).alias("hardware"),
    )
    old = rows.select(F.from_json(json, OLD_REPORT).alias("o")).filter("o.id is not null")
    return old.select(
        "o.id", F.lit("report").alias("type"), F.coalesce("o.source_id", F.lit("audio52")).alias("source_id"), "o.url", *(o(c).alias(c) for c in ("title", "brand", "model", "category")), o("date").alias("published_at"), o("author").alias("author"), o("summary").alias("summary"),
        F.coalesce(F.nullif("o.crawled_at", F.lit("")), "o.first_seen_at", F.lit("")).alias("captured_at"), views.alias("views"),
    )


def reused_images(current: DataFrame, previous: DataFrame, key: str, content: str, images: str) -> DataFrame:
    """(key, reused, images): the images that were read of a record before, where its content is the same and had some; else null, to be
    fetched. Contents are held against each other by digest."""
    digest = lambda: F.sha2(F.coalesce(content, F.lit("")), 256).alias("_digest")
    old = previous.filter(F.size(images) > 0).select(key, digest(), F.col(images).alias("_images"))
    held = current.select(key, digest()).join(old, [key, "_digest"], "left")
    return held.select(key, F.col("_images").isNotNull().alias("reused"), F.col("_images").alias(images))


def source_layers(spark, sources: Sequence[tuple] = L.SOURCES) -> DataFrame:
    """(source, layer, name, priority) of the sources in use."""
    return spark.createDataFrame([(s, layer, name, L.LAYER_PRIORITY.get(layer, 0)) for s, layer, name, used in sources if used], "source string, layer string, name string, priority int")
