"""Evidence-grounded extraction: candidates are kept only if the text supports them, with a reason where it does not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partledger.functions.text import blank_to_null, collapse_spaces, numbers_in, sentences
from partledger.sources.shared import written


def validated(candidates: DataFrame, keys: Sequence[str], order: Sequence[str], rules: Sequence[tuple[Column, str]], identity: Column, cap: int) -> DataFrame:
    """candidates with reason: null for accepted ones, else the first rule that rejects, or duplicate or over_cap.

    Duplicates and the cap are decided among candidates that no rule rejects, in order within their keys.
    """
    reason = F.coalesce(*(F.when(c, F.lit(r)) for c, r in rules))
    rows = candidates.withColumns({"_reason": reason, "_id": identity})
    clean = F.col("_reason").isNull()
    first = F.row_number().over(Window.partitionBy(*keys, clean, "_id").orderBy(*order))
    rows = rows.withColumn("_fresh", clean & (first == 1))
    upto = F.sum(F.when(F.col("_fresh"), 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", upto)
    final = F.when(~clean, F.col("_reason")).when(~F.col("_fresh"), "duplicate").when(F.col("_upto") > cap, "over_cap")
    return rows.withColumn("reason", final).drop("_reason", "_id", "_fresh", "_upto")


def parameter_rules(label: str, value: str, quote: str, row_text: str, generic: Sequence[str] = (), row_key: str | None = None) -> list[tuple[Column, str]]:
    """Reasons against a parameter, in order: its row is not known (row_key names a column that is null then), its shape is not
    one (label, value and quote all null), its label says nothing, its value is missing, its quote is not in the row, its value
    is not in the quote, it has a number that the quote lacks."""
    shape = F.col(label).isNull() & F.col(value).isNull() & F.col(quote).isNull()
    rules = [] if row_key is None else [(F.col(row_key).isNull(), "unknown_row_key")]
    return [
        *rules,
        (shape, "parameter_not_an_object"),
        (F.coalesce(F.length(F.trim(label)) < 2, F.lit(True)) | F.coalesce(F.trim(label).isin(*generic), F.lit(False)) if generic else F.coalesce(F.length(F.trim(label)) < 2, F.lit(True)), "invalid_label"),
        (F.coalesce(F.trim(value) == "", F.lit(True)), "missing_value"),
        (~contains_text(row_text, quote), "evidence_not_in_row"),
        (~contains_text(quote, value), "value_not_in_evidence"),
        (numbers_beyond(F.concat_ws(" ", label, value), quote), "unsupported_number"),
    ]


def top_sentences(docs: DataFrame, key: str, text: str, lexicon: Sequence[str], n: int, least: int = 12) -> DataFrame:
    """The n sentences of each text with the most lexicon words, two points each and one for a digit, back in text order."""
    rows = docs.select(key, F.posexplode(sentences(text, least)).alias("pos", "sentence"))
    low = F.lower("sentence")
    hits = sum((F.when(F.contains(low, F.lit(w)), 2).otherwise(0) for w in lexicon), F.when(F.col("sentence").rlike("[0-9]"), 1).otherwise(0))
    scored = rows.withColumn("score", hits.cast("long")).filter("score > 0")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos")).cast("long"))
    return ranked.filter(F.col("rank") <= n).select(key, F.col("pos").cast("long").alias("pos"), "sentence", "score")


def weighted_tags(docs: DataFrame, key: str, text: str, lexicon: Sequence[tuple[str, str]], secondary: int = 2) -> DataFrame:
    """The top tag and up to `secondary` others of each text: a tag scores the lengths of its keywords in the text.

    A lexicon is a fixed list, so its tags are one array expression and nothing is joined or shuffled.
    """
    low = F.lower(text)
    tags = list(dict.fromkeys(t for t, _ in lexicon))
    score = lambda tag: sum((F.when(F.contains(low, F.lit(w)), len(w)).otherwise(0) for t, w in lexicon if t == tag), F.lit(0))
    scored = F.array(*(F.struct((-score(t)).alias("minus"), F.lit(i).alias("ordinal"), F.lit(t).alias("tag")) for i, t in enumerate(tags)))
    held = F.transform(F.array_sort(F.filter(scored, lambda s: s["minus"] < 0)), lambda s: s["tag"])
    best = docs.select(key, held.alias("tags"))
    return best.filter(F.size("tags") > 0).select(key, F.element_at("tags", 1).alias("tag"), F.array_join(F.slice("tags", 2, secondary), ";").alias("others"))


def members_in_order(text: Column, lexicon: Sequence[str]) -> Column:
    """The lexicon's words that a text contains, in the lexicon's order."""
    return F.filter(F.array(*map(F.lit, lexicon)), lambda w: F.contains(text, w))


def verbatim_hits(docs: DataFrame, key: str, text: str, quotes: DataFrame, quote_key: str, quote: str) -> DataFrame:
    """(key, quote_key) for each quote of three words or more that stands verbatim in a text.

    A text with a quote has the quote's inner words as words of its own. Words that no quote has are dropped before anything is dealt
    out; a quote then meets texts by that one of its inner words that fewest texts have, and only then is it looked for. A quote with a
    word that no text has meets none. Shorter quotes are no evidence.
    """
    words = F.split(F.trim(F.col(quote)), r"\s+")
    inner = F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    known = written(quotes.select(quote_key, F.trim(F.col(quote)).alias("_q"), F.size(inner).alias("_n"), F.explode(inner).alias("_w")), "quote-words")
    asked = known.select("_w").distinct()
    tokens = written(docs.select(key, F.explode(F.array_distinct(F.split(text, r"\s+"))).alias("_w")).join(asked, "_w", "left_semi"), "quoted-words")
    spread = tokens.groupBy("_w").agg(F.count("*").alias("_spread"))
    anchors = known.join(spread, "_w").groupBy(quote_key, "_q", "_n").agg(F.count("*").alias("_met"), F.min(F.struct("_spread", "_w"))["_w"].alias("_w")).filter("_met = _n")
    # Only keys and words are joined; the text and the quote are fetched once for each pair that shares the word.
    pairs = tokens.join(anchors.select("_w", quote_key), "_w").select(key, quote_key).distinct()
    held = pairs.join(anchors.select(quote_key, "_q"), quote_key).join(docs.select(key, F.col(text).alias("_t")), key)
    return held.filter(F.contains("_t", F.col("_q"))).select(key, quote_key).distinct()


def contains_text(whole: Column | str, part: Column | str) -> Column:
    """Whether a text stands in another, blanks collapsed; a blank one doesn't."""
    part = collapse_spaces(part)
    return F.coalesce((part != "") & F.contains(collapse_spaces(whole), part), F.lit(False))


def numbers_beyond(claim: Column | str, evidence: Column | str) -> Column:
    """Whether a claim has a number that its evidence lacks."""
    return F.coalesce(F.size(F.array_except(numbers_in(claim), numbers_in(evidence))) > 0, F.lit(False))


def shorter(c: Column | str, least: int) -> Column:
    return F.coalesce(F.length(collapse_spaces(c)) < least, F.lit(True))


def claim_rules(text: str, category: str, quote: str, source: str, confidence: str, categories: Sequence[str], technical: str, least_confidence: float = 0.75) -> list[tuple[Column, str]]:
    """Reasons against a consumer claim, in order. technical is a regex for texts of figures and part numbers alone."""
    bare = lambda c: F.coalesce(F.rlike(F.trim(c), F.lit(technical)), F.lit(False))
    return [
        (shorter(text, 8), "claim_too_short"),
        (~F.coalesce(F.col(category).isin(*categories), F.lit(False)), "invalid_category"),
        (~contains_text(source, quote), "evidence_not_in_report"),
        (bare(text) | bare(quote), "pure_technical_fact"),
        (numbers_beyond(text, quote), "unsupported_number"),
        (F.coalesce(F.col(confidence), F.lit(0.8)) < least_confidence, "low_confidence"),
    ]


def summary_rules(text: str, quote: str, corpus: str, foreign: Sequence[str], generic: Sequence[str]) -> list[tuple[Column, str]]:
    """Reasons against a summary of one module of a report, in order: foreign terms belong to other modules, generic ones say nothing."""
    return [
        (shorter(text, 6), "summary_too_short"),
        (~contains_text(corpus, quote), "evidence_not_in_module"),
        (F.exists(F.array(*map(F.lit, foreign)), lambda w: F.contains(text, w)), "foreign_fact"),
        (numbers_beyond(text, quote), "unsupported_number"),
        (F.trim(text).isin(*generic), "generic_caption"),
    ]


def reviewed_identities(candidates: DataFrame, record: str, decision: str, brand_forms: Column, least_confidence: float = 0.9) -> DataFrame:
    """(record, decision, products): what an identity reading of a record is worth.

    A product counts if its brand and model are there, the reading is sure enough, its quote stands in the source, and the quote
    names the model and one of the brand's forms (an array). A decision for one product needs exactly one that counts, one for
    several needs two; else, and for any other decision, the record goes to review without products.
    """
    key = lambda c: F.regexp_replace(F.lower(c), "[^0-9a-z]+", "")
    named = F.exists(brand_forms, lambda b: (key(b) != "") & F.contains(key("quote"), key(b)))
    counts = (blank_to_null("brand").isNotNull()) & blank_to_null("model").isNotNull() & (F.col("confidence") >= least_confidence) & contains_text("source_text", "quote") & named & F.contains(key("quote"), key("model"))
    per = candidates.groupBy(record).agg(F.count_if(F.coalesce(counts, F.lit(False))).alias("n"), F.max(decision).alias("_d"))
    stands = ((F.col("_d") == "single") & (F.col("n") == 1)) | ((F.col("_d") == "multi") & (F.col("n") >= 2)) | (F.col("_d") == "none")
    final = F.when(F.coalesce(stands, F.lit(False)), F.col("_d")).otherwise(F.lit("needs_review"))
    return per.select(record, final.alias("decision"), F.when(final.isin("single", "multi"), F.col("n")).otherwise(F.lit(0)).alias("products"))


def reviewed_dates(readings: DataFrame, least_confidence: float = 0.9) -> DataFrame:
    """readings with status and launch_date: verified with a month, year_only without, not_found where shape, certainty or evidence lack."""
    stands = F.col("status").isin("verified", "year_only") & F.rlike("value", F.lit(r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$")) & (F.col("confidence") >= least_confidence) & contains_text("article", "quote")
    stands = F.coalesce(stands, F.lit(False))
    status = F.when(~stands, "not_found").when(F.length("value") >= 7, "verified").otherwise("year_only")
    return readings.withColumns({"status": status, "launch_date": F.when(stands, F.col("value")).otherwise("")})


def reviewed_events(events: DataFrame, segments: DataFrame, keys: Sequence[str], segment: str, order: str) -> DataFrame:
    """Events of known segments, each fact once for a segment: importance within 1 and 5, for review where its numbers are not the source's.

    events has fact, corrected, importance, needs_review; segments has raw. The first of equal facts (by order) stays.
    """
    held = events.join(segments, [*keys, segment])
    corrected = F.coalesce(blank_to_null("corrected"), F.trim("raw"))
    held = held.withColumn("corrected", corrected).withColumn("fact", F.coalesce(blank_to_null("fact"), F.col("corrected"))).filter("fact <> ''")
    same = Window.partitionBy(*keys, segment, F.lower(collapse_spaces("fact"))).orderBy(order)
    first = held.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")
    changed = F.sort_array(numbers_in("corrected")) != F.sort_array(numbers_in("raw"))
    importance = F.least(F.greatest(F.coalesce("importance", F.lit(3)), F.lit(1)), F.lit(5))
    return first.withColumns({"importance": importance, "needs_review": F.coalesce("needs_review", F.lit(False)) | changed})


def reviewed_categories(readings: DataFrame, segments: DataFrame, key: str, segment: str, labels: dict[str, str]) -> DataFrame:
    """(key, category, segment, status): whether a reading's quote stands in a segment and names its category and no other.

    labels has a marker for each allowed category. A quote that is not in the segment it names is moved to the one that
    has it, if only one does.
    """
    hit = segments.join(readings.select(key, "quote", F.col("segment").alias("_given")), key).filter(contains_text("text", "quote"))
    where = hit.groupBy(key).agg(F.count("*").alias("hits"), F.max(F.when(F.col(segment) == F.col("_given"), F.col(segment))).alias("own"), F.min(segment).alias("only"))
    held = readings.join(where, key, "left")
    resolved = F.coalesce("own", F.when(F.col("hits") == 1, F.col("only")))
    named = F.array_compact(F.array(*(F.when(F.contains(F.lower("quote"), F.lit(m)), F.lit(c)) for c, m in labels.items())))
    allowed = F.coalesce(F.col("category").isin(*labels), F.lit(False))
    stands = allowed & resolved.isNotNull() & F.array_contains(named, F.col("category")) & (F.size(named) == 1)
    status = F.when(F.coalesce(stands, F.lit(False)), "candidate").otherwise("needs_review")
    return held.select(key, F.when(allowed, F.col("category")).otherwise("invalid_output").alias("category"), resolved.alias("segment"), status.alias("status"))
