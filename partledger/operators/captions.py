"""Captions of videos: blocks of one component's description, parts gated by their words, where the summary begins, profiles of facts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partledger.functions.spans import all_spans, any_marker, clauses, first_label
from partledger.operators import lexicons as L
from partledger.operators.extraction import manufacturer_from_evidence
from partledger.operators.similarity import same_text, spoken

#: Seconds between captions of one block, captions back to the one that names the component, and on from it.
GAP, BACK, ON = 5.0, 5, 6


def caption_models(text: Column) -> Column:
    """The tokens of a caption that are shaped like models, and not like parameters."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(L.CAPTION_MODEL), F.lit(0)), lambda t: F.trim(t, F.lit("-_")))
    return F.filter(tokens, lambda t: ~F.contains(F.lower(t), F.lit(L.CORE_NAME)) & ~t.rlike(L.PARAMETER_SHAPED))


def without_marks(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, L.CAPTION_MARKS, ""))


def caption_family(text: Column) -> Column:
    """The component that a caption is about, coarsely; null if none."""
    return family_of(without_marks(text))


def family_of(bare: Column) -> Column:
    """The same of a text without marks: a column of its own is made once, not for each family."""
    return F.nullif(F.coalesce(*(F.when(bare.rlike(f"(?iu){p}"), F.lit(f)) for f, p in L.CAPTION_FAMILIES)), F.lit(""))


def context_blocks(captions: DataFrame, key: str, start: str, end: str, order: str, text: str) -> DataFrame:
    """captions with family, n_context and context: the captions that describe the same component as each, joined.

    A caption that names no component looks for one: a bare identity in the next caption, an identity or a continuation
    (a model, a voltage, "used for ...") in up to five before it, over captions that are such themselves. From there the block goes
    back over captions of that family or bare identities (not where the naming caption has a model already) and on
    over the family, continuations and identities, but an identity whose next caption names another family belongs to that. No
    block goes over more than five seconds of silence or into another family. Only 19 captions around each are looked at, so a
    video of any length is one sorted pass.
    """
    words, back, on = F.col(text), 2 * BACK, ON + 2
    by = Window.partitionBy(key).orderBy(start, end, order)
    identity = (F.size(caption_models(words)) > 0) & F.trim(words).rlike(L.CAPTION_IDENTITY)
    marks = captions.withColumn("_bare", without_marks(words)).withColumns({"_family": family_of(F.col("_bare")), "_identity": F.coalesce(identity, F.lit(False)), "_goes": F.coalesce(F.trim(words).rlike(L.CAPTION_CONTINUES), F.lit(False)), "_model": F.coalesce(F.size(caption_models(words)) > 0, F.lit(False))})
    one = F.struct(F.col(start).alias("start"), F.col(end).alias("end"), F.col("_family").alias("family"), F.col("_identity").alias("identity"), F.col("_goes").alias("goes"), F.col("_model").alias("model"), F.trim(words).alias("text"))
    rows = marks.withColumns({"_rows": F.collect_list(one).over(by.rowsBetween(-back, on)), "_at": F.least(F.row_number().over(by) - 1, F.lit(back))})

    at = F.col("_at")
    row = lambda i: F.get("_rows", i)
    joined = lambda i: row(i + 1)["start"] - row(i)["end"] <= GAP
    open_ = lambda i: row(i)["identity"] | row(i)["goes"]
    ahead = F.when(row(at)["identity"] & joined(at), row(at + 1)["family"])
    step = F.struct(F.lit(None).cast("string").alias("family"), at.alias("at"), F.lit(False).alias("done"))

    def look_back(held: Column, d: Column) -> Column:
        i = at - d
        family = F.when(joined(i), row(i)["family"])
        ended = (i < 0) | ~joined(i) | ~open_(i)
        found = F.struct(family.alias("family"), i.alias("at"), F.lit(True).alias("done"))
        return F.when(held["done"], held).when((i >= 0) & family.isNotNull(), found).otherwise(F.struct(held["family"].alias("family"), held["at"].alias("at"), F.coalesce(ended, F.lit(True)).alias("done")))

    own = F.coalesce(row(at)["family"], ahead)
    rows = rows.withColumn("_before", F.when(own.isNull() & open_(at), F.aggregate(F.sequence(F.lit(1), F.lit(BACK)), step, look_back)))
    before = F.col("_before")
    anchor = F.when(own.isNotNull(), F.struct(own.alias("family"), at.alias("at"))).when(open_(at) & before["family"].isNotNull(), F.struct(before["family"].alias("family"), before["at"].alias("at")))
    rows = rows.withColumn("_anchor", anchor)
    family, named = F.col("_anchor.family"), F.col("_anchor.at")
    here = lambda place, done: F.struct(place.alias("at"), done.alias("done"))

    def go_back(held: Column, _: Column) -> Column:
        i = held["at"] - 1
        fits = (i >= 0) & joined(i) & F.coalesce(row(i)["family"] == family, row(i)["identity"])
        return F.when(~held["done"] & F.coalesce(fits, F.lit(False)), here(i, F.lit(False))).otherwise(here(held["at"], F.lit(True)))

    def go_on(held: Column, _: Column) -> Column:
        i = held["at"] + 1
        following = F.when(joined(i), row(i + 1)["family"])
        leads = row(i)["identity"] & F.coalesce(following != family, F.lit(False))
        fits = joined(held["at"]) & F.coalesce(row(i)["family"] == family, open_(i)) & ~leads & (held["at"] - named < ON)
        return F.when(~held["done"] & F.coalesce(fits, F.lit(False)), here(i, F.lit(False))).otherwise(here(held["at"], F.lit(True)))

    left = F.when(row(named)["model"], named).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(BACK)), here(named, F.lit(False)), go_back)["at"])
    right = F.aggregate(F.sequence(F.lit(1), F.lit(ON)), here(at, F.lit(False)), go_on)["at"]
    texts = F.when(F.col("_anchor").isNotNull(), F.array_distinct(F.filter(F.transform(F.slice("_rows", F.col("_left") + 1, F.col("_right") - F.col("_left") + 1), lambda r: r["text"]), lambda t: t != ""))).otherwise(F.array(F.trim(words)))
    rows = rows.withColumns({"_left": left, "_right": right}).withColumn("_texts", texts)
    return rows.select(*captions.columns, F.col("_anchor.family").alias("family"), F.size("_texts").alias("n_context"), F.array_join("_texts", "；").alias("context"))


def component_key(component: Column, evidence: Column) -> Column:
    """A component's key by the first marker in its name; a name without one gives its own letters; only without a name the evidence decides."""
    name = F.lower(F.regexp_replace(F.coalesce(component, F.lit("")), r"\s+", ""))
    own = F.trim(F.regexp_replace(name, r"[^0-9a-z一-鿿]+", "_"), F.lit("_"))
    said = first_label(F.regexp_replace(F.coalesce(evidence, F.lit("")), r"\s+", ""), L.COMPONENT_RULES, "unclassified")
    return F.coalesce(F.nullif(first_label(name, L.COMPONENT_RULES), F.lit("")), F.nullif(F.substring(own, 1, 100), F.lit("")), said)


def primary_component(source: Column) -> Column:
    """The analysed component that the first clause with one names, else the whole; empty if none."""
    keys = [k for k, _, _ in L.ANALYSED]
    of_clauses = F.filter(F.transform(F.split(source, "[；;]"), lambda c: component_key(F.lit(""), c)), lambda k: k.isin(*keys))
    whole = component_key(F.lit(""), source)
    return F.coalesce(F.get(of_clauses, F.lit(0)), F.when(whole.isin(*keys), whole), F.lit(""))


def bare(c: Column) -> Column:
    """Letters, digits and ideographs in lower case, which is what a text has to have of a value verbatim."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^0-9a-z一-鿿]+", "")


def verbatim_or_blank(source: Column, value: Column) -> Column:
    """A value, if a text has it; else an empty string."""
    return F.when((bare(value) != "") & F.contains(bare(source), bare(value)), F.trim(value)).otherwise("")


def model_tokens(source: Column) -> Column:
    return F.transform(F.regexp_extract_all(source, F.lit(L.CAPTION_MODEL), F.lit(0)), lambda t: F.regexp_replace(F.trim(t, F.lit("-_")), L.MODEL_SUFFIX, ""))


def source_models(source: Column) -> Column:
    """Models that a caption block names: numbers after the word for model, then tokens shaped like models, without what they end in."""
    shaped = F.filter(model_tokens(source), lambda t: (F.length(t) >= 4) & ~t.rlike(L.PARAMETER_SHAPED) & ~t.rlike(L.DIMENSION_SHAPED) & ~F.contains(F.lower(t), F.lit(L.CORE_NAME)) & ~F.lower(t).isin(*L.NO_CAPTION_MODELS))
    return F.concat(F.regexp_extract_all(source, F.lit(L.LABELLED_NUMBER), F.lit(1)), shaped)


def model_or_blank(source: Column, model: Column) -> Column:
    """A proposed model, if the text has it as a token of its own and it is neither a parameter nor a part's general name."""
    own = F.trim(F.coalesce(model, F.lit("")))
    fits = (own != "") & ~bare(own).isin(*L.GENERIC_MODELS) & ~own.rlike(L.PARAMETER_SHAPED) & ~own.rlike(L.DIMENSION_SHAPED)
    named = F.concat(F.regexp_extract_all(source, F.lit(L.LABELLED_NUMBER), F.lit(1)), F.filter(model_tokens(source), lambda t: ~F.contains(F.lower(t), F.lit(L.CORE_NAME))))
    return F.when(fits & F.exists(named, lambda m: bare(m) == bare(own)), own).otherwise("")


def caption_side(source: Column, proposed: Column, narrative: Column) -> Column:
    """The proposed side if the text has it, else the one that the text names, else the narrative's."""
    named = F.coalesce(*(F.when(any_marker(source, markers), F.lit(side)) for side, markers in L.CAPTION_SIDES))
    given = F.when((F.trim(proposed) != "") & F.contains(source, F.trim(proposed)), F.trim(proposed))
    return F.coalesce(given, named, F.when(narrative.isin(L.CASE_SIDE, L.EARBUD_SIDE), narrative), F.lit(""))


def caption_parameters(source: Column) -> Column:
    """Array of (label, value): every value of the seven kinds that a text states, each once."""

    def of(label: str, pattern: str, group: int) -> Column:
        value = lambda m: F.trim(F.when(m["value"] != "", m["value"]).otherwise(m["match"]))
        return F.transform(all_spans(source, f"(?iu){pattern}", group), lambda m: F.struct(F.lit(label).alias("label"), value(m).alias("value")))

    return F.array_distinct(F.concat(*(of(*rule) for rule in L.CAPTION_PARAMETERS)))


def caption_parts(blocks: DataFrame, source: str, narrative: Column) -> DataFrame:
    """blocks with component_key, component, brand, model, side, role and parameters, for those whose text names an analysed component.

    Whatever comes out stands in the text: the maker by manufacturer_from_evidence, the first model-shaped token, the parameters by
    pattern. A battery needs evidence of the cell, not only its name.
    """
    text = F.col(source)
    labels, roles = (F.create_map(*(F.lit(x) for row in L.ANALYSED for x in (row[0], row[i]))) for i in (1, 2))
    rows = blocks.withColumn("component_key", primary_component(text)).filter((F.col("component_key") != "") & ((F.col("component_key") != "battery") | text.rlike(L.BATTERY_CELL)))
    key = F.col("component_key")
    maker = manufacturer_from_evidence(F.replace(text, F.lit("；"), F.lit("，")), F.lit(""), key)
    return rows.withColumns({"component": labels[key], "brand": maker["manufacturer"], "model": F.coalesce(F.get(source_models(text), F.lit(0)), F.lit("")), "side": caption_side(text, F.lit(""), narrative), "role": roles[key], "parameters": caption_parameters(text)})


def gated_proposals(proposals: DataFrame, source: str) -> DataFrame:
    """Proposed parts (component, brand, model, side, narrative_side, confidence) that their text bears out.

    A proposal stays if its component is the one that its text is mainly about; brand and model are emptied unless the text has
    them, sides follow the text, and no confidence is above 0.95.
    """
    text = F.col(source)
    key, primary = component_key(F.col("component"), text), primary_component(text)
    keys = [k for k, _, _ in L.ANALYSED]
    supported = key.isin(*keys) & ((primary == "") | (key == primary)) & F.when(key == "battery", text.rlike(L.BATTERY_CELL)).otherwise((F.trim("component") != "") & (F.trim(text) != ""))
    changed = {"component_key": key, "brand": verbatim_or_blank(text, F.col("brand")), "model": model_or_blank(text, F.col("model")), "side": caption_side(text, F.coalesce("side", F.lit("")), F.col("narrative_side")), "confidence": F.least(F.coalesce("confidence", F.lit(0.82)), F.lit(0.95))}
    return proposals.filter(supported).withColumns(changed).drop("narrative_side")


def summary_start(captions: DataFrame, key: str, start: str, order: str, text: str, duration: str) -> DataFrame:
    """(key, detected, summary_start, evidence, strong, weak): where each video's summary begins, in one aggregation.

    Only captions from 0.55 of the duration on count. The first strong cue decides; without one the first weak opening does,
    if the words that close a teardown come after it.
    """
    words = F.col(text)
    late = F.col(start) >= F.col(duration) * L.SUMMARY_FROM
    strong = late & words.rlike("|".join(L.SUMMARY_STRONG))
    weak = late & ~strong & words.rlike("|".join(L.SUMMARY_WEAK))
    first = lambda when: F.min(F.when(when, F.struct(F.col(start).alias("start"), F.col(order).alias("order"), words.alias("text"))))
    found = captions.groupBy(key).agg(
        first(strong).alias("s"), first(weak & words.rlike(L.SUMMARY_OPENING)).alias("w"), F.max(F.when(weak & F.contains(words, F.lit(L.SUMMARY_OUTRO)), F.col(start))).alias("outro"), F.count_if(strong).alias("strong"), F.count_if(weak).alias("weak")
    )
    chosen = F.coalesce("s", F.when(F.col("outro") > F.col("w.start"), F.col("w")))
    return found.select(key, chosen.isNotNull().alias("detected"), chosen["start"].alias("summary_start"), chosen["text"].alias("evidence"), "strong", "weak")


def fact_sections(text: Column, section: Column, topic: Column) -> tuple[Column, Column]:
    """(section, topic) of a fact: explicit market and unboxing sections stay, else the first rule, else the explicit one; a market
    fact's topic is its own if it is a known one, else the first rule's."""
    section = F.coalesce(section, F.lit(""))
    ruled = F.coalesce(*(F.when(text.rlike(p), F.lit(s)) for s, p in L.SECTION_RULES), F.nullif(section, F.lit("")), F.lit("specification"))
    of = F.when((section == "market") | F.startswith(section, F.lit("unboxing_")), section).otherwise(ruled)
    said = F.coalesce(*(F.when(text.rlike(p), F.lit(t)) for t, p in L.TOPIC_RULES), F.lit(L.TOPIC_DEFAULT))
    return of, F.when(of == "market", F.when(F.trim(topic).isin(*L.TOPICS), F.trim(topic)).otherwise(said))


def video_profile(facts: DataFrame, product: str, order: str, text: str, section: Column, topic: Column, category: str) -> DataFrame:
    """One row for each product: its claims by topic, its scenarios, what was unboxed and how complete that is.

    Counts and scenarios come from one aggregation with partial results. A section's description is its distinct sentences in order
    of their first fact; repeated sentences are one before any list is made. Completeness is the share of the sections that a
    product of its category has: three for earphones in two pieces with a case, else two.
    """
    of, about = fact_sections(F.col(text), section, topic)
    rows = facts.select(F.col(product).alias("product"), F.col(order).alias("at"), F.col(text).alias("text"), of.alias("section"), about.alias("topic"), F.col(category).alias("category"))
    boxes = ("packaging", "charging_case", "earbuds")
    count = {f"claims_{i}": F.count_if(F.col("topic") == t) for i, t in enumerate(L.TOPICS)}
    games = {f"scenario_{i}": F.max((F.col("section") == "market") & F.contains("text", F.lit(s))) for i, s in enumerate(L.SCENARIOS)}
    totals = rows.groupBy("product").agg(F.count("*").alias("facts"), F.max("category").alias("category"), *(c.alias(n) for n, c in (count | games).items()))
    said = rows.filter(F.col("section").isin(*(f"unboxing_{b}" for b in boxes))).groupBy("product", "section", "text").agg(F.min("at").alias("at"))
    told = said.groupBy("product").agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == f"unboxing_{b}", F.struct("at", "text")))), lambda s: s["text"]), "；").alias(b) for b in boxes))
    held = totals.join(told, "product", "left").fillna("", list(boxes))
    filled = sum((F.when(F.col(b) != "", 1).otherwise(0) for b in boxes[1:]), F.when(F.col(boxes[0]) != "", 1).otherwise(0))
    wanted = F.when(F.col("category").isin(*L.THREE_SECTIONS), 3).otherwise(2)
    topics = F.map_filter(F.create_map(*(x for i, t in enumerate(L.TOPICS) for x in (F.lit(t), F.col(f"claims_{i}")))), lambda _, n: n > 0)
    scenarios = F.array_compact(F.array(*(F.when(F.col(f"scenario_{i}"), F.lit(s)) for i, s in enumerate(L.SCENARIOS))))
    return held.select(F.col("product").alias(product), "facts", topics.alias("topics"), scenarios.alias("scenarios"), *boxes, F.least(F.lit(1.0), filled / wanted).alias("completeness"))


def merged_captions(captions: DataFrame, key: str, start: str, end: str, text: str, samples: str, gap: float = 0.25) -> DataFrame:
    """(key, start, end, text, samples): captions that follow within gap seconds and say the same, merged in order.

    A caption is held against the merged one before it, whose text is the longest so far, so merging goes one by one. It can't go over a
    silence: captions are first cut there, and the pieces, not videos, are dealt out and sorted. A task keeps one caption at a time.
    """
    order = Window.partitionBy(key).orderBy(start, end, text)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = captions.filter(F.regexp_replace(F.coalesce(text, F.lit("")), L.CAPTION_MARKS, "") != "").withColumn("_cut", F.when(F.col(start) <= before + gap, 0).otherwise(1))
    rows = rows.withColumn("_piece", F.sum("_cut").over(order)).select(key, "_piece", start, end, text, samples)
    dealt = rows.repartition(key, "_piece").sortWithinPartitions(key, "_piece", start, end, text)
    names = [key, start, end, text, samples]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, place = None, None
        for part in batches:
            out = []
            for k, piece, s, e, t, n in part.itertuples(index=False):
                if held is not None and place == (k, piece) and s <= held[2] + gap and same_text(held[3], t):
                    held = (k, held[1], max(held[2], e), t if len(spoken(t)) > len(spoken(held[3])) else held[3], held[4] + n)
                else:
                    if held is not None:
                        out.append(held)
                    held, place = (k, s, e, t, n), (k, piece)
            yield pd.DataFrame(out, columns=names)
        if held is not None:
            yield pd.DataFrame([held], columns=names)

    kinds = dict(captions.dtypes)
    return dealt.mapInPandas(fold, ", ".join(f"`{c}` {kinds[c]}" for c in names))
