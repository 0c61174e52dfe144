"""Parts, sides and makers from the text of reports: rules over clauses, matches with their places, guards around them.

All of it is expressions over one row's text or windows over one report's blocks; rules are parameters, by default those in lexicons.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partledger.functions.spans import all_spans, any_marker, any_match, around, clauses, first_label, first_span
from partledger.operators import lexicons as L
from partledger.operators.similarity import contained_names
from partledger.sources.shared import written

#: Blocks within which a paragraph's image stands, and the fewest characters of a paragraph or clause.
IMAGE_REACH, SHORTEST = 4, 5


def side_decision(clause: Column, heading: Column) -> Column:
    """(side, reason, status): a heading that names one side decides, else a clause that does; both or none need review."""
    by_heading = [any_marker(heading, t) for t in (L.CASE_TERMS, L.EARBUD_TERMS)]
    by_clause = [any_marker(clause, t) for t in (L.CASE_TERMS, L.EARBUD_TERMS)]
    said = lambda side, reason, status: F.struct(side.alias("side"), reason.alias("side_reason"), F.lit(status).alias("side_status"))
    of = lambda case: F.when(case, L.CASE_SIDE).otherwise(L.EARBUD_SIDE)
    return (
        F.when(by_heading[0] != by_heading[1], said(of(by_heading[0]), F.concat(F.lit(L.SIDE_BY_HEADING + "“"), heading, F.lit("”")), "resolved"))
        .when(by_clause[0] != by_clause[1], said(of(by_clause[0]), F.lit(L.SIDE_BY_CLAUSE), "resolved"))
        .otherwise(said(F.lit(""), F.when(by_clause[0], L.SIDE_CONFLICT).otherwise(L.SIDE_UNKNOWN), "needs_review"))
    )


def part_marking(clause: Column) -> Column:
    """What is printed on a part, without spaces; empty if the clause doesn't say."""
    return F.regexp_replace(F.regexp_extract(clause, L.MARKING, 1), r"\s+", "")


def part_model(clause: Column, component: Column) -> Column:
    """A part's model: the one that is named, else its marking, else the first token shaped like one (never a battery's)."""
    tokens = F.filter(F.regexp_extract_all(clause, F.lit(L.MODEL_TOKEN), F.lit(0)), lambda t: ~F.upper(t).isin(*L.NO_MODELS) & ~t.rlike(L.PARAMETER_TOKEN))
    marking = part_marking(clause)
    return F.when(clause.rlike(L.EXPLICIT_MODEL), F.trim(F.regexp_extract(clause, L.EXPLICIT_MODEL, 1))).when(marking != "", marking).when(component == L.BATTERY, "").otherwise(F.coalesce(F.get(tokens, F.lit(0)), F.lit("")))


def part_candidates(clause: Column, rules: Sequence[tuple]) -> Column:
    """Array of (rule, component, classification, reason): the rules that a clause meets, then a marking that no named part has.

    Where the clause names the microphone that a marking is on, other kinds of microphone in it are not parts of it.
    """
    marked = F.regexp_extract(clause, L.MARKED_PART, 1)
    marked = F.when(F.lower(marked) == L.BONE_MICROPHONE, L.VPU_MICROPHONE).otherwise(marked)
    found = []
    for k, (component, kind, patterns, reason) in enumerate(rules):
        holds = any_match(clause, patterns, "(?iuU)")
        if component in L.MICROPHONES:
            holds = holds & ((marked == "") | (marked == component))
        found.append(F.when(holds, F.struct(F.lit(k).alias("rule"), F.lit(component).alias("component"), F.lit(kind).alias("classification"), F.lit(reason).alias("reason"))))
    component, kind, reason = L.UNKNOWN_PART
    unknown = (part_marking(clause) != "") & ~any_marker(clause, L.NAMED_PARTS) & clause.rlike(L.MARKED_BUT_UNKNOWN)
    found.append(F.when(unknown, F.struct(F.lit(len(rules)).alias("rule"), F.lit(component).alias("component"), F.lit(kind).alias("classification"), F.lit(reason).alias("reason"))))
    return F.array_compact(F.array(*found))


def teardown_inventory(blocks: DataFrame, key: str, rules: Sequence[tuple] = L.PART_RULES, vendors: Sequence[tuple] = L.PART_VENDORS) -> DataFrame:
    """The parts that a report's teardown names, from its blocks (key, pos, kind, level, text, src), with their evidence.

    Paragraphs count from a heading of the teardown to one of the summary or a paragraph that begins it; where no heading
    names a teardown, from the start. A row is (key, pos, clause, rule, component, classification, label, reason, brand, model,
    side, side_reason, side_status, specification, fact_text, image, alt, review_status); of rows with equal class, component,
    model and side the first stays. The image is the nearest within four blocks, the earlier of equally near ones. One
    sort by report serves all windows.
    """
    order = Window.partitionBy(key).orderBy("pos")
    upto, all_of = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key)
    heading, image, words = F.col("level") > 0, F.col("kind") == "img", F.col("text")
    paragraph = ~heading & ~image & (F.length("text") >= SHORTEST)
    event = F.when(heading & F.contains(words, F.lit(L.SUMMARY_TERM)), False).when(heading & F.contains(words, F.lit(L.TEARDOWN_TERM)), True).when(paragraph & words.rlike(L.SUMMARY_PARAGRAPH), False)
    shown = F.when(image & (F.col("src") != ""), F.struct("src", F.col("text").alias("alt")))
    near = [f(shown, d).over(order) for d in range(1, IMAGE_REACH + 1) for f in (F.lag, F.lead)]
    rows = blocks.select(key, "pos", "text", paragraph.alias("paragraph"), F.last(F.when(heading, words), ignorenulls=True).over(upto).alias("heading"), F.last(event, ignorenulls=True).over(upto).alias("event"), F.max(heading & F.contains(words, F.lit(L.TEARDOWN_TERM))).over(all_of).alias("headed"), F.coalesce(*near).alias("image"))
    rows = rows.filter(F.col("paragraph") & F.coalesce("event", ~F.col("headed")))
    long = F.filter(clauses(F.col("text")), lambda c: F.length(c) >= SHORTEST)
    rows = rows.select(key, "pos", F.coalesce("heading", F.lit("")).alias("heading"), "image", F.posexplode(F.when(F.size(long) > 0, long).otherwise(F.array("text"))).alias("clause", "fact_text"))
    clause = F.col("fact_text")
    rows = rows.withColumn("c", F.explode(part_candidates(clause, rules))).withColumn("where", side_decision(clause, F.col("heading")))
    unknown = F.col("c.classification") == L.UNKNOWN_PART[1]
    labels = F.create_map(*(F.lit(x) for pair in L.CLASS_LABELS.items() for x in pair))
    specification = F.array_join(F.array_distinct(F.regexp_extract_all(clause, F.lit(L.SPECIFICATION), F.lit(0))), " / ")
    rows = rows.select(
        key, "pos", "clause", "c.*", labels[F.col("c.classification")].alias("label"), F.when(unknown, "").otherwise(first_label(clause, vendors)).alias("brand"), F.when(unknown, part_marking(clause)).otherwise(part_model(clause, F.col("c.component"))).alias("model"),
        "where.*", specification.alias("specification"), "fact_text", F.col("image.src").alias("image"), F.col("image.alt").alias("alt"), F.when(unknown, "needs_review").otherwise("auto_extracted").alias("review_status"),
    )
    same = [key, "classification", "component", F.lower("model").alias("_model"), "side"]
    rest = [c for c in rows.columns if c not in (key, "classification", "component", "side")]
    first = rows.groupBy(*same).agg(F.min(F.struct("pos", "clause", "rule", *(c for c in rest if c not in ("pos", "clause", "rule")))).alias("f"))
    return first.select(key, "classification", "component", "side", "f.*").select(*rows.columns)


def side_segments(text: Column, anchors: Sequence[tuple[str, str]] = L.SIDE_ANCHORS) -> Column:
    """Array of (side, start, text): a text cut where a phrase says which side it goes on with; what stands before has no side."""
    named = lambda side: lambda m: F.struct(m["start"].alias("start"), F.lit(side).alias("side"))
    found = [F.transform(all_spans(text, pattern), named(side)) for side, pattern in anchors]
    starts = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit("").alias("side"))), F.array_sort(F.concat(*found)))
    end = lambda i: F.coalesce(F.get(starts, i + 1)["start"], F.length(text))
    cut = F.transform(starts, lambda a, i: F.struct(a["side"].alias("side"), a["start"].alias("start"), F.trim(F.substring(text, a["start"] + 1, end(i) - a["start"])).alias("text")))
    return F.filter(cut, lambda s: s["text"] != "")


def rule_spans(rows: DataFrame, text: str, patterns: Sequence[str], flags: str = "(?iu)") -> DataFrame:
    """rows with rule (a pattern's number) and span, one for each match of each pattern in the text: patterns that don't occur
    cost a search, and only those that do are matched with their places."""
    hits = F.array_compact(F.array(*(F.when(F.col(text).rlike(flags + p), F.lit(k)) for k, p in enumerate(patterns))))
    # With many patterns most texts have none: one search for all of them comes first.
    some = rows.filter(F.col(text).rlike(f"{flags}(?:{'|'.join(f'(?:{p})' for p in patterns)})")).withColumn("rule", F.explode(hits))
    pattern = F.element_at(F.array(*(F.lit(flags + p) for p in patterns)), F.col("rule") + 1)
    return some.withColumn("span", F.explode(all_spans(F.col(text), pattern)))


def chip_core(model: Column) -> Column:
    """A chip's model for comparison: without the brand before it, the first run of letters and digits, in capitals."""
    bare = F.coalesce(*(F.when(F.startswith(F.lower(model), F.lit(p.lower())), F.substring(model, F.lit(len(p) + 1), F.length(model))) for p in L.BRAND_PREFIXES), model)
    core = F.upper(F.regexp_extract(bare, L.MODEL_CORE, 0))
    return F.when(core != "", core).otherwise(F.upper(F.regexp_replace(bare, r"\s+", "")))


def clause_side(clause: Column, otherwise: Column) -> Column:
    return F.coalesce(*(F.when(clause.rlike(p), F.lit(side)) for side, p in L.CLAUSE_SIDES), otherwise)


def prose_parts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Chips, batteries, drivers and microphones of a summary's prose: (key, place, component, brand, model, qty, side, role, evidence,
    confidence).

    A text is cut into segments of one side at the phrases that name it, and segments into clauses; a clause that names a
    side itself decides for its parts. A segment has a chip once and microphones once; of parts with equal component, model
    and side the surest stays, then the first. Chips come with the places of their matches, and their role is read from
    thirty characters around them. A null text has no parts.
    """
    segments = texts.select(key, F.posexplode(side_segments(F.coalesce(F.col(text), F.lit("")))).alias("segment", "s"))
    rows = segments.select(key, "segment", F.col("s.side").alias("of"), F.posexplode(clauses(F.col("s.text"), "。！？!?；")).alias("clause", "said")).filter("said <> ''")
    rows = written(rows, "clauses")  # four kinds of parts are read from them
    said, side = F.col("said"), clause_side(F.col("said"), F.col("of"))
    row = lambda df, kind, component, brand, model, qty, where, role, sure, order, canon: df.select(
        key, F.struct("segment", F.lit(kind).alias("kind"), "clause", *order).alias("at"), F.lit(component).alias("component"), brand.alias("brand"), model.alias("model"), qty.alias("qty"), where.alias("side"), role.alias("role"), F.substring(said, 1, 300).alias("evidence"), F.lit(sure).alias("confidence"), canon.alias("canon")
    )
    zero = [F.lit(0).alias("rule"), F.lit(0).alias("start")]
    squeezed = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))

    chips = rule_spans(rows.filter(F.length("said") >= 4), "said", L.CHIP_PATTERNS).withColumn("raw", F.trim("span.match")).withColumn("core", chip_core(F.col("raw"))).filter("core <> ''")
    first = F.row_number().over(Window.partitionBy(key, "segment", "core").orderBy("clause", "rule", "span.start"))
    chips = chips.withColumn("n", first).filter("n = 1")
    near = F.lower(around(said, F.col("span.start"), F.col("span.end"), 30))
    role = F.coalesce(*(F.when((near if on == "around" else F.col("raw")).rlike("(?iu)" + p), F.lit(r)) for on, p, r in L.CHIP_ROLES), F.lit(L.CHIP_ROLE))
    brand = F.coalesce(*(F.when(F.contains(F.lower("raw"), F.lit(p.lower())), F.lit(b)) for p, b in L.CHIP_BRANDS), F.lit(""))
    out = row(chips, 0, L.CHIP_PART, brand, F.col("raw"), F.lit("1"), side, role, 0.85, [F.col("rule"), F.col("span.start").alias("start")], F.col("core"))

    both, alone = F.regexp_extract(said, L.BATTERY_CAPACITY, 2), F.regexp_extract(said, L.BATTERY_CAPACITY_ONLY, 1)
    form = F.coalesce(*(F.when(F.contains(said, F.lit(a)) & F.contains(said, F.lit(b)), F.lit(f)) for a, b, f in L.BATTERY_FORMS), F.lit(""))
    volts = F.regexp_extract(said, L.BATTERY_CAPACITY, 1)
    battery = F.concat(F.when(volts != "", F.concat(volts, F.lit("V/"))).otherwise(""), F.when(both != "", both).otherwise(alone), F.lit("mAh"), form)
    batteries = rows.filter(F.contains(said, F.lit(L.BATTERY)) & (alone != ""))
    out = out.unionByName(row(batteries, 1, L.BATTERY, F.regexp_extract(said, L.BATTERY_VENDOR, 1), battery, F.lit("1"), side, F.lit("major"), 0.85, zero, squeezed(battery)))

    earbud = F.when(side == "", L.EARBUD_SIDE).otherwise(side)
    size, kind = F.regexp_extract(said, L.SPEAKER_SIZE, 1), F.regexp_extract(said, L.SPEAKER_FORM, 1)
    driver = F.trim(F.concat(F.when(size != "", F.concat(size, F.lit("mm"))).otherwise(""), F.lit(" "), F.when(kind != "", kind).otherwise(L.SPEAKER_DEFAULT)))
    drivers = rows.filter((size != "") | (kind != ""))
    out = out.unionByName(row(drivers, 2, L.SPEAKER, F.lit(""), driver, F.lit("1"), earbud, F.lit("major"), 0.8, zero, squeezed(driver)))

    mics = rows.filter(said.rlike(L.MICROPHONE_COUNT)).withColumn("n", F.row_number().over(Window.partitionBy(key, "segment").orderBy("clause"))).filter("n = 1")
    counts = F.create_map(*(F.lit(x) for pair in L.COUNT_WORDS.items() for x in pair))
    qty = F.coalesce(F.try_element_at(counts, F.regexp_extract(said, L.MICROPHONE_COUNT, 1)), F.lit(""))
    mic = F.concat(F.when(F.contains(F.upper(said), F.lit("MEMS")), "MEMS").otherwise(""), F.lit(L.MICROPHONE))
    out = out.unionByName(row(mics, 3, L.MICROPHONE, F.lit(""), mic, qty, earbud, F.lit("major"), 0.78, zero, squeezed(mic)))

    rest = ["brand", "model", "qty", "role", "evidence", "confidence"]
    best = out.groupBy(key, "component", "canon", "side").agg(F.min(F.struct(-F.col("confidence"), "at", *rest)).alias("b"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("b.at")).alias("place")
    return best.select(key, place, "component", "b.brand", "b.model", "b.qty", "side", "b.role", "b.evidence", "b.confidence")


def clean_maker(name: Column) -> Column:
    """A maker's name without marks at its ends and without the words that lead up to it; empty for words that name none."""
    bare = F.regexp_replace(name, r"^[：:、，,\s]+|[：:、，,\s]+$", "")
    bare = F.substring(F.trim(F.regexp_replace(bare, "^(?:电池|电芯)(?:供应商|生产商|制造商)?", "")), 1, 255)
    return F.when(bare.isin(*L.NO_MAKERS), "").otherwise(bare)


def compact_maker(clause: Column, vendors: Sequence[tuple] = L.COMPACT_VENDORS) -> Column:
    """(name, quote) where a clause names one vendor and a part's noun beside it: after it, or after the model that follows it, or
    shortly before it, or as the model's end. Null if it names several vendors or no such noun."""
    longest = lambda aliases: "(?iu)" + "|".join(sorted(aliases, key=len, reverse=True))
    spans = F.array_compact(F.array(*(first_span(clause, longest(aliases)) for _, aliases in vendors)))

    def judged(vendor: Column) -> Column:
        before = F.substring(clause, F.greatest(vendor["start"] - L.NOUN_BEFORE, F.lit(0)) + 1, F.least(vendor["start"], F.lit(L.NOUN_BEFORE)))
        after = F.substring(clause, vendor["end"] + 1, F.lit(L.NOUN_AFTER))
        model = F.regexp_extract(after, L.COMPACT_MODEL, 0)
        noun = first_span(F.substring(after, F.length(model) + 1, F.lit(L.NOUN_BEHIND_MODEL)), L.COMPONENT_NOUN)
        ends = vendor["end"] + F.length(model) + F.coalesce(noun["end"], F.lit(0))
        holds = noun.isNotNull() | before.rlike(L.COMPONENT_NOUN) | model.rlike(L.MODEL_ENDS_IN_NOUN)
        return F.when(holds, F.struct(F.trim(vendor["match"]).alias("name"), F.trim(F.substring(clause, vendor["start"] + 1, ends - vendor["start"])).alias("quote")))

    return F.when(F.size(spans) == 1, F.get(F.transform(spans, judged), F.lit(0)))


def manufacturer_from_evidence(text: Column, brand: Column, component: Column, vendors: Sequence[tuple] = L.COMPACT_VENDORS) -> Column:
    """(manufacturer, basis, quote) of a part, from the words of its evidence and the brand that a report gives it.

    In order: for a battery a maker before its noun, for others one vendor beside a part's noun; then a maker that the text
    names by a relation (made by, from); last the report's brand, if the evidence has it. Matches are weighed by where they
    stand: a battery's relation counts only after evidence of the cell, and not where a product's label or a chip stands
    between. Nothing is guessed: without evidence the maker is empty and the basis unknown.
    """
    text, battery = F.trim(F.coalesce(text, F.lit(""))), F.coalesce(component == "battery", F.lit(False))
    said = lambda name, basis, quote: F.when(name != "", F.struct(name.alias("manufacturer"), F.lit(basis).alias("basis"), quote.alias("quote")))

    cell = first_span(text, L.BATTERY_MAKER, 1)
    by_cell = said(clean_maker(cell["value"]), "explicit_source_text", F.trim(cell["match"]))
    found = F.get(F.array_compact(F.transform(F.split(text, r"[。；;\n]"), lambda c: compact_maker(c, vendors))), F.lit(0))
    by_noun = said(found["name"], "compact_source_component_wording", found["quote"])

    def by_relation(pattern: str) -> Column:
        match = first_span(text, pattern, 2)
        before = F.substring(text, F.greatest(match["start"] - L.BEFORE_MAKER, F.lit(0)) + 1, F.least(match["start"], F.lit(L.BEFORE_MAKER)))
        between = F.substring_index(before, L.BATTERY, -1)  # all of it if no battery is named
        word = F.regexp_extract(match["match"], pattern, 1)
        other = ~before.rlike(L.BATTERY_CELL) | between.rlike(L.PRODUCT_LABEL)
        other = other | ((word == L.MAKER) & before.rlike(L.PRODUCT_LABEL_FAR) & ~before.rlike(L.CELL_MAKER))
        other = other | (word.isin(*L.FROM) & between.rlike(L.CHIP_RELATION))
        return F.when(~battery | ~other, said(clean_maker(match["value"]), "explicit_source_text", F.trim(match["match"])))

    name = clean_maker(F.coalesce(brand, F.lit("")))
    at = F.instr(F.lower(text), F.lower(name))
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    beside = F.rlike(text, F.concat(F.lit("(?iu)(?:"), quoted, F.lit("[^，。；]{0,18}电池|电池[^，。；]{0,24}(?:来自|生产厂|生产商|制造商|供应商)[^，。；]{0,12}"), quoted, F.lit(")")))
    ahead = F.regexp_extract(F.substring(text, F.lit(1), at - 1), "[^。；]*$", 0)
    behind = F.regexp_extract(F.substring(text, at, F.length(text)), "^[^。；]*[。；]?", 0)
    by_brand = F.when((at > 0) & (~battery | beside), said(name, "reported_component_brand", F.trim(F.concat(ahead, behind))))
    nothing = F.struct(F.lit("").alias("manufacturer"), F.lit("unknown").alias("basis"), F.lit("").alias("quote"))
    return F.coalesce(F.when(battery, by_cell).otherwise(by_noun), *(by_relation(p) for p in L.MAKER_PATTERNS), by_brand, nothing)


def verbatim(words: Column) -> Column:
    """A pattern that matches some words as they are."""
    return F.concat(F.lit(r"\Q"), words, F.lit(r"\E"))


def rule_table_spans(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, rule, start, end, match, value): the first match of each rule in each text, from texts (id, text) and a table of rules (rule,
    literal, pattern), whose patterns have the value as their first group.

    A rule's literal stands in whatever it matches, so texts meet rules by the containment join of literals, and patterns are
    tried on what meets alone: the work grows with hits, not with texts times rules. Case doesn't count. A rule without a literal
    is refused, since it would meet every text.
    """
    if rules.filter("literal is null or literal = ''").limit(1).count():
        raise ValueError("every rule needs a literal that stands in all its matches")
    low = rules.withColumn("name", F.lower("literal"))
    met = contained_names(texts.select("id", F.lower("text").alias("text")), low.select("name")).join(low, "name").join(texts.select("id", "text"), "id")
    # Rows of one rule come together, since a pattern is compiled when it differs from the row's before.
    spans = met.withColumn("pattern", F.concat(F.lit("(?iu)"), "pattern")).repartition("rule", F.xxhash64("id") % 64).sortWithinPartitions("rule")
    return spans.withColumn("s", F.get(all_spans(F.col("text"), F.col("pattern"), 1), F.lit(0))).filter("s is not null").select("id", "rule", "s.start", "s.end", "s.match", F.trim("s.value").alias("value"))


def component_tokens(component: Column) -> Column:
    """The words of a part's name, and the nouns of parts in it."""
    words = F.filter(F.split(component, r"[/、|（）()\s]+"), lambda t: F.length(t) >= 2)
    return F.array_distinct(F.concat(words, F.array_compact(F.array(*(F.when(F.contains(F.lower(component), F.lit(n.lower())), F.lit(n)) for n in L.COMPONENT_NOUNS)))))


def material_hint(text: Column, component: Column, stated: Column) -> Column:
    """The materials that a text ties to a part, joined by slashes: stated ones (array of label, value, quote) first, then known
    ones by name.

    A material is tied to a part if the part's name has it, or if a phrase leads from one of the name's words to it or back; the
    patterns are made of the row's own words. A text of more than 500 characters is a summary of several parts, so only
    stated materials count there.
    """
    text, component = F.coalesce(text, F.lit("")), F.coalesce(component, F.lit(""))
    tokens = component_tokens(component)

    def tied(material: Column, words: Column) -> Column:
        phrase = lambda t: F.concat(F.lit("(?iu)"), verbatim(t), F.lit(L.MADE_OF), verbatim(material), F.lit("|"), verbatim(material), F.lit(L.MADE_INTO), verbatim(t))
        return F.contains(F.lower(component), F.lower(material)) | F.exists(tokens, lambda t: F.rlike(words, phrase(t)))

    labelled = F.filter(F.coalesce(stated, F.array().cast("array<struct<label:string,value:string,quote:string>>")), lambda p: any_marker(p["label"], L.MATERIAL_LABELS) & (F.trim(p["value"]) != ""))
    said = F.transform(F.filter(labelled, lambda p: tied(F.trim(p["value"]), F.when(F.coalesce(p["quote"], F.lit("")) != "", p["quote"]).otherwise(text))), lambda p: F.trim(p["value"]))

    def named(material: str) -> Column:
        plain = rf"\Q{material}\E"
        pattern = f"(?iu){L.SHORT_MATERIAL_BEFORE}{plain}|{plain}{L.SHORT_MATERIAL_BEHIND}" if material in L.SHORT_MATERIALS else f"(?iu)(?<![A-Za-z]){plain}(?![A-Za-z])"
        return F.when(text.rlike(pattern) & tied(F.lit(material), text), F.lit(material))

    known = F.when(F.length(text) <= L.LONGEST_EVIDENCE, F.array_compact(F.array(*map(named, L.MATERIALS)))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.array_distinct(F.concat(said, known)), " / ")
