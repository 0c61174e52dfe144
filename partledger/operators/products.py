"""Operators on product records: filters, selections, snapshot merges and title reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partledger.functions.text import blank_to_null, collapse_spaces, first_rule, identity_key, marker_rules


def any_marker(text: Column, markers: Sequence[str]) -> Column:
    """Whether a text contains one of the markers."""
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))


def without_excluded(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """rows without those an override excludes; related says whether one keeps them for related reading only."""
    o = overrides.select(key, "action").distinct()
    flagged = rows.join(o.filter("action = 'exclude'").select(key), key, "left_anti")
    related = o.filter("action = 'related_only'").select(key).withColumn("related", F.lit(True))
    return flagged.join(related, key, "left").fillna(False, ["related"])


def in_keys_or_kind(rows: DataFrame, keys: DataFrame, key: str, kind: Column) -> DataFrame:
    """Rows whose key is listed or that are of a kind that always counts."""
    listed = keys.select(key).distinct().withColumn("_listed", F.lit(True))
    return rows.join(listed, key, "left").filter(F.col("_listed").isNotNull() | kind).drop("_listed")


def other_primary(rows: DataFrame, group: str, key: str, order: Sequence[Column]) -> DataFrame:
    """rows with primary (the first of their group in order) and has_other (another row of the group is there)."""
    best = rows.groupBy(group).agg(F.min(F.struct(*order, F.col(key).alias("_key")))["_key"].alias("primary"), F.count("*").alias("_n"))
    return rows.join(best, group).withColumn("has_other", F.col("_n") > 1).drop("_n")


def replaced_children(current: DataFrame, release: DataFrame, key: str, runtime: Column) -> DataFrame:
    """The release's child rows in place of the current ones, save those that were found at run time: they stay."""
    names = release.columns
    return current.filter(runtime).select(*names).unionByName(release.join(current.filter(runtime).select(key).distinct(), key, "left_anti").select(*names))


def best_filled(rows: DataFrame, cells: Sequence[str], key: str, n: int) -> DataFrame:
    """The n rows with the most filled cells: what a comparison shows before anything is chosen."""
    filled = sum((F.when(blank_to_null(F.col(c).cast("string")).isNotNull(), 1).otherwise(0) for c in cells), F.lit(0))
    return rows.withColumn("filled", filled.cast("long")).orderBy(F.desc("filled"), key).limit(n)


def best_scored(rows: DataFrame, keys: Sequence[str], item: str, rules: Sequence[tuple[Column, int]], base: Column, least: int | None = None) -> DataFrame:
    """(keys, item, score): the item of each key whose base score and rules sum highest, the smallest item of equal ones."""
    score = sum((F.when(c, v).otherwise(0) for c, v in rules), base)
    best = rows.withColumn("_s", score).groupBy(*keys).agg(F.max(F.struct("_s", (-F.col(item)).alias("m"))).alias("b"))
    out = best.select(*keys, (-F.col("b.m")).alias(item), F.col("b._s").alias("score"))
    return out if least is None else out.filter(F.col("score") >= least)


def scored_with_fill(rows: DataFrame, key: str, place: str, score: Column, least: int, cap: int, fill_to: int) -> DataFrame:
    """Up to cap rows of each key that score at least so much, best first; where they are fewer than fill_to, the earliest
    others fill up. In order of place."""
    w = Window.partitionBy(key)
    rated = rows.withColumn("score", score).withColumn("_good", F.col("score") >= least)
    rated = rated.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_good"), F.when(F.col("_good"), -F.col("score")), place)))
    return rated.filter((F.col("_good") & (F.col("_rank") <= cap)) | (~F.col("_good") & (F.col("_rank") <= fill_to))).drop("_good", "_rank")


def merged_inventory(detailed: DataFrame, coarse: DataFrame, keys: Sequence[str], physical: Sequence[str], concrete: Column, tasks: int = 0) -> DataFrame:
    """Detailed rows of each product, one for a model or else for a component and side, and the coarse rows that add something.

    Both have keys, order, component, family, side, model and evidence. A coarse row falls out if its model (or component and
    side) or its evidence is there already, if a detailed row of the same physical family and side is, if its chip's name
    begins one that is there or the other way round, or if it isn't concrete. Each reason is a join of its own on equal
    keys; of equal coarse rows the first stays. Where tasks is given, each of these is dealt to so many, whatever the session's partitions are.
    Both sides are read several times, so they should be tables.
    """
    model = F.regexp_replace(F.upper("model"), "[^A-Z0-9]", "")
    ident = F.when(F.coalesce(model, F.lit("")) != "", F.concat(F.lit("m:"), model)).otherwise(F.concat_ws(":", F.lit("c"), F.regexp_replace("component", r"\s+", ""), F.coalesce("side", F.lit(""))))
    said = F.regexp_replace(F.coalesce("evidence", F.lit("")), r"\s+", "")
    token = F.coalesce(F.try_element_at(F.regexp_extract_all(F.upper("model"), F.lit("[A-Z]{1,8}[0-9]+[A-Z0-9-]*"), F.lit(0)), F.lit(-1)), model, F.lit(""))

    dealt = lambda df, *on: df.repartition(tasks, *on) if tasks else df

    def meet(a: DataFrame, b: DataFrame, on: list[str], how: str) -> DataFrame:
        return dealt(a, *on).join(dealt(b, *on), on, how)

    def first_of(df: DataFrame, by: Column) -> DataFrame:
        w = Window.partitionBy(*keys, "_by").orderBy("order")
        return dealt(df.withColumn("_by", by), *keys).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_by")

    add = lambda df: df.withColumns({"_ident": ident, "_said": said, "_token": token})
    kept = first_of(add(detailed), F.col("_ident"))
    rest = add(coarse.filter(concrete))
    # Sides that rows are only looked up in need no distinct, which would be a shuffle more.
    by = lambda df, *cs: df.select(*keys, *cs)
    rest = meet(meet(rest, by(kept, "_ident"), [*keys, "_ident"], "left_anti"), by(kept.filter("_said <> ''"), "_said"), [*keys, "_said"], "left_anti")
    side = lambda c: F.coalesce(c, F.lit(""))
    families = by(kept.filter(F.col("family").isin(*physical)).withColumn("_side", side(F.col("side"))), "family", "_side")
    r = rest.withColumn("_any", F.explode(F.when(side(F.col("side")) == "", F.array(F.lit("*"))).otherwise(F.array(F.col("side"), F.lit("")))))
    open_side = families.withColumn("_any", F.explode(F.array(F.col("_side"), F.lit("*")))).select(*keys, "family", "_any")
    same_family = meet(r, open_side, [*keys, "family", "_any"], "left_semi").select(*keys, "order")
    # A name that begins another one: both meet on each beginning of the longer one.
    begins = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, F.lit(1), i))
    chips = lambda df: df.filter("family = 'chip' and _token <> ''")
    ours, theirs = chips(rest), by(chips(kept), "_token")
    longer = meet(ours.select(*keys, "order", F.explode(begins(F.col("_token"))).alias("_token")), theirs, [*keys, "_token"], "left_semi")
    shorter = meet(ours, theirs.select(*keys, F.explode(begins(F.col("_token"))).alias("_token")), [*keys, "_token"], "left_semi")
    known = same_family.unionByName(longer.select(*keys, "order")).unionByName(shorter.select(*keys, "order"))
    rest = meet(rest, known, [*keys, "order"], "left_anti")
    rest = first_of(first_of(rest, F.col("_ident")), F.when(F.col("_said") != "", F.col("_said")).otherwise(F.concat(F.lit("#"), F.col("order"))))
    out = lambda df, kind: df.select(*keys, "order", "component", "family", "side", "model", F.lit(kind).alias("kind"))
    return out(kept, "detailed").unionByName(out(rest, "coarse"))


def source_or_fallback(main: DataFrame, other: DataFrame, key: str, score: str, source: str) -> DataFrame:
    """(key, kind, source, score): the best main source of each key; only where there is none, the best other one that scores."""
    best = lambda df, kind: df.groupBy(key).agg(F.max(F.struct(score, (-F.col(source)).alias("m"))).alias("b")).select(key, F.lit(kind).alias("kind"), (-F.col("b.m")).alias(source), F.col(f"b.{score}").alias(score))
    first = best(main, "main")
    second = best(other.filter(F.col(score) > 0), "other")
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def overlaid_if_surer(base: DataFrame, found: DataFrame, keys: Sequence[str], value: str, confidence: str) -> DataFrame:
    """base with the surest found value of each key where it is strictly surer than base's own."""
    best = found.groupBy(*keys).agg(F.max(F.struct(confidence, value)).alias("_b"))
    held = base.join(best, list(keys), "left")
    surer = F.coalesce(F.col(f"_b.{confidence}") > F.coalesce(confidence, F.lit(0.0)), F.lit(False))
    return held.withColumns({value: F.when(surer, F.col(f"_b.{value}")).otherwise(F.col(value)), confidence: F.when(surer, F.col(f"_b.{confidence}")).otherwise(F.col(confidence)), "overlaid": surer}).drop("_b")


def united_by_label(layers: Sequence[DataFrame], keys: Sequence[str], label: str, order: str, cap: int) -> DataFrame:
    """Rows of several layers, of equal labels (blanks and case aside) that of the first layer, then the first in order; cap rows of each key."""
    rows = None
    for i, layer in enumerate(layers):
        one = layer.withColumn("_layer", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    first = Window.partitionBy(*keys, "_same").orderBy("_layer", order)
    rows = rows.withColumn("_same", F.lower(collapse_spaces(label))).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    within = Window.partitionBy(*keys).orderBy("_layer", order)
    return rows.withColumn("place", F.row_number().over(within).cast("long")).filter(F.col("place") <= cap).drop("_layer", "_n", "_same")


def claimed_aliases(base: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(alias, canonical) of a base dictionary without what the reviewed one claims, and the reviewed one."""
    low = lambda df: df.withColumn("_low", F.lower("alias"))
    return low(base).join(low(reviewed).select("_low").distinct(), "_low", "left_anti").drop("_low").unionByName(reviewed)


def without_affixes(text: Column, prefixes: Sequence[str], suffixes: Sequence[str]) -> Column:
    """A name without the first prefix that it begins with and the longest suffix that it ends with."""
    out = F.trim(text)
    begin = first_rule([(F.startswith(F.lower(out), F.lit(p.lower())), p) for p in prefixes], "")
    out = F.trim(F.substring(out, F.length(begin) + 1, F.length(out)))
    end = first_rule([(F.endswith(F.lower(out), F.lit(s.lower())), s) for s in sorted(suffixes, key=lambda s: (-len(s), s))], "")
    return F.trim(F.substring(out, F.lit(1), F.length(out) - F.length(end)))


def parsed_title(title: Column, kinds: Sequence[tuple[str, str]], categories: Sequence[tuple[Sequence[str], str]], brands: Sequence[tuple[str, str]], suffixes: Sequence[str]) -> dict[str, Column]:
    """What a title says: kind by its prefix, category by the first rule, brand by the earliest alias, and the model that is left."""
    from partledger.operators.matching import earliest_alias

    kind = first_rule([(F.startswith(title, F.lit(p)), k) for p, k in kinds], "other")
    rest = without_affixes(title, [p for p, _ in kinds], suffixes)
    brand = earliest_alias(rest, brands)
    model = without_affixes(rest, [a for a, _ in sorted(brands, key=lambda b: (-len(b[0]), b[0]))], suffixes)
    return {"kind": kind, "category": marker_rules(F.lower(title), categories, "unknown"), "brand": brand, "model": model}


def same_text(a: Column, b: Column, least_share: float = 0.68, least_likeness: float = 0.76) -> Column:
    """Whether two texts say the same: one holds the other and is not much longer, or few characters differ."""
    x, y = identity_key(a), identity_key(b)
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    held = (F.contains(x, y) | F.contains(y, x)) & (short >= least_share * long)
    return F.coalesce((short > 0) & ((x == y) | held | (long - F.levenshtein(x, y) >= least_likeness * long)), F.lit(False))


def bullets(rows: DataFrame, key: str, text: str, informative: str, least: int, n: int) -> DataFrame:
    """The n most telling clauses of each text: 4 for an informative word, 2 for a digit, 1 for being short; equal clauses once."""
    parts = rows.select(key, F.posexplode(F.split(text, r"[.;!?\n]+")).alias("pos", "clause")).withColumn("clause", F.trim("clause")).filter(F.length("clause") >= least)
    score = F.when(F.rlike(F.lower("clause"), F.lit(informative)), 4).otherwise(0) + F.when(F.rlike("clause", F.lit("[0-9]")), 2).otherwise(0) + F.when(F.length("clause") <= 40, 1).otherwise(0)
    first = Window.partitionBy(key, F.lower(collapse_spaces("clause"))).orderBy("pos")
    once = parts.withColumn("score", score.cast("long")).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos")).cast("long"))
    return ranked.filter(F.col("rank") <= n).withColumn("pos", F.col("pos").cast("long"))


def grouped_texts(rows: DataFrame, keys: Sequence[str], group: str, text: str, order: str, separator: str = " | ") -> DataFrame:
    """The distinct texts of each group in the order of their first place, joined; a key's groups are rows."""
    first = rows.groupBy(*keys, group, text).agg(F.min(order).alias("_o"))
    held = first.groupBy(*keys, group).agg(F.array_sort(F.collect_list(F.struct("_o", text))).alias("_l"), F.min("_o").alias("first"))
    return held.select(*keys, group, F.array_join(F.transform("_l", lambda s: s[text]), separator).alias("texts"), "first")


def digest_compare(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action) of a move between layouts: copy what is missing, leave what is equal, report what differs or is only new."""
    both = old.select(key, F.col(digest).alias("_a")).join(new.select(key, F.col(digest).alias("_b")), key, "full")
    action = F.when(F.col("_b").isNull(), "copy").when(F.col("_a").isNull(), "only_new").when(F.col("_a") == F.col("_b"), "same").otherwise("conflict")
    return both.select(key, action.alias("action"))
