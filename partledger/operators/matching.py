"""Dictionary joins, match cascades, fuzzy matches and greedy entity merges."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partledger.functions.text import blank_to_null

def earliest_alias(text: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    """The canonical name of the alias that stands earliest in a text; of those, the longest, then by name; else an empty string."""
    low = F.lower(text)
    found = F.array(*(F.when(F.contains(low, F.lit(a.lower())), F.struct(F.instr(low, a.lower()).alias("at"), F.lit(-len(a)).alias("minus"), F.lit(name).alias("name"))) for a, name in aliases))
    return F.coalesce(F.array_min(F.array_compact(found))["name"], F.lit(""))


def earliest_alias_join(df: DataFrame, text: str, key: str, aliases: DataFrame, name: str) -> DataFrame:
    """earliest_alias with a dictionary of any size (alias, canonical) whose aliases are whole words or runs of words.

    Texts are exploded to words with their places, joined with the aliases by first word, and checked: no nested loop.
    """
    words = df.select(key, F.posexplode(F.split(F.lower(text), r"\s+")).alias("_p", "_w"))
    known = aliases.select(F.lower("alias").alias("_a"), "canonical").withColumn("_w", F.element_at(F.split("_a", r"\s+"), 1))
    single = F.size(F.split("_a", r"\s+")) == 1
    hits = words.join(known, "_w").select(key, "_p", "_a", "canonical")
    # Aliases of one word are hits already; only for longer ones the text is fetched, once for each of its hits.
    rest = F.array_join(F.slice(F.split("_t", r"\s+"), F.col("_p") + 1, F.size(F.split("_a", r"\s+"))), " ")
    longer = hits.filter(~single).join(df.select(key, F.lower(text).alias("_t")), key).filter(rest == F.col("_a")).drop("_t")
    best = hits.filter(single).unionByName(longer).groupBy(key).agg(F.min(F.struct("_p", (-F.length("_a")).alias("m"), "canonical")).alias("b"))
    return df.join(best.select(key, F.col("b.canonical").alias(name)), key, "left").fillna("", [name])


def canonical_name(value: Column, exact: dict[str, str], rules: Sequence[tuple[str, str]]) -> Column:
    """A name by its normalised form, else by the first rule whose marker it contains, else as it is."""
    key = F.regexp_replace(F.lower(value), "[^0-9a-z]+", "")
    table = F.create_map(*(F.lit(x) for pair in exact.items() for x in pair))
    ruled = [F.when(F.contains(F.lower(value), F.lit(m)), F.lit(name)) for m, name in rules]
    return F.coalesce(F.try_element_at(table, key), *ruled, value)


def match_cascade(items: DataFrame, candidates: DataFrame, item_key: str, steps: Sequence[tuple[Sequence[tuple[str, str]], float]], candidate_key: str) -> DataFrame:
    """The best candidate of each item: steps of equal columns in falling confidence; the smallest candidate key breaks ties.

    Of candidates with equal columns of a step only the smallest counts, so each step joins an item with one candidate at most; the
    first step that finds one wins.
    """
    found = None
    for k, (pairs, confidence) in enumerate(steps):
        smallest = candidates.groupBy(*(b for _, b in pairs)).agg(F.min(candidate_key).alias("matched"))
        on = None
        for a, b in pairs:
            eq = (items[a] == smallest[b]) & blank_to_null(items[a]).isNotNull()
            on = eq if on is None else on & eq
        hits = items.join(smallest, on).select(items[item_key], F.struct(F.lit(k).alias("k"), "matched", F.lit(confidence).alias("confidence")).alias("hit"))
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy(item_key).agg(F.min("hit").alias("b")).select(item_key, "b.matched", "b.confidence")
    return items.select(item_key).join(best, item_key, "left")


def segment_keys(text: Column, k: int) -> Column:
    """Keys of which two texts within k edits share one: a text is cut into k + 1 segments, one of which the edits leave as it is,
    and the longer text has it within k places. Array of (own, key): segments of the text itself, and what it looks for in shorter ones."""
    n, out = F.length(text), []
    for less in range(k + 1):
        length = n - less
        cut = lambda j: F.floor(length * j / (k + 1)).cast("int")  # noqa: B023, E731
        for i in range(k + 1):
            for shift in range(max(-i, less - (k - i)), min(i, less + k - i) + 1):
                fits = (length >= k + 1) & (cut(i) + shift >= 0) & (cut(i + 1) + shift <= n)
                key = F.xxhash64(length, F.lit(i), F.substring(text, cut(i) + shift + 1, cut(i + 1) - cut(i)))
                out.append(F.when(fits, F.struct(F.lit(less == 0 and shift == 0).alias("own"), key.alias("key"))))
    return F.array_compact(F.array(*out))


def similar_pairs(df: DataFrame, key: str, text: str, block: Column, most_edits: int) -> DataFrame:
    """Pairs of rows of a block whose texts are within so many edits. Rows meet on equal segments, not each with each; texts
    of no more characters than edits, which have no segments, meet those that are about as short."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"), block.alias("_b"))
    keyed = rows.withColumn("_e", F.explode(segment_keys(F.col("text"), most_edits))).select("id", "text", "_b", "_e.own", "_e.key")
    x = keyed.filter("own").select(F.col("id").alias("x"), F.col("text").alias("x_text"), "_b", "key")
    y = keyed.select(F.col("id").alias("y"), F.col("text").alias("y_text"), "_b", "key")
    short = rows.filter(F.length("text") <= 2 * most_edits)
    xs, ys = short.select(F.col("id").alias("x"), F.col("text").alias("x_text"), "_b"), short.select(F.col("id").alias("y"), F.col("text").alias("y_text"), "_b")
    met = x.join(y, ["_b", "key"]).drop("key").unionByName(xs.join(ys, "_b")).filter("x <> y")
    near = met.withColumn("edits", F.levenshtein("x_text", "y_text", most_edits)).filter("edits >= 0")
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "edits").distinct()


def greedy_merge(df: DataFrame, keys: Sequence[str], model: str, order: str) -> DataFrame:
    """Entities of each key: a model joins the first entity that it fits, an X standing for any one character.

    Rows are aggregated to one for each model, with its first place and its number, before the fold, which takes models by first
    places. Only models of one length can fit, so a key's models of a length are one group: distinct names, not rows. In it entities
    are kept by their known places and the letters there, so a model looks its entities up once for each set of
    places that occurs.
    """
    names = df.groupBy(*keys, model).agg(F.min(order).alias("_first"), F.count("*").alias("_rows")).withColumn("_length", F.length(model))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        entities: list[list] = []
        # For each set of places that entities know, and each part of it that a model knows: entities by their letters there.
        views: dict[tuple[int, ...], dict[tuple[int, ...], dict[tuple[str, ...], set[int]]]] = {}
        letters = lambda m, places: tuple(m[p] for p in places)
        known = lambda m: tuple(p for p, c in enumerate(m) if c != "X")

        def keep(i: int, m: str) -> None:
            of = views.setdefault(known(m), {known(m): {}})
            for part, view in of.items():
                view.setdefault(letters(m, part), set()).add(i)

        def drop(i: int, m: str) -> None:
            for part, view in views[known(m)].items():
                view[letters(m, part)].discard(i)

        def first_fit(m: str) -> int | None:
            mine, best = set(known(m)), None
            for places, of in views.items():
                part = tuple(p for p in places if p in mine)
                if part not in of:
                    of[part] = view = {}
                    for held in of[places].values():
                        for i in held:
                            view.setdefault(letters(entities[i][0], part), set()).add(i)
                best = min(of[part].get(letters(m, part), set()) | ({best} - {None}), default=None)
            return best

        ordered = rows.sort_values(["_first", model])
        for m, n in zip(ordered[model], ordered["_rows"], strict=True):
            i = first_fit(m)
            if i is None:
                entities.append([m, n])
                keep(len(entities) - 1, m)
                continue
            entities[i][1] += n
            if m.count("X") < entities[i][0].count("X"):
                drop(i, entities[i][0])
                entities[i][0] = m
                keep(i, m)
        out = pd.DataFrame(entities, columns=[model, "merged"])
        for k in keys:
            out[k] = rows[k].iloc[0]
        return out[[*keys, model, "merged"]]

    kinds = dict(df.dtypes)
    return names.groupBy(*keys, "_length").applyInPandas(fold, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {model} string, merged long")
