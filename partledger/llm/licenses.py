"""Operator 2: licence scans by Dice coefficient over word bigrams."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partledger.llm.common import small, table, text_key, written

#: Least Dice coefficient, in percent: whole numbers keep ties exact.
PERCENT = 80

# Names and wording of public licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without"
        " restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the"
        " License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above"
        " copyright notice, this list of conditions and the following disclaimer.",
    ),
)


def normal_words(text: str) -> list[str]:
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " if c.isascii() else c for c in text).split()


def bigrams(words: Sequence[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def normalised(text: Column) -> Column:
    """Words of a text: letters A-Z in lower case, digits and characters beyond ASCII; all else parts them."""
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def telling_words(pairs: Sequence[str], percent: int = PERCENT) -> list[str]:
    """Words of which any text like a template has one: the longest, until too few of its bigrams are without them.

    A like text has at least b * percent / (200 - percent) of the template's b bigrams.
    """
    chosen: list[str] = []
    for word in sorted({w for p in pairs for w in p.split()}, key=lambda w: (-len(w), w)):
        if sum(not set(p.split()) & set(chosen) for p in pairs) * (200 - percent) < len(pairs) * percent:
            break
        chosen.append(word)
    return chosen


def ordered_pairs(text: Column) -> Column:
    """The word bigrams of a text, in order."""

    def paired(words: Column) -> Column:
        n = F.greatest(F.size(words) - 1, F.lit(0))
        return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))

    return bound(normalised(text), paired)


def bound(value: Column, use) -> Column:
    """use(value), where value is computed once however often use has it, also inside its lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def best_passage(every: Column, following: Column, template: Column, percent: int) -> Column:
    """struct(dice, minus_end, start, common) of the run of bigrams that is most like a template, null if none is like it.

    every has the text's bigrams in order, following the place (from 1) at which each stands next, template the template's distinct ones.
    A run's set grows only where a bigram stands first at or after its start, and a run that is like the template has at most
    b * (200 - percent) / percent distinct bigrams. So a start has a bounded list of ends: those first places. The list is kept
    from the last start to the first: a start goes to its front, and its bigram's next place leaves it. The work is the text's length
    times that bound, however often a notice is repeated.
    """
    size = F.size(template)
    most = F.floor(size * (200 - percent) / percent).cast("int") + 1
    hits = F.transform(every, lambda x: F.array_contains(template, x))
    none = F.lit(None).cast("struct<dice: double, minus_end: int, start: int, common: int>")

    def best_end(hit: Column, start: Column, ends: Column, best: Column) -> Column:
        """The better of best and the runs from a start; n and common grow along its ends, and a run ends with a bigram of the template."""

        def longer(held: Column, end: Column) -> Column:
            own = F.element_at(hit, end)
            n, common = held["n"] + 1, held["common"] + F.when(own, 1).otherwise(0)
            run = F.struct((2.0 * common / (n + size)).alias("dice"), (-end).alias("minus_end"), start.alias("start"), common.alias("common"))
            better = own & (200 * common >= percent * (n + size)) & (held["best"].isNull() | (run > held["best"]))
            return F.struct(n.alias("n"), common.alias("common"), F.when(better, run).otherwise(held["best"]).alias("best"))

        return F.aggregate(ends, F.struct(F.lit(0).alias("n"), F.lit(0).alias("common"), best.alias("best")), longer, lambda held: held["best"])

    def step(hit: Column):
        def earlier(held: Column, start: Column) -> Column:
            ends = F.concat(F.array(start), F.slice(F.array_remove(held["ends"], F.element_at(following, start)), F.lit(1), most - 1))
            return bound(ends, lambda e: F.struct(e.alias("ends"), F.when(F.element_at(hit, start), best_end(hit, start, e, held["best"])).otherwise(held["best"]).alias("best")))

        return earlier

    begin = F.struct(F.array().cast("array<int>").alias("ends"), none.alias("best"))
    places = F.sequence(F.size(every), F.lit(1), F.lit(-1))
    return bound(hits, lambda hit: F.aggregate(places, begin, step(hit), lambda held: held["best"]))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = PERCENT, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, unit, license, template, dice): whole texts (unit 0), lines (unit 1, 2, ...) and passages that are like a template.

    Text and template are compared by the Dice coefficient of their sets of word bigrams. Only units with a telling
    word of some template are split into words, and a unit is held against the templates whose number of bigrams b
    allows the coefficient: b * percent / (200 - percent) to b * (200 - percent) / percent bigrams in the unit. Neither loses a match.
    Of several templates the most similar counts, of equally similar ones the first. A null or empty text and one without
    two words has no licence; repeated rows are reported each; a text of one line is reported once, as unit 0; an empty
    table gives an empty result. A licence that neither the whole text nor a line shows is looked for in all runs of words,
    across lines and within them: its best passage, one for each licence of a text, is reported with unit -p, where p is the place of its
    first word (from 1); of several templates of the licence the one with the most common bigrams counts. Very long texts are read
    whole, and the work on passages grows in proportion to them. Templates are data, so plans don't grow with them. Only texts that
    may have a passage, and what was found, are shuffled; other columns of docs are not read, whatever their names.
    """
    known = [(i, name, bigrams(normal_words(t))) for i, (name, t) in enumerate(templates)]
    known = [k for k in known if k[2]]
    telling = sorted({w for _, _, b in known for w in telling_words(b, percent)})
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.split(whole, "\n", -1)
    units = F.when(F.size(lines) > 1, F.concat(F.array(whole), lines)).otherwise(F.array(whole))

    def tells(t: Column) -> Column:
        """The lambda's argument is folded to lower case once, however many words are looked for."""
        return F.exists(F.array(F.lower(t)), lambda low: reduce(lambda a, b: a | b, [low.contains(w) for w in telling]))

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).filter(tells(F.col("text")))
    ids = ["row", "doc_id", "k1", "k2"]
    rows = given.withColumns(dict(zip(("k1", "k2"), text_key(F.col("text")), strict=True))).select(*ids, F.posexplode(units).alias("unit", "text")).filter(tells(F.col("text")))
    rows = rows.select(*ids, "unit", F.array_distinct(ordered_pairs(F.col("text"))).alias("pairs"))
    # Of a unit's bigrams only those that some template has become rows.
    each = rows.select(*ids, "unit", F.size("pairs").alias("n"), F.explode(F.filter("pairs", lambda p: p.isin(*{x for _, _, b in known for x in b}))).alias("pair"))
    of_templates = F.array(*(F.struct(F.lit(i).alias("template"), F.array(*map(F.lit, b)).alias("b")) for i, _, b in known))
    wanted = docs.sparkSession.range(1).select(F.inline(of_templates)).select("template", F.size("b").alias("size"), F.explode("b").alias("pair"))
    # The bigrams of the templates are given as a list, so the table is as large as that.
    counts = each.join(F.broadcast(wanted), "pair").groupBy(*ids, "unit", "n", "template", "size").agg(F.count("*").alias("common"))
    enough = F.col("common") * (200 - percent) >= F.col("size") * percent
    like = (F.col("n") * percent <= F.col("size") * (200 - percent)) & (200 * F.col("common") >= percent * (F.col("n") + F.col("size")))
    names = F.create_map(*(x for i, name, _ in known for x in (F.lit(i), F.lit(name))))
    judged = counts.withColumns({"like": like, "license": names[F.col("template")]}).filter(F.col("like") | (enough & (F.col("unit") == 0)))
    judged = written(judged, "licenses")

    score = F.struct((2.0 * F.col("common") / (F.col("n") + F.col("size"))).alias("dice"), (-F.col("template")).alias("minus"), "license")
    shown = judged.filter("like").groupBy(*ids, "unit").agg(F.max(score).alias("b")).select(*ids, "unit", "b.*")
    asked = judged.filter(enough & (F.col("unit") == 0)).select(*ids, "license", "template")
    asked = written(asked.join(shown.select("row", "license").distinct(), ["row", "license"], "left_anti"), "likely")
    # Equal texts are looked at once; a text is known by its two hashes.
    keys = asked.select("k1", "k2").distinct()
    texts = given.select(*(c.alias(k) for k, c in zip(("k1", "k2"), text_key(F.col("text")), strict=True)), "text").join(small(keys), ["k1", "k2"], "left_semi")
    texts = written(texts.groupBy("k1", "k2").agg(ordered_pairs(F.min("text")).alias("every")), "passages")
    places = texts.select("k1", "k2", F.posexplode("every").alias("at", "pair")).withColumn("next", F.lead("at").over(Window.partitionBy("k1", "k2", "pair").orderBy("at")) + 1)
    following = places.groupBy("k1", "k2").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("next", F.lit(0)).alias("next")))), lambda p: p["next"]).alias("following"))
    of = F.element_at(F.array(*(F.array(*map(F.lit, b)) for _, _, b in known)), F.array_position(F.array(*(F.lit(i) for i, _, _ in known)), F.col("template")).cast("int"))
    held = asked.select("k1", "k2", "template").distinct().join(texts.join(following, ["k1", "k2"]), ["k1", "k2"]).withColumn("b", of)
    held = held.select("k1", "k2", "template", best_passage(F.col("every"), F.col("following"), F.col("b"), percent).alias("at")).filter("at is not null")
    inside = asked.join(held, ["k1", "k2", "template"]).groupBy("row", "doc_id", "license").agg(F.max(F.struct("at.common", "at.dice", (-F.col("template")).alias("minus"), "at.start")).alias("p"))
    out = shown.select("doc_id", "unit", "license", "minus", "dice").unionByName(inside.select("doc_id", (-F.col("p.start")).alias("unit"), "license", "p.minus", "p.dice"))
    return out.select("doc_id", F.col("unit").cast("long").alias("unit"), "license", (-F.col("minus")).cast("long").alias("template"), "dice")


def op2_licenses(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join(f"({i}, '{name}', [{', '.join(chr(39) + b + chr(39) for b in bigrams(normal_words(t)))}])" for i, (name, t) in enumerate(TEMPLATES))
    return rf"""
WITH t(template, license, b) AS (VALUES {rows}), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), u AS (
  SELECT r, doc_id, 0 AS unit, text FROM d
  UNION ALL SELECT r, doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)), unnest(string_split(text, chr(10))) FROM d WHERE contains(text, chr(10))
), w AS (
  SELECT r, doc_id, unit, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM u
), p AS (
  SELECT r, doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pairs FROM w WHERE len(w) > 1
), s AS (
  SELECT r, doc_id, unit, license, template, 2.0 * len(list_intersect(pairs, b)) / (len(pairs) + len(b)) AS dice FROM p, t WHERE 200 * len(list_intersect(pairs, b)) >= 80 * (len(pairs) + len(b))
)
SELECT doc_id, unit::BIGINT AS unit, license, template::BIGINT AS template, dice::DOUBLE AS dice FROM s
QUALIFY row_number() OVER (PARTITION BY r, unit ORDER BY dice DESC, template) = 1
"""


OP2_SQL = _sql()
