"""Matches of patterns with their places, clauses and context: expressions of built-in functions.

Places are numbers of characters from 0, ends exclusive. Patterns never match an empty text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case doesn't count, in any alphabet, and letters of all alphabets are letters of words.
ANY_CASE = "(?iuU)"


def all_spans(text: Column, pattern: Column | str, group: int = 0) -> Column:
    """Every match of a pattern in order: array of (start, end, match, value), value being a group of it."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, values = (F.regexp_extract_all(text, pattern, F.lit(g)) for g in (0, group))
    parts = F.arrays_zip(found, values, F.split(text, pattern, -1))  # what stands before each match, and after the last
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string,value:string>>").alias("out"))

    def take(held: Column, x: Column) -> Column:
        begin = held["at"] + F.length(x["2"])
        span = F.struct(begin.alias("start"), (begin + F.length(x["0"])).alias("end"), x["0"].alias("match"), x["1"].alias("value"))
        return F.when(x["0"].isNull(), held).otherwise(F.struct((begin + F.length(x["0"])).alias("at"), F.array_append(held["out"], span).alias("out")))

    return F.coalesce(F.aggregate(parts, start, take, lambda held: held["out"]), F.array().cast("array<struct<start:int,end:int,match:string,value:string>>"))


def first_span(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match as (start, end, match, value); null if there is none."""
    begin, match = F.regexp_instr(text, F.lit(pattern)) - 1, F.regexp_extract(text, pattern, 0)
    return F.when(begin >= 0, F.struct(begin.alias("start"), (begin + F.length(match)).alias("end"), match.alias("match"), F.regexp_extract(text, pattern, group).alias("value")))


def clauses(text: Column, marks: str = "。！？!?；;") -> Column:
    """The clauses of a text, each with the mark that ends it, trimmed."""
    return F.transform(F.split(text, rf"(?<=[{marks}])\s*"), lambda c: F.trim(c))


def around(text: Column, start: Column, end: Column, reach: int) -> Column:
    """A span and so many characters on either side."""
    begin = F.greatest(start - reach, F.lit(0))
    return F.substring(text, begin + 1, end + reach - begin)


def any_match(text: Column, patterns: Sequence[str], flags: str = "(?iu)") -> Column:
    return text.rlike(f"{flags}(?:{'|'.join(patterns)})")


def any_marker(text: Column, markers: Sequence[str]) -> Column:
    """Whether a text has one of some words, whatever their case."""
    low = F.lower(text)
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(low, F.lit(m.lower()))
    return found


def first_label(text: Column, rules: Sequence[tuple[str, Sequence[str]]], otherwise: str = "") -> Column:
    """The label of the first rule with a marker that a text has."""
    return F.coalesce(*(F.when(any_marker(text, markers), F.lit(label)) for label, markers in rules), F.lit(otherwise))
