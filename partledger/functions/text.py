"""Text and key expressions, all of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Null for null, empty and blank strings."""
    return F.nullif(F.trim(as_column(c)), F.lit(""))


def first_nonblank(*columns: Column | str) -> Column:
    """The first value that is neither null nor blank, trimmed; an empty string if there is none."""
    return F.coalesce(*(blank_to_null(c) for c in columns), F.lit(""))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole rounded half to even, 0 where whole is 0."""
    return F.when(whole > 0, F.bround(part / whole, digits)).otherwise(F.lit(0.0))


def collapse_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_column(c), r"\s+", " "))


def identity_key(c: Column | str) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(as_column(c)), "[^0-9a-z]+", "")


def slug(c: Column | str) -> Column:
    s = F.trim(F.regexp_replace(F.lower(as_column(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("unknown")).otherwise(s)


def canonical_id(brand: Column | str, model: Column | str) -> Column:
    return F.concat(slug(brand), F.lit("--"), slug(model))


def short_hash(digits: int, *columns: Column | str, algorithm: str = "sha1") -> Column:
    """The first hex digits of a hash over columns that a vertical bar parts."""
    text = F.concat_ws("|", *(F.coalesce(as_column(c).cast("string"), F.lit("")) for c in columns))
    return F.substring(F.sha1(text) if algorithm == "sha1" else F.sha2(text, 256), 1, digits)


def number_and_unit(c: Column | str) -> tuple[Column, Column]:
    """The number and the unit of a text that is one number and one unit, else nulls."""
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z%/]+)\s*$"
    whole = as_column(c).rlike(pattern)
    return F.when(whole, F.regexp_extract(as_column(c), pattern, 1).try_cast("double")), F.when(whole, F.regexp_extract(as_column(c), pattern, 2))


def model_token(c: Column | str) -> Column:
    """The last token of capitals followed by a digit, else the trimmed text."""
    found = F.regexp_extract_all(as_column(c), F.lit("[A-Z]{1,8}[0-9]+[A-Z0-9-]*"), F.lit(0))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.trim(as_column(c)))


def family_match(model: Column, family: Column) -> Column:
    """Whether a model fits a family in which X stands for any one letter or digit."""
    return F.rlike(model, F.concat(F.lit("^"), F.regexp_replace(family, "X", "[A-Z0-9]"), F.lit("$")))


def first_rule(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds, in order."""
    return F.coalesce(*(F.when(condition, F.lit(label)) for condition, label in rules), F.lit(otherwise))


def marker_rules(text: Column, rules: Sequence[tuple[Sequence[str], str]], otherwise: str) -> Column:
    """first_rule over markers that a text contains."""
    any_of = lambda ms: F.exists(F.array(*map(F.lit, ms)), lambda m: F.contains(text, m))
    return first_rule([(any_of(ms), label) for ms, label in rules], otherwise)


def sentences(c: Column | str, least: int = 6) -> Column:
    """Sentences of a text, trimmed, of so many characters at least, in order."""
    return F.filter(F.transform(F.split(as_column(c), r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def timecode(seconds: Column | str) -> Column:
    s = F.floor(as_column(seconds)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def quoted(c: Column | str, most: int = 180) -> Column:
    """A text cut at a length, with an ellipsis where it was cut."""
    return F.when(F.length(as_column(c)) > most, F.concat(F.substring(as_column(c), 1, most), F.lit("…"))).otherwise(as_column(c))


def tolerant_date(c: Column | str) -> Column:
    """A date from the first ten characters, null where they are none."""
    return F.substring(as_column(c), 1, 10).try_cast("date")


def plain_text(html: Column | str) -> Column:
    """Text of HTML: scripts, styles, comments and tags go, blanks are collapsed."""
    bare = F.regexp_replace(as_column(html), r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return collapse_spaces(F.regexp_replace(bare, r"<[^>]*>", " "))


def numbers_in(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(as_column(c), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))


def mixed_tokens(c: Column | str) -> Column:
    """The distinct tokens of a text with and without word breaks, sorted: words of two characters or more, and each ideograph with the
    character after it."""
    t = F.regexp_replace(F.lower(F.coalesce(as_column(c), F.lit(""))), r"(?U)[^\w]+", " ")
    words = F.filter(F.split(t, " "), lambda w: F.length(w) >= 2)
    letters = F.split(t, "")
    pairs = F.filter(F.zip_with(letters, F.slice(letters, 2, F.size(letters)), lambda x, y: F.concat(x, y)), lambda p: p.rlike(r"(?s)^[\u4e00-\u9fff].$"))
    return F.array_sort(F.array_distinct(F.concat(words, pairs)))
