"""Identity keys, names, links and scores."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from partledger.functions.text import as_column, blank_to_null, first_nonblank


@pandas_udf(StringType())
def folded_key(values: pd.Series) -> pd.Series:
    """Compatibility-composed, case-folded letters and digits: no built-in normalises Unicode."""
    return values.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKC", v).casefold() if c.isalnum()))


@pandas_udf(StringType())
def ascii_slug(values: pd.Series) -> pd.Series:
    """A slug from the ASCII letters that are left when accents are taken off; unknown if there are none."""

    def one(v: str | None) -> str:
        bare = unicodedata.normalize("NFKD", v or "").encode("ascii", "ignore").decode().lower()
        return "-".join("".join(c if c.isalnum() else " " for c in bare).split()) or "unknown"

    return values.map(one)


def bare_company(c: Column | str, suffixes: Sequence[str]) -> Column:
    """A company name in lower case without marks and legal forms at its end."""
    plain = F.trim(F.regexp_replace(F.lower(as_column(c)), "[^0-9a-z]+", " "))
    return F.trim(F.regexp_replace(plain, rf"(?: (?:{'|'.join(suffixes)}))+$", ""))


def latin_tokens(c: Column | str, least: int = 2) -> Column:
    """The distinct lower-case runs of letters and digits, in order."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(as_column(c)), F.lit("[a-z0-9]+"), F.lit(0))), lambda t: F.length(t) >= least)


def token_score(text: Column | str, wanted: Column, whole: float, part: float) -> Column:
    """Points for each wanted token that a text has: whole for a token of its own, part for one inside another."""
    tokens, low = latin_tokens(text, 1), F.lower(as_column(text))
    points = lambda t: F.when(F.array_contains(tokens, t), whole).when(F.contains(low, t), part).otherwise(0.0)
    return F.aggregate(wanted, F.lit(0.0), lambda acc, t: acc + points(t))


def clean_link(c: Column | str) -> Column:
    """A link in lower case up to its path, without www, port, query, fragment and final slash; null where it is none."""
    url = F.trim(as_column(c))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]+)", 1)), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), "/+$", "")
    return F.when(host != "", F.concat(host, path))


def number_in_link(c: Column | str) -> Column:
    """The last number of a link's path."""
    return F.try_element_at(F.regexp_extract_all(F.regexp_extract(as_column(c), r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), F.lit("[0-9]+"), F.lit(0)), F.lit(-1)).try_cast("long")


def display_name(brand: Column | str, model: Column | str, key: Column | str) -> Column:
    return first_nonblank(F.concat_ws(" ", blank_to_null(brand), blank_to_null(model)), as_column(key).cast("string"))


def price_label(amount: Column | str, currency: Column | str, signs: dict[str, str]) -> Column:
    """An amount of two decimals after its currency's sign, or after the currency's name."""
    sign = F.coalesce(*(F.when(as_column(currency) == k, F.lit(v)) for k, v in signs.items()), F.concat(as_column(currency), F.lit(" ")))
    return F.when(as_column(amount).isNotNull(), F.concat(sign, F.format_string("%.2f", as_column(amount))))


def search_tags(columns: Sequence[Column], most: int) -> Column:
    """Distinct values that are not blank, in order, up to a number."""
    return F.slice(F.array_distinct(F.filter(F.array(*(F.trim(c) for c in columns)), lambda v: v.isNotNull() & (v != ""))), 1, most)


def first_json_object(c: Column | str) -> Column:
    """The first flat JSON object in a text that may have fences around it."""
    return F.nullif(F.regexp_extract(as_column(c), r"(\{[^{}]*\})", 1), F.lit(""))
