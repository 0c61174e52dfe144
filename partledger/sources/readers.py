"""Readers of semi-structured sources: JSON records, price lists, feeds, captions, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON records, one a file, as (good, rejected): a file that does not parse is rejected, not fatal. No schema is inferred.

    Files are read as whole texts and parsed by expression, so that either part can be counted by itself.
    """
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.option("wholetext", True).text(path).withColumn("_file", F.input_file_name())
    rows = rows.withColumn("_record", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    corrupt = F.col(f"_record.{CORRUPT}")
    good = rows.filter(F.col("_record").isNotNull() & corrupt.isNull()).select(*(F.col(f"_record.{f.name}").alias(f.name) for f in schema.fields))
    return good, rows.filter(F.col("_record").isNull() | corrupt.isNotNull()).select("_file", F.col("value").alias(CORRUPT))


def latest_first(rows: DataFrame, date: str, key: str) -> DataFrame:
    return rows.orderBy(F.coalesce(date, F.lit("")).desc(), key)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """A price list in CSV: (product_id, amount, currency, source), amounts that are no numbers null."""
    raw = spark.read.option("header", True).schema("product_id string, amount string, currency string, source string").csv(path)
    return raw.withColumn("amount", F.regexp_replace("amount", r"[^0-9.]", "").try_cast("decimal(14,2)"))


def feed_items(xml: DataFrame, content: str, limit_year: int | None = None) -> DataFrame:
    """(link, title, published) of the items of feed pages, each link once, from a year on."""
    items = xml.select(F.explode(F.regexp_extract_all(F.col(content), F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("item"))
    tag = lambda n: F.trim(F.regexp_extract("item", rf"(?s)<{n}>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{n}>", 1))
    rows = items.select(tag("link").alias("link"), tag("title").alias("title"), F.try_to_timestamp(F.substring(tag("pubDate"), 6, 20), F.lit("dd MMM yyyy HH:mm:ss")).alias("published"))
    rows = rows.filter("link <> ''").groupBy("link").agg(F.max(F.struct("published", "title")).alias("b")).select("link", "b.title", "b.published")
    return rows if limit_year is None else rows.filter(F.year("published") >= limit_year)


FEED_ITEM = "struct<link: string, title: string, author: string, published: timestamp, description: string, content_html: string, categories: array<string>>"


def feed_records(pages: DataFrame, content: str) -> DataFrame:
    """pages with items (array of link, title, author, published, description, content_html, categories): every item of a feed page
    that has a link. Tags of descriptions go, entities are read; a page that is no feed has none."""
    body = F.regexp_replace(F.coalesce(F.col(content), F.lit("")), "\r\n?", "\n")
    data = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"), r"^\s+|\s+$", "")
    tag = lambda item, n: data(F.regexp_extract(item, rf"(?s)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1))
    plain = lambda c: F.trim(F.replace(F.replace(F.regexp_replace(c, "<[^>]+>", ""), F.lit("&#8230;"), F.lit("…")), F.lit("&nbsp;"), F.lit(" ")))
    named = lambda item: F.filter(F.transform(F.regexp_extract_all(item, F.lit(r"(?s)<category(?:\s[^>]*)?>(.*?)</category>"), F.lit(1)), data), lambda c: c != "")
    at = lambda item: F.try_to_timestamp(F.regexp_extract(tag(item, "pubDate"), r"([0-9]{1,2} [A-Z][a-z]{2} [0-9]{4} [0-9:]{8} [+-][0-9]{4})", 1), F.lit("d MMM yyyy HH:mm:ss xx"))
    read = lambda i: F.struct(tag(i, "link").alias("link"), tag(i, "title").alias("title"), tag(i, "dc:creator").alias("author"), at(i).alias("published"), plain(tag(i, "description")).alias("description"), tag(i, "content:encoded").alias("content_html"), named(i).alias("categories"))
    items = F.transform(F.regexp_extract_all(body, F.lit(r"(?s)<item(?:\s[^>]*)?>(.*?)</item>"), F.lit(1)), read)
    return pages.withColumn("items", F.filter(items, lambda i: i["link"] != "").cast(f"array<{FEED_ITEM}>"))


def feed_scan(pages: DataFrame, feed: str, page: str, content: str, year: int | None = None, stop_before: str | None = None, max_pages: int = 50) -> DataFrame:
    """(feed, page, place, link, ...) of the items that a scan of each feed's pages in order yields, a link once.

    A scan ends before a page that is missing, is no feed or has no items, after max_pages, and after a page whose oldest item is
    of an earlier year than year or before stop_before; items of other years, or before stop_before, are left out of the pages that
    are read, items without a date stay. Where each scan ends follows from one row for a page, so pages are read in parallel.
    """
    rows = feed_records(pages, content).select(F.col(feed).alias("feed"), F.col(page).cast("int").alias("page"), "items").filter(F.col("page").between(1, max_pages))
    rows = rows.withColumn("oldest", F.array_min(F.transform("items", lambda i: i["published"])))
    old = F.lit(False)
    if year is not None:
        old = old | (F.year("oldest") < year)
    if stop_before is not None:
        old = old | (F.col("oldest") < F.lit(stop_before).cast("timestamp"))
    order = Window.partitionBy("feed").orderBy("page")
    good = F.size("items") > 0
    ends = rows.select("feed", "page", good.alias("good"), F.coalesce(old, F.lit(False)).alias("old"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("read", (F.col("page") == F.row_number().over(order)) & F.col("good") & ~F.coalesce(F.max(~F.col("good") | F.col("old")).over(before), F.lit(False)))
    read = rows.join(ends.filter("read").select("feed", "page"), ["feed", "page"]).select("feed", "page", F.posexplode("items").alias("place", "i")).select("feed", "page", "place", "i.*")
    if year is not None:
        read = read.filter(F.col("published").isNull() | (F.year("published") == year))
    if stop_before is not None:
        read = read.filter(F.col("published").isNull() | (F.col("published") >= F.lit(stop_before).cast("timestamp")))
    rest = [c for c in read.columns if c not in ("feed", "link", "page", "place")]
    once = read.groupBy("feed", "link").agg(F.min(F.struct("page", "place", *rest)).alias("f"))
    return once.select("feed", "f.page", "f.place", "link", *(F.col(f"f.{c}").alias(c) for c in rest))


def _seconds(stamp: Column) -> Column:
    parts = F.split(F.regexp_replace(stamp, ",", "."), ":")
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p.cast("double"))


def caption_cues(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, cue, start, end, text) of VTT or SRT captions, tags removed and blanks collapsed."""
    stamp = r"(\d{1,2}:)?\d{1,2}:\d{2}[.,]\d{1,3}"
    cue = rf"(?m)^({stamp})\s+-->\s+({stamp})[^\n]*\n((?:[^\n]+(?:\n|$))+)"
    body = F.regexp_replace(content, "\r\n?", "\n")
    get = lambda g: F.regexp_extract_all(body, F.lit(cue), F.lit(g))
    rows = files.select(key, F.posexplode(F.arrays_zip(get(1).alias("s"), get(3).alias("e"), get(5).alias("t"))).alias("cue", "c"))
    text = F.trim(F.regexp_replace(F.regexp_replace("c.t", "<[^>]*>", ""), r"\s+", " "))
    return rows.select(key, "cue", _seconds(F.col("c.s")).alias("start"), _seconds(F.col("c.e")).alias("end"), text.alias("text")).filter("text <> ''")


CUE_LIST = "array<struct<from: double, to: double, content: string, start: double, end: double, text: string>>"


def json_cues(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, cue, start, end, text) of captions in JSON: a list of cues, or an object with one in body; from, to and content, or start, end
    and text. Tags and styles go and blanks are collapsed; a file that is neither has no cues."""
    whole = F.regexp_replace(content, "^\ufeff", "")
    cues = F.coalesce(F.from_json(whole, f"struct<body: {CUE_LIST}>")["body"], F.when(F.trim(whole).startswith("["), F.from_json(whole, CUE_LIST)))
    rows = files.select(key, F.posexplode(cues).alias("cue", "c"))
    said = F.replace(F.replace(F.regexp_replace(F.regexp_replace(F.coalesce("c.content", "c.text", F.lit("")), "<[^>]+>", ""), r"\{\\[^}]+}", ""), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    text = F.trim(F.regexp_replace(said, r"\s+", " "))
    return rows.select(key, "cue", F.coalesce("c.from", "c.start", F.lit(0.0)).alias("start"), F.coalesce("c.to", "c.end", F.lit(0.0)).alias("end"), text.alias("text")).filter("text <> ''")


def with_overlay(rows: DataFrame, overlay: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows in which an overlay's values, where they are not null, stand for their own."""
    o = overlay.select(key, *(F.col(c).alias(f"_o_{c}") for c in columns))
    held = rows.join(o, key, "left")
    return held.withColumns({c: F.coalesce(f"_o_{c}", c) for c in columns}).drop(*(f"_o_{c}" for c in columns))
