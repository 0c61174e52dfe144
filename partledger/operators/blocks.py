"""HTML as an ordered table of blocks, and sections over it."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
BREAKS = {"p", "li", "figcaption", "td", "blockquote", *HEADINGS}
HIDDEN = {"script", "style", "noscript", "template"}
#: Pages whose blocks are made at once.
PAGES = 128
AREAS = {"nav", "article", "footer", "header", "aside"}


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.words, self.tag, self.hidden, self.area = [], [], "text", 0, ["body"]

    def flush(self):
        text = " ".join("".join(self.words).split())
        if text:
            self.blocks.append((self.tag, HEADINGS.get(self.tag, 0), self.area[-1], text, ""))
        self.words, self.tag = [], "text"

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in AREAS:
            self.flush()
            self.area.append(tag)
        elif tag in BREAKS:
            self.flush()
            self.tag = tag
        elif tag == "img":
            kept = dict(attrs)
            self.flush()
            self.blocks.append(("img", 0, self.area[-1], kept.get("alt") or "", kept.get("src") or ""))
        elif tag == "br":
            self.words.append(" ")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in AREAS:
            self.flush()
            if tag in self.area[1:]:
                self.area.pop()
        elif tag in BREAKS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def block_batches(batches: Iterator[pa.RecordBatch], key: str, html: str) -> Iterator[pa.RecordBatch]:
    """The blocks of batches of pages, of a few pages at a time: a task holds an Arrow batch and the objects of those few."""
    for whole in batches:
        schema = pa.schema([whole.schema.field(key), ("pos", pa.int64()), ("kind", pa.string()), ("level", pa.int32()), ("area", pa.string()), ("text", pa.string()), ("src", pa.string())])
        for at in range(0, whole.num_rows, PAGES):
            part, rows = whole.slice(at, PAGES), []
            for k, h in zip(part.column(key), part.column(html), strict=True):
                parser = _Blocks()
                parser.feed(h.as_py() or "")
                parser.close()
                parser.flush()
                rows += [(k.as_py(), i, *b) for i, b in enumerate(parser.blocks)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, kind, level, area, text, src): headings, paragraphs and images of each page in order; no built-in parses HTML."""
    each = lambda batches: block_batches(batches, key, html)
    return pages.select(key, html).mapInArrow(each, f"{key} {dict(pages.dtypes)[key]}, pos long, kind string, level int, area string, text string, src string")


def sections(blocks: DataFrame, key: str) -> DataFrame:
    """Each heading's section: blocks up to the next heading of the same or a higher level."""
    heads = F.when(F.col("level") > 0, F.col("pos"))
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.last(heads, ignorenulls=True).over(upto))


def html_media(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, kind, place, link, alt): images and frames of a page with a link, each kind in order; links without a scheme get one."""
    attribute = lambda tag, name: F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'[^']*'|[^\s>]+)""", 0)
    value = lambda tag, name: F.trim(F.regexp_replace(F.regexp_replace(attribute(tag, name), r"(?is)^\s\w+\s*=\s*", ""), "^[\"']|[\"']$", ""))
    bare = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")

    def tags(kind: str, name: str) -> Column:
        of = lambda t: F.struct(F.lit(kind).alias("kind"), F.regexp_replace(value(t, "src"), "^//", "https://").alias("link"), value(t, "alt").alias("alt"))
        return F.filter(F.transform(F.regexp_extract_all(bare, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0)), of), lambda m: m["link"] != "")

    numbered = lambda found: F.transform(found, lambda m, i: F.struct(m["kind"].alias("kind"), i.alias("place"), m["link"].alias("link"), m["alt"].alias("alt")))
    return pages.select(key, F.explode(F.concat(numbered(tags("image", "img")), numbered(tags("frame", "iframe")))).alias("m")).select(key, "m.*")
