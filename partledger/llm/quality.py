"""Operator 10: quality rules with adaptive thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partledger.llm.common import small, table, written

SPACE, SYMBOLS, UPPER = b" \t\n\r\x0b\x0c", b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Base rules: the fewest words, and the most percent of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The measures that get adaptive thresholds.
MEASURES = ("symbols", "upper", "dup_lines", "repeats", "word_length")
#: Fences lie FENCE widths beyond the quartiles. The width is that between the quartiles; where they are equal, a share of a
#: wider span of the same sketch: what it is to the quartiles' on a normal curve. (lower and upper percent, hundredths of it.)
FENCE, SPANS = 3, ((25, 75, 100), (5, 95, 41), (1, 99, 29))
#: Documents that a group's language (and a language's whole) weighs beside the group's own ones in its fences.
PRIOR = 100


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that are found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pair = code[:-1] * len(ids) + code[1:]
    if len(ids) > 1_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, counts = np.unique(pair[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
    again = counts[at] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= again
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, A-Z letters)."""
    t = text or ""
    raw = t.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0,) * 2 + (len(raw) - len(raw.translate(None, SYMBOLS)),) + (0,) * 4
    seen: set[bytes] = set()
    lines = again = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            again += line in seen
            seen.add(line)
    spaces = len(raw) - len(raw.translate(None, SPACE))
    return len(words), len(t) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), again, repeated_words(words), lines, len(raw) - len(raw.translate(None, UPPER))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def measured(docs: DataFrame, text: str, doc_id: str, lang: str, source: str) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            counts = np.array([measure(t) for t in part["text"]], np.int64).reshape(len(part), len(COUNTS))
            yield part.drop(columns="text").assign(**{c: counts[:, i] for i, c in enumerate(COUNTS)})

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    kind = dict(given.dtypes)
    return given.mapInPandas(each, f"doc_id {kind['doc_id']}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def rates() -> dict:
    """Each measure as a whole number: thousandths, or hundredths of a character."""
    per = lambda a, b, times: F.when(F.col(b) > 0, F.floor(F.col(a) * times / F.col(b))).otherwise(F.lit(0)).cast("long")
    return {"symbols": per("n_symbols", "n_words", 1000), "upper": per("n_upper", "word_chars", 1000), "dup_lines": per("n_dup_lines", "n_lines", 1000), "repeats": per("n_repeat_words", "n_words", 1000), "word_length": per("word_chars", "n_words", 100)}


def bin_width(x):
    """The width of the sketch's bin that a whole number is in: 1 below 32, then 1/16 of the number at most."""
    return F.pow(F.lit(2.0), F.greatest(F.length(F.bin(x)) - 5, F.lit(0))).cast("long")


def binned(x):
    """A whole number with only its five leading bits kept: where its bin begins."""
    return (x - x % bin_width(x)).cast("long")


def sketches(measures: DataFrame) -> DataFrame:
    """Mergeable quantile sketches: (lang, source, measure, bin, count) from (lang, source, measure, value)."""
    return measures.groupBy("lang", "source", "measure", binned(F.col("value")).alias("bin")).agg(F.count("*").alias("count"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, size, low, high) from sketches, which are merged over the keys by adding counts; fences in hundredths."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("count").alias("count"))
    group = Window.partitionBy(*keys, "measure")
    upto = merged.withColumn("size", F.sum("count").over(group)).withColumn("upto", F.sum("count").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    q = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("size") * percent, F.col("bin"))).alias(f"q{percent}")
    found = upto.groupBy(*keys, "measure").agg(F.max("size").alias("size"), *(q(percent) for span in SPANS for percent in span[:2]))
    spread = F.coalesce(*(F.when(F.col(f"q{high}") > F.col(f"q{low}"), (F.col(f"q{high}") - F.col(f"q{low}")) * share) for low, high, share in SPANS), F.lit(0))
    # A quartile is known to its bin only, so a fence starts at the bin's far end and no width is less than the bin.
    width = lambda q: F.greatest(spread, 100 * bin_width(F.col(q)))
    return found.select(*keys, "measure", "size", (100 * F.col("q25") - FENCE * width("q25")).alias("low"), (100 * (F.col("q75") + bin_width(F.col("q75"))) + FENCE * width("q75")).alias("high"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, and least_<measure>, most_<measure> for each): a group's own fences, drawn towards its language's by PRIOR
    documents, as those are towards the fences of all; so a small group leans on the larger ones, and none falls off an edge."""
    own = fences(sketch, ["lang", "source"])
    by_lang = fences(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("measure").alias("m"), F.col("size").alias("lang_size"), F.col("low").alias("lang_low"), F.col("high").alias("lang_high"))
    by_all = fences(sketch, []).select(F.col("measure").alias("a"), F.col("low").alias("all_low"), F.col("high").alias("all_high"))
    held = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m"))).join(F.broadcast(by_all), F.col("measure") == F.col("a"))  # one row for each measure
    drawn = lambda n, fence, outer: (n * fence + PRIOR * outer) / (n + PRIOR)
    of = lambda side: drawn(F.col("size"), F.col(side), drawn(F.col("lang_size"), F.col(f"lang_{side}"), F.col(f"all_{side}")))
    named = lambda side, name: [F.max(F.when(F.col("measure") == m, of(side))).alias(f"{name}_{m}") for m in MEASURES]
    return held.groupBy("lang", "source").agg(*named("low", "least"), *named("high", "most"))


def quality_rules(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, lang, source, counts, base_failed, the thresholds, reasons, kept) for each row of docs.

    The sketches cover every document that the base rules pass. They are counts of integer bins, so merging is adding,
    in any order, with the same result. A document fails if a measure is beyond its group's fences on either side (see SPANS,
    PRIOR); a value at a fence stays.
    A null text has no words (and fails the base); null languages and sources are groups of their own; repeated rows
    count and get a row each; very long texts are measured whole; an empty table gives an empty result; where no document of
    a group passes the base there are no thresholds to apply. Other columns of docs are not read, whatever their names.
    """
    feats = measured(docs, text, doc_id, lang, source)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    feats = written(feats.withColumn("base_failed", failed).withColumns(rates()), "quality")
    measures = feats.filter("not base_failed").select("lang", "source", F.explode(F.create_map(*(x for m in MEASURES for x in (F.lit(m), F.col(m))))).alias("measure", "value"))
    limits = written(thresholds(sketches(measures)), "thresholds")
    held = feats.join(small(limits.withColumnsRenamed({"lang": "l", "source": "s"})), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")
    reasons = F.array_compact(F.array(F.when(F.col("base_failed"), F.lit("base")), *(F.when((100 * F.col(m) > F.col(f"most_{m}")) | (100 * F.col(m) < F.col(f"least_{m}")), F.lit(m)) for m in MEASURES)))
    return held.withColumn("reasons", reasons).withColumn("kept", F.size("reasons") == 0)


def op10_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS again
  FROM (SELECT r, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) > 2))
), rep AS (
  SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS x FROM g WHERE again > 1) GROUP BY r
), l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), c AS (
  SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN rep USING (r) LEFT JOIN l USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbols, CASE WHEN word_chars > 0 THEN n_upper * 1000 // word_chars ELSE 0 END AS upper,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeats,
    CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS word_length
  FROM c
), v AS (
  SELECT r, lang, source, unnest(['symbols', 'upper', 'dup_lines', 'repeats', 'word_length']) AS m, unnest([symbols, upper, dup_lines, repeats, word_length]) AS x, base_failed FROM f
), b AS (
  SELECT lang, source, m, x - x % (1::BIGINT << greatest(length(bin(x::BIGINT)) - 5, 0)::BIGINT) AS bin FROM v WHERE NOT base_failed
), g3 AS (
  SELECT lang, source, m, bin, grouping(lang, source) AS level, count(*) AS n FROM b GROUP BY GROUPING SETS ((lang, source, m, bin), (lang, m, bin), (m, bin))
), u AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, m) AS size, sum(n) OVER (PARTITION BY level, lang, source, m ORDER BY bin) AS upto FROM g3
), q AS (
  SELECT level, lang, source, m, max(size)::BIGINT AS size, min(bin) FILTER (upto * 100 >= size) AS q1, min(bin) FILTER (upto * 100 >= size * 5) AS q5, min(bin) FILTER (upto * 100 >= size * 25) AS q25,
    min(bin) FILTER (upto * 100 >= size * 75) AS q75, min(bin) FILTER (upto * 100 >= size * 95) AS q95, min(bin) FILTER (upto * 100 >= size * 99) AS q99 FROM u GROUP BY level, lang, source, m
), e AS (
  SELECT *, CASE WHEN q75 > q25 THEN 100 * (q75 - q25) WHEN q95 > q5 THEN 41 * (q95 - q5) WHEN q99 > q1 THEN 29 * (q99 - q1) ELSE 0 END AS spread,
    1::BIGINT << greatest(length(bin(q25::BIGINT)) - 5, 0)::BIGINT AS b25, 1::BIGINT << greatest(length(bin(q75::BIGINT)) - 5, 0)::BIGINT AS b75 FROM q
), k AS (
  SELECT *, 100 * q25 - 3 * greatest(spread, 100 * b25) AS low, 100 * (q75 + b75) + 3 * greatest(spread, 100 * b75) AS high FROM e
), t AS (
  SELECT o.lang, o.source, o.m, (o.size * o.low + 100 * ((l.size * l.low + 100 * a.low) / (l.size + 100))) / (o.size + 100) AS least,
    (o.size * o.high + 100 * ((l.size * l.high + 100 * a.high) / (l.size + 100))) / (o.size + 100) AS most
  FROM k o JOIN k l ON o.level = 0 AND l.level = 1 AND o.lang IS NOT DISTINCT FROM l.lang AND o.m = l.m JOIN k a ON a.level = 3 AND a.m = o.m
), bad AS (
  SELECT DISTINCT v.r FROM v JOIN t ON v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source AND v.m = t.m WHERE 100 * v.x > t.most OR 100 * v.x < t.least
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM f
"""
