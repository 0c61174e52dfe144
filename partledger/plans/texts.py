"""Queries over documents, pages and benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from partledger.functions.text import plain_text, timecode
from partledger.operators import evidence as E
from partledger.operators import records as R
from partledger.operators.blocks import html_blocks, sections
from partledger.operators.repair import repaired
from partledger.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str, *names: str):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return keep


_SENTENCES = "SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda s: trim(s)), lambda s: length(s) >= 12)) AS sentence, unnest(range(len(list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda s: trim(s)), lambda s: length(s) >= 12)))) AS pos FROM documents"


@query(f"""
WITH s AS ({_SENTENCES}), h AS (SELECT *, (2 * (contains(lower(sentence), 'license')::INT + contains(lower(sentence), 'token')::INT + contains(lower(sentence), 'ing the')::INT) + regexp_matches(sentence, '[0-9]')::INT)::BIGINT AS score FROM s)
SELECT doc_id, pos::BIGINT AS pos, sentence, score FROM h WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) <= 3
""", "documents")
def sentence_top_claims(documents):
    return E.top_sentences(documents, "doc_id", "text", ["license", "token", "ing the"], 3)


@query("""
WITH s AS (SELECT doc_id, (CASE WHEN contains(lower(text), 'license') THEN 7 ELSE 0 END + CASE WHEN contains(lower(text), 'version') THEN 7 ELSE 0 END) AS legal, (CASE WHEN contains(lower(text), 'token') THEN 5 ELSE 0 END + CASE WHEN contains(lower(text), 'example.com') THEN 11 ELSE 0 END) AS contact, CASE WHEN contains(lower(text), 'ing') THEN 3 ELSE 0 END AS prose FROM documents),
r AS (SELECT doc_id, list_transform(list_sort(list_filter([{'m': -legal, 'o': 0, 't': 'legal'}, {'m': -contact, 'o': 1, 't': 'contact'}, {'m': -prose, 'o': 2, 't': 'prose'}], lambda x: x.m < 0)), lambda x: x.t) AS tags FROM s)
SELECT doc_id, tags[1] AS tag, array_to_string(tags[2:3], ';') AS others FROM r WHERE len(tags) > 0
""", "documents")
def tagging_weighted(documents):
    lexicon = [("legal", "license"), ("legal", "version"), ("contact", "token"), ("contact", "example.com"), ("prose", "ing")]
    return E.weighted_tags(documents, "doc_id", "text", lexicon)


@query("""
SELECT doc_id, array_to_string(list_filter(['MIT License', 'Apache License', 'GNU', 'CC BY-NC', '%%%'], lambda w: contains(text, w)), ';') AS members FROM documents
""", "documents")
def keyword_membership_ordered(documents):
    found = E.members_in_order(F.col("text"), ["MIT License", "Apache License", "GNU", "CC BY-NC", "%%%"])
    return documents.select("doc_id", F.array_join(found, ";").alias("members"))


@query("""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages
""", "pages")
def html_plain_text(pages):
    return pages.select("page_id", plain_text("html").alias("text"))


@query("", "pages")
def html_block_table(pages):
    return html_blocks(pages, "page_id", "html")


@query("", "pages")
def section_range(pages):
    """Words and blocks of each area and section of a page."""
    of = sections(html_blocks(pages, "page_id", "html"), "page_id").groupBy("page_id", "area", F.coalesce("section", F.lit(-1)).alias("section"))
    return of.agg(F.count("*").alias("blocks"), F.sum(F.size(F.split("text", " "))).cast("long").alias("words"))


_CLAIMS = """
c AS (SELECT item_id, unnest(list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda s: trim(s)), lambda s: length(s) >= 6)) AS claim, unnest(range(len(list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda s: trim(s)), lambda s: length(s) >= 6)))) AS pos, text FROM benchmark),
k AS (SELECT item_id, pos, substr(claim, 1, 40) AS label, CASE WHEN pos % 4 = 3 THEN claim || ' 42' ELSE substr(claim, 1, 12) END AS value, CASE WHEN pos % 5 = 4 THEN reverse(claim) ELSE claim END AS quote, text FROM c),
n AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, trim(regexp_replace(quote, '\\s+', ' ', 'g')) AS q, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS v FROM k),
r AS (SELECT *, CASE WHEN length(trim(label)) < 2 THEN 'invalid_label' WHEN trim(value) = '' THEN 'missing_value' WHEN NOT contains(t, q) THEN 'evidence_not_in_row' WHEN NOT contains(q, v) THEN 'value_not_in_evidence'
  WHEN len(list_filter(regexp_extract_all(label || ' ' || value, '[0-9]+(?:\\.[0-9]+)?'), lambda x: NOT list_contains(regexp_extract_all(quote, '[0-9]+(?:\\.[0-9]+)?'), x))) > 0 THEN 'unsupported_number' END AS why FROM n),
f AS (SELECT *, why IS NULL AND row_number() OVER (PARTITION BY item_id, why IS NULL, lower(v) ORDER BY pos) = 1 AS fresh FROM r),
u AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY item_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM f)
"""


@query(f"WITH {_CLAIMS} SELECT item_id, pos::BIGINT AS pos, value, CASE WHEN why IS NOT NULL THEN why WHEN NOT fresh THEN 'duplicate' WHEN upto > 2 THEN 'over_cap' END AS reason FROM u", "benchmark")
def evidence_validation(benchmark):
    """Candidate parameters of benchmark items, some spoilt, accepted or rejected with a reason; two at most for an item."""
    from partledger.functions.text import collapse_spaces, sentences

    rows = benchmark.select("item_id", F.col("text").alias("row_text"), F.posexplode(sentences("text")).alias("pos", "claim"))
    value = F.when(F.col("pos") % 4 == 3, F.concat("claim", F.lit(" 42"))).otherwise(F.substring("claim", 1, 12))
    quote = F.when(F.col("pos") % 5 == 4, F.reverse("claim")).otherwise(F.col("claim"))
    given = rows.select("item_id", F.col("pos").cast("long").alias("pos"), F.substring("claim", 1, 40).alias("label"), value.alias("value"), quote.alias("quote"), "row_text")
    judged = E.validated(given, ["item_id"], ["pos"], E.parameter_rules("label", "value", "quote", "row_text"), F.lower(collapse_spaces("value")), 2)
    return judged.select("item_id", "pos", "value", "reason")


@query("""
SELECT DISTINCT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, trim(benchmark.text)) WHERE len(string_split_regex(trim(benchmark.text), '\\s+')) >= 3
""", "documents", "benchmark")
def verbatim_gate(documents, benchmark):
    """Benchmark items that stand verbatim in documents."""
    return E.verbatim_hits(documents, "doc_id", "text", benchmark, "item_id", "text")


@query("SELECT doc_id, source FROM documents WHERE doc_id % 4 = 0 OR doc_id % 10 = 3", "documents")
def incremental_hash_skip(documents):
    """Documents that are new or whose text has changed since they were seen."""
    current = documents.select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    old = F.when(F.col("doc_id") % 10 == 3, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("text", 256))
    seen = documents.filter("doc_id % 4 <> 0").select("doc_id", old.alias("digest"))
    return R.changed_rows(current, seen, "doc_id", "digest").select("doc_id", "source")


@query("", "documents")
def mojibake_repair(documents):
    """Texts whose UTF-8 was read as Windows-1252, as every seventh is made here, repaired where that improves them."""
    broken = F.when(F.col("doc_id") % 7 == 0, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    given = documents.select("doc_id", F.md5("text").alias("want"), broken.alias("text"))
    return repaired(given, "text").select("doc_id", "repaired", (F.md5("text") == F.col("want")).alias("as_before"))


@query("SELECT doc_id, n_chars, printf('%02d:%02d:%02d', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) AS code FROM documents", "documents")
def timecode_format(documents):
    return documents.select("doc_id", "n_chars", timecode("n_chars").alias("code"))


@query("SELECT source, lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY ALL", "documents")
def source_statistics(documents):
    return documents.groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))
