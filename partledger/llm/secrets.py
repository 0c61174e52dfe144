"""Operator 1: secret scans over a trigram inverted index."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser as regex_tree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partledger.llm.common import small, table, text_key, written

#: Alternatives up to which strings are spelled out when a regex's trigrams are derived.
SPELLED = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex that both Java and Python read alike, and the least length of one of its groups."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"),
    # Published formats of keys, tokens and links that carry them.
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}"),
    Rule("google_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("google_token", r"ya29\.[0-9A-Za-z_-]{20,}"),
    Rule("stripe", r"[sr]k_live_[0-9a-zA-Z]{24,}"),
    Rule("square", r"sq0(?:csp|atp)-[0-9A-Za-z_-]{22,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("mailgun", r"key-[0-9a-f]{32}"),
    Rule("mailchimp", r"[0-9a-f]{32}-us[0-9]{1,2}"),
    Rule("openai", r"sk-[A-Za-z0-9_-]{20,}T3BlbkFJ[A-Za-z0-9_-]{20,}"),
    Rule("huggingface", r"hf_[A-Za-z0-9]{34,}"),
    Rule("aws_session", r"ASIA[A-Z0-9]{16}"),
    Rule("slack_hook", r"hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]+"),
    Rule("discord_hook", r"discord(?:app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+"),
    Rule("telegram", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"[a-z]{2,12}://[A-Za-z0-9._%-]{1,64}:[A-Za-z0-9._%!$*-]{1,64}@[A-Za-z0-9]"),
    Rule("digitalocean", r"do[opr]_v1_[a-f0-9]{64}"),
    Rule("shopify", r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}"),
    Rule("databricks", r"dapi[0-9a-f]{32}"),
    Rule("doppler", r"dp\.pt\.[A-Za-z0-9]{40,}"),
    Rule("heroku", r"HRKU-[0-9A-Za-z_-]{36,}"),
    Rule("linear", r"lin_api_[A-Za-z0-9]{40}"),
    Rule("newrelic", r"NRAK-[A-Z0-9]{27}"),
    Rule("azure_storage", r"AccountKey=[A-Za-z0-9+/=]{40,}"),
    Rule("atlassian", r"ATATT3[A-Za-z0-9_=-]{60,}"),
    Rule("age", r"AGE-SECRET-KEY-1[A-Z0-9]{58}"),
    Rule("putty", r"PuTTY-User-Key-File-[0-9]"),
)
BASE = ("assign", "access", "hex")

Query = frozenset[frozenset[str]]  # an OR of ANDs of trigrams
ANY: Query = frozenset([frozenset()])


def either(queries: Sequence[Query]) -> Query:
    ands = {a for q in queries for a in q}
    return frozenset(a for a in ands if not any(b < a for b in ands))


def both(p: Query, q: Query) -> Query:
    return either([frozenset(a | b for a in p for b in q)])


def trigrams(strings: set[str]) -> Query:
    return either([frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings])


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    run, query, whole = {""}, ANY, True
    for node in nodes:
        spelled, own = _node(node)
        if spelled is not None and len(run) * len(spelled) <= SPELLED:
            run = {a + b for a in run for b in spelled}
            continue
        query, whole = both(both(query, trigrams(run)), trigrams(spelled) if spelled is not None else own), False
        run = {""}
    return (run if whole else None), both(query, trigrams(run))


def _node(node) -> tuple[set[str] | None, Query]:
    """The strings that a part of a regex stands for, if they are few, and the trigram query it implies."""
    op, value = node
    if op is C.LITERAL:
        return {chr(value).lower()}, ANY
    if op is C.SUBPATTERN:
        return _sequence(value[-1])
    if op is C.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        spelled = [s for s, _ in parts]
        return (set().union(*spelled) if all(s is not None for s in spelled) else None), either([q for _, q in parts])
    if op is C.IN and all(o is C.LITERAL for o, _ in value) and len(value) <= 8:
        return {chr(v).lower() for _, v in value}, ANY
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, of = value
        spelled, own = _sequence(of)
        if spelled is not None and high <= 1:
            return (spelled if low else spelled | {""}), ANY
        return None, (own if low else ANY)
    if op is C.AT:
        return {""}, ANY
    return None, ANY


def trigram_query(regex: str) -> Query:
    """The trigrams that any match holds, in lower case: an OR of ANDs. ANY (one empty AND) if none is mandatory."""
    return _sequence(regex_tree.parse(regex))[1]


def postings(docs: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """The inverted index (trigram, key): a row for each document that holds the trigram in either case.

    It holds the trigrams that the rules ask for. A row is as good as the next, so no trigram's list stands in one
    task, however common the trigram is.
    """
    held = F.flatten(F.transform(F.array(F.lower("text")), lambda low: F.array_compact(F.array(*(F.when(low.contains(t), F.lit(t)) for t in vocabulary)))))
    return docs.select("key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): the postings of each AND intersected by counting them for each document, the ANDs of a kind united."""
    rows = [(kind, n, t, len(a)) for kind, q in queries.items() for n, a in enumerate(sorted(q, key=sorted)) for t in sorted(a)]
    asked = index.sparkSession.createDataFrame(rows, "kind string, part int, trigram string, needed long")
    hits = index.join(F.broadcast(asked), "trigram").groupBy("key", "kind", "part").agg(F.count_distinct("trigram").alias("found"), F.first("needed").alias("needed"))
    return hits.filter("found = needed").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def matches(rule: Rule, order: int, text: Column) -> Column:
    """Array of (start, order, kind, end): leftmost matches that do not overlap, without those that are too short.

    The texts between the matches and the matches give the offsets, in code points.
    """
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    sized = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    steps = F.arrays_zip(F.split(text, rule.regex, -1).alias("gap"), found.alias("hit"), sized.alias("sized"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.array(F.struct(begin.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        held = F.when(x["hit"].isNotNull() & (F.length(x["sized"]) >= rule.least), F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(F.coalesce(end, begin).alias("at"), held.alias("spans"))

    return F.when(F.size(found) > 0, F.aggregate(steps, start, step, lambda acc: acc["spans"])).otherwise(start["spans"])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, secrets): for each row of docs the array of (start, ord, kind, end) of its secrets, by start, then rule.

    From each regex a Boolean trigram query is derived; documents whose postings meet it are candidates, on which
    the regex itself is run. A rule without mandatory trigrams (as of hex digits) is run on every document.
    A null text counts as empty and has no secrets; very long texts are searched whole; rows are keyed by id and a 128-bit hash of the text, so repeated
    rows and null ids get a row each; an empty table gives an empty result. Other columns of docs are not read.
    """
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    asked = {k: q for k, q in queries.items() if q != ANY}
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"))
    rows = rows.withColumn("key", F.struct("doc_id", *(h.alias(f"h{i}") for i, h in enumerate(text_key(F.col("text"))))))
    if asked:
        index = postings(rows, sorted({t for q in asked.values() for a in q for t in a}))
        found = written(candidates(index, asked).select(*(F.col(f"key.{c}").alias(f"k_{c}") for c in ("doc_id", "h0", "h1")), "kinds"), "candidates")
        on = [F.col(f"key.{c}").eqNullSafe(F.col(f"k_{c}")) for c in ("doc_id", "h0", "h1")]
        rows = rows.join(small(found), reduce(lambda a, b: a & b, on), "left")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    each = []
    for order, rule in enumerate(rules):
        spans = matches(rule, order, F.col("text"))
        each.append(spans if rule.kind not in asked else F.when(F.array_contains("kinds", rule.kind), spans).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("secrets"))


def op1_secrets(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(of, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def brute_force(text: str | None, rules: Sequence[Rule] = RULES) -> list[tuple[int, int, str, int]]:
    """What scan_secrets finds, by running every regex over the text; for tests."""
    out = []
    for order, rule in enumerate(rules):
        out += [(m.start(), order, rule.kind, m.end()) for m in re.compile(rule.regex, re.ASCII).finditer(text or "") if len(m.group(rule.group)) >= rule.least]
    return sorted(out)


def _sql() -> str:
    """Matches and the texts between them give the places."""
    parts = []
    for order, rule in enumerate(RULES):
        regex = rule.regex.replace("'", "''")
        parts.append(f"SELECT r, {order} AS ord, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(t, '{regex}') AS gaps, regexp_extract_all(t, '{regex}') AS hits, regexp_extract_all(t, '{regex}', {rule.group}) AS sized FROM d")
    count = lambda kind: f"count(*) FILTER (kind = '{kind}')::BIGINT AS n_{kind}"
    named = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord)"
    base = ", ".join(f"'{k}'" for k in BASE)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}),
x AS (SELECT r, ord, kind, least, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(sized) AS sized, unnest(gaps[1 : len(hits)]) AS gap FROM m WHERE len(hits) > 0),
y AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, ord ORDER BY i)::BIGINT AS stop FROM x), z AS (SELECT r, ord, kind, stop - length(hit) AS start, stop FROM y WHERE length(sized) >= least),
a AS (SELECT r, {", ".join(map(count, BASE))}, {named} FILTER (kind IN ({base})) AS base, {named} AS spans FROM z GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)
"""


OP1_SQL = _sql()
