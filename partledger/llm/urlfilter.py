"""Operator 7: URL filters by a temporal join of captures with dated list entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from partledger.llm.common import table, written


def host_of(url: Column) -> Column:
    """The host in lower case without port, user or final dot; empty if there is none."""
    return F.coalesce(F.rtrim(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)", 1), F.lit(".")), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and the domains that it belongs to, of two labels or more: as many as the host has labels, at most."""
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) > 1, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))


def states(entries: DataFrame, moments: DataFrame) -> DataFrame:
    """(domain, t, listed, since) for the moments (domain, t): what the last entry up to t says, and when it was made.

    entries has domain, at and listed (true: from then on listed, false: no longer). Of entries of a domain at one moment, a
    listing wins. An as-of join: entries and moments are put in one order within (domain, day), each moment takes the last
    entry before it, and where its day has none, the last one of the days before. A day's rows of a domain are
    its distinct seconds or so, however many captures share them; a domain's days are one row each.
    """
    events = entries.filter("domain is not null and at is not null").groupBy("domain", "at").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    events = events.select("domain", F.col("at").alias("t"), F.struct("listed", F.col("at").alias("since")).alias("entry"))
    asked = moments.select("domain", "t", F.lit(None).cast(dict(events.dtypes)["entry"]).alias("entry"))
    line = events.unionByName(asked).withColumn("day", F.to_date("t"))
    line = written(line, "timeline")
    until = Window.partitionBy("domain", "day").orderBy("t", F.col("entry").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = line.withColumn("own", F.last("entry", ignorenulls=True).over(until)).filter("entry is null")
    before = Window.partitionBy("domain").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = line.groupBy("domain", "day").agg(F.max(F.when(F.col("entry").isNotNull(), F.struct("t", "entry")))["entry"].alias("latest"))
    days = days.withColumn("carried", F.last("latest", ignorenulls=True).over(before)).select("domain", "day", "carried")
    held = inside.join(days, ["domain", "day"]).withColumn("state", F.coalesce("own", "carried"))
    return held.select("domain", "t", "state.listed", "state.since")


def filter_urls(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """captures with host, n_active, active_domain, listed_since and blocked: whether its host or a domain of it was listed when it
    was fetched.

    An entry holds from its moment (included) to the next entry of its domain (not included): its validity interval. Each
    capture is held against the entries of its domains as of its fetching. active_domain is the longest listed domain. Only
    distinct (domain, time) pairs are looked up; rows without url, host or time are not blocked; repeated
    rows get the same verdict each; without entries nothing is blocked; an empty table gives an empty result; very long URLs
    count by their hosts. Columns that clash with the new ones are replaced.
    """
    rows = captures.drop("host", "n_active", "active_domain", "listed_since", "blocked")
    asked = rows.select(F.col(url).alias("u"), F.col(fetched_at).alias("t")).filter("u is not null and t is not null").distinct()
    asked = written(asked.withColumn("domain", F.explode(suffixes(host_of(F.col("u"))))), "asked")
    listed = asked.select("domain").distinct().join(entries.select("domain", "at", "listed"), "domain")  # entries of other domains decide nothing
    active = states(listed, asked.select("domain", "t").distinct()).filter("listed")
    hits = asked.join(active, ["domain", "t"])
    verdict = written(hits.groupBy("u", "t").agg(F.count("*").alias("n_active"), F.max(F.struct(F.length("domain").alias("n"), "domain", "since")).alias("best")), "verdicts")
    verdict = verdict.select("u", "t", "n_active", F.col("best.domain").alias("active_domain"), F.col("best.since").alias("listed_since"))
    held = rows.join(verdict, (F.col(url) == F.col("u")) & (F.col(fetched_at) == F.col("t")), "left").drop("u", "t")
    return held.withColumns({"host": host_of(F.col(url)), "n_active": F.coalesce("n_active", F.lit(0)), "blocked": F.col("n_active").isNotNull()})


def demonstration(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and list entries for the pages table, which has neither times nor lists: both follow from rules.

    A page is fetched (page_id * 7919) mod 17520 hours after the start of 2024. Each domain of three labels in the table is listed, taken
    off and listed again on days that its MD5 gives, if that is divisible by 4; one that names casinos, bets or pills
    is listed from 2023 on.
    """
    start = F.to_timestamp(F.lit("2024-01-01"))
    after = lambda days: F.timestamp_add("DAY", days.cast("int"), start)
    captures = pages.select("page_id", "url", F.timestamp_add("HOUR", (F.col("page_id") * 7919 % 17520).cast("int"), start).alias("fetched_at"))
    domains = captures.select(F.regexp_extract(host_of(F.col("url")), r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("domain")).filter("domain <> ''").distinct()
    x = F.conv(F.substring(F.md5("domain"), 1, 8), 16, 10).cast("long")
    listed, off, again = F.floor(x / 4) % 400, F.floor(x / 1600) % 200 + 1, F.floor(x / 320000) % 200 + 1
    dated = domains.withColumn("x", x).filter("x % 4 = 0").select("domain", F.explode(F.array(F.struct(after(listed).alias("at"), F.lit(True).alias("listed")), F.struct(after(listed + off).alias("at"), F.lit(False).alias("listed")), F.struct(after(listed + off + again).alias("at"), F.lit(True).alias("listed")))).alias("e")).select("domain", "e.*")
    fixed = domains.filter(F.col("domain").rlike("casino|bets|pills") & (F.conv(F.substring(F.md5("domain"), 1, 8), 16, 10).cast("long") % 4 != 0)).select("domain", F.to_timestamp(F.lit("2023-01-01")).alias("at"), F.lit(True).alias("listed"))
    return captures, dated.unionByName(fixed)


def op7_url_filter(spark, sf_dir):
    captures, entries = demonstration(table(spark, sf_dir, "pages").select("page_id", "url"))
    found = filter_urls(captures, written(entries, "entries"))
    return found.select("page_id", "host", F.col("n_active").cast("long").alias("n_active"), F.coalesce("active_domain", F.lit("")).alias("active_domain"), F.coalesce(F.date_format("listed_since", "yyyy-MM-dd"), F.lit("")).alias("listed_since"), "blocked")


OP7_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, TIMESTAMP '2024-01-01' + to_hours((page_id * 7919 % 17520)::BIGINT) AS t,
    coalesce(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1), '.'), '') AS host
  FROM pages
), s AS (
  SELECT r, t, host, array_to_string(string_split(host, '.')[i:], '.') AS domain FROM (SELECT r, t, host, unnest(range(1, len(string_split(host, '.')))) AS i FROM p)
), dom AS (
  SELECT domain, ('0x' || substr(md5(domain), 1, 8))::BIGINT AS x FROM (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS domain FROM p) WHERE domain <> ''
), e AS (
  SELECT domain, (x // 4) % 400 AS a, (x // 1600) % 200 + 1 AS b, (x // 320000) % 200 + 1 AS c FROM dom WHERE x % 4 = 0
), v AS (
  SELECT domain, TIMESTAMP '2024-01-01' + to_days(a::INT) AS f, TIMESTAMP '2024-01-01' + to_days((a + b)::INT) AS u FROM e
  UNION ALL SELECT domain, TIMESTAMP '2024-01-01' + to_days((a + b + c)::INT), TIMESTAMP '9999-01-01' FROM e
  UNION ALL SELECT domain, TIMESTAMP '2023-01-01', TIMESTAMP '9999-01-01' FROM dom WHERE x % 4 <> 0 AND regexp_matches(domain, 'casino|bets|pills')
), h AS (
  SELECT r, count(*) AS n, max((length(v.domain), v.domain, f)) AS best FROM s JOIN v ON s.domain = v.domain AND f <= t AND t < u GROUP BY r
)
SELECT page_id, host, coalesce(n, 0)::BIGINT AS n_active, coalesce(best[2], '') AS active_domain, coalesce(strftime(best[3], '%Y-%m-%d'), '') AS listed_since, n IS NOT NULL AS blocked
FROM p LEFT JOIN h USING (r)
"""
