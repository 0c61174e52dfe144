"""Queries that stream, and queries that write and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partledger.sources import readers, writers
from partledger.sources.shared import shared_path
from partledger.sources.tables import table
from partledger.streaming import events as S
from partledger.streaming import timed


def stream_window(spark, sf_dir):
    stream = S.event_stream(spark, f"{sf_dir}/events.parquet")
    return S.run_available(S.tumbling(stream, "ts", "1 day", "1 hour", "event_type"), "stream-window")


def stream_session(spark, sf_dir):
    stream = S.event_stream(spark, f"{sf_dir}/events.parquet")
    return S.run_available(S.sessions(stream, "ts", "2 hours", "1 hour", "user_id"), "stream-session")


def stream_dedup(spark, sf_dir):
    stream = S.event_stream(spark, f"{sf_dir}/events.parquet")
    return S.run_available(S.first_occurrences(stream, ["user_id", "event_type"]), "stream-dedup")


#: Slices of time that the events are written in, hours by which they are out of order, and the key of the row that ends the stream.
SLICES, JITTER_HOURS, LAST = 4, 1, -1


def out_of_order(spark, events):
    """A stream of (user_id, ts, event_type) over many files that overlap in time, and how late a row can be.

    A slice has the rows whose time and up to an hour more, by their id, fall in it, in two files; the files' order within a slice
    is left open. A row of another user, ten slices later, lets the watermark pass all others.
    """
    path = shared_path(spark, "out-of-order")
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    moved = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(JITTER_HOURS * 3_600_000_000))
    bounds = [x or 0 for x in rows.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()]
    width = (bounds[1] - bounds[0]) // SLICES + 1
    slice_of = F.least(F.floor((moved - bounds[0]) / width), F.lit(SLICES - 1))
    for k in range(SLICES):
        rows.filter(slice_of == k).drop("event_id").repartition(2).write.mode("append").parquet(path)
    spark.range(1).select(F.lit(LAST).cast("long").alias("user_id"), F.timestamp_micros(F.lit(bounds[1] + 10 * width + 36_000_000_000)).alias("ts"), F.lit("view").alias("event_type")).write.mode("append").parquet(path)
    return S.event_stream(spark, path, 3), f"{width // 1_000_000 + JITTER_HOURS * 3600 + 1} seconds"


def stream_phases(spark, sf_dir):
    """Phases over files that overlap in time: the same as in order of time."""
    stream, late = out_of_order(spark, table(spark, sf_dir, "events"))
    return S.run_available(timed.phases(stream, "user_id", "ts", "event_type", "signup", "purchase", late), "stream-phases", timers=True)


def stream_retry_ladder(spark, sf_dir):
    """Work items (users) whose errors are retried after 300, 900 and 1800 seconds; views claim them, purchases finish them. Time runs
    twenty times as fast, so that deadlines and events come between each other."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.timestamp_micros(F.expr("unix_micros(cast(ts as timestamp)) div 20")))
    stream, late = out_of_order(spark, events)
    return S.run_available(timed.retries(stream, "user_id", "ts", "event_type", "error", "purchase", "view", late), "stream-retries", timers=True)


def sink_by_key(spark, sf_dir):
    path = shared_path(spark, "by-key")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    writers.write_by_key(parts, path, "p_brand")
    writers.write_by_key(parts.filter("p_brand = 'Brand#11' and p_size > 10"), path, "p_brand")
    return spark.read.parquet(path).select("p_partkey", F.col("p_brand").cast("string").alias("p_brand"), "p_size")


def sink_csv(spark, sf_dir):
    path = shared_path(spark, "csv")
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"), F.count("*").alias("n"))
    writers.write_evidence_csv(orders, path, ["priorities"])
    return spark.read.option("header", True).schema("o_custkey long, priorities string, n long").csv(path)


def sink_json(spark, sf_dir):
    path = shared_path(spark, "json")
    writers.write_stamped_json(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), path, {"data_version": "1", "contract": "a"})
    return spark.read.schema("s_suppkey long, s_name string, data_version string, contract string").json(path)


def sink_publish(spark, sf_dir):
    path = shared_path(spark, "published")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    writers.publish(nations, path)
    writers.publish(nations.filter("n_nationkey < 10"), path)
    writers.append_records(nations.filter("n_nationkey between 5 and 15"), path, "n_nationkey")
    return spark.read.parquet(path)


def source_records(spark, sf_dir):
    """Records in JSON, one a file, some of which don't parse: what is good is read, what isn't is counted."""
    path = shared_path(spark, "records")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("json"))
    broken = F.when(F.col("n_nationkey") % 9 == 0, F.substring("json", 1, 8)).otherwise(F.col("json"))
    nations.select(broken).coalesce(1).write.option("maxRecordsPerFile", 1).text(path)
    good, rejected = readers.read_records(spark, path, T.StructType.fromDDL("n_nationkey int, n_name string"))
    return good.select("n_nationkey", "n_name").unionByName(rejected.agg(F.count("*").cast("int").alias("n_nationkey"), F.lit("rejected").alias("n_name")))


def source_prices(spark, sf_dir):
    """A price list with amounts as people write them."""
    path = shared_path(spark, "prices")
    part = table(spark, sf_dir, "part")
    amount = F.when(F.col("p_size") % 5 == 0, "on request").otherwise(F.concat(F.lit("CNY "), F.format_number("p_retailprice", 2)))
    rows = part.select(F.col("p_partkey").cast("string").alias("product_id"), amount.alias("amount"), F.lit("CNY").alias("currency"), F.col("p_brand").alias("source"))
    rows.write.option("header", True).csv(path)
    return readers.read_prices(spark, path).select("product_id", F.col("amount").cast("double").alias("amount"), "currency", "source")


def source_feed(spark, sf_dir):
    """Feed pages of the orders of a customer, from a year on; an item that two pages have is read once."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss").alias("at"))
    key = F.col("o_orderkey").cast("string")
    item = F.concat(F.lit("<item><title><![CDATA[Order "), key, F.lit("]]></title><link>https://shop.test/"), key, F.lit("</link><pubDate>"), "at", F.lit(" +0000</pubDate></item>"))
    feeds = orders.select("o_custkey", item.alias("item")).groupBy("o_custkey").agg(F.concat(F.lit("<rss>"), F.array_join(F.collect_list("item"), ""), F.lit("</rss>")).alias("content"))
    twice = feeds.unionByName(feeds.filter("o_custkey % 3 = 0"))
    return readers.feed_items(twice, "content", 1995).select("link", "title", F.col("published").cast("timestamp_ntz").alias("published"))


def source_feed_pages(spark, sf_dir):
    """Scans of the feeds of customers, three orders a page, the latest first, down to the middle of 1997; some feeds have a page that can't be
    read."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), "o_orderstatus")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("at"), "o_orderkey")) - 1
    key = F.col("o_orderkey").cast("string")
    item = F.concat(F.lit("<item><title><![CDATA[Order "), key, F.lit("]]></title><link> https://shop.test/"), key, F.lit("\n</link><dc:creator>c"), "o_orderstatus", F.lit("</dc:creator><pubDate>"), F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate><category><![CDATA[one]]></category><category> </category><category>two</category><description><![CDATA[<p>a&nbsp;b&#8230;</p>]]></description><content:encoded><![CDATA[<p>"), key, F.lit("</p>]]></content:encoded></item>"))
    rows = orders.withColumn("p", place).select("o_custkey", F.floor(F.col("p") / 3 + 1).cast("int").alias("page"), F.struct("p", item.alias("item")).alias("i"))
    whole = F.concat(F.lit("<rss><channel><item><title>no link</title></item>"), F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["item"]), "\n"), F.lit("</channel></rss>"))
    feeds = rows.groupBy("o_custkey", "page").agg(whole.alias("content")).withColumn("content", F.when((F.col("o_custkey") % 5 == 0) & (F.col("page") == 3), "gone").otherwise(F.col("content")))
    found = readers.feed_scan(feeds, "o_custkey", "page", "content", stop_before="1997-07-01", max_pages=4)
    return found.select(F.col("feed").alias("o_custkey"), "page", "link", "title", "author", F.col("published").cast("timestamp_ntz").alias("published"), "description", "content_html", F.array_join("categories", ",").alias("categories"))


def source_captions(spark, sf_dir):
    """Caption files of conversations, a cue for each turn, with tags and broken lines."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    plain = F.regexp_replace(F.regexp_replace("text", r"[<>]|-->", " "), r"\s+", " ")
    stamp = lambda t: F.format_string("%02d:%02d:%02d.500", F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60)
    cue = F.concat(stamp(F.col("turn") * 7), F.lit(" --> "), stamp(F.col("turn") * 7 + 5), F.lit("\n<b>"), F.trim(plain), F.lit("</b>\n\n"))
    files = turns.select("conv_id", F.struct("turn", cue.alias("cue")).alias("c")).groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["cue"]), "")).alias("content"))
    return readers.caption_cues(files, "conv_id", "content").select("conv_id", "start", "end", F.md5("text").alias("digest"))


QUERIES = {f.__name__: f for f in (stream_window, stream_session, stream_dedup, stream_phases, stream_retry_ladder, sink_by_key, sink_csv, sink_json, sink_publish, source_records, source_prices, source_feed, source_feed_pages, source_captions)}

ORACLE_SQL = {
    "stream_window": """
WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start_ts, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT start_ts, start_ts + INTERVAL 1 DAY AS end_ts, event_type, n FROM w WHERE start_ts + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""",
    "stream_session": """
WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM s),
g AS (SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 2 HOUR AS end_ts, count(*) AS n FROM i GROUP BY user_id, island)
SELECT * FROM g WHERE end_ts <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_phases": """
SELECT user_id, ts, event_type, CASE WHEN bool_or(event_type = 'purchase') OVER w THEN 'after' WHEN bool_or(event_type = 'signup') OVER w THEN 'within' ELSE 'before' END AS phase
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type ROWS UNBOUNDED PRECEDING)
""",
    "stream_retry_ladder": """
WITH e AS (SELECT user_id, epoch_us(ts) // 20 AS t, event_type FROM events WHERE event_type IN ('error', 'purchase', 'view')),
i AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER w - (event_type = 'purchase')::INT AS island, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_type) AS following FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_type ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, (count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, island ORDER BY t, event_type ROWS UNBOUNDED PRECEDING))::INT AS attempts FROM i),
d AS (SELECT *, t + CASE attempts WHEN 1 THEN 300 WHEN 2 THEN 900 ELSE 1800 END * 1000000 AS due FROM a)
SELECT user_id, make_timestamp(t) AS ts, attempts, 'waiting' AS action, make_timestamp(due) AS due FROM d WHERE event_type = 'error' AND attempts <= 3
UNION ALL SELECT user_id, make_timestamp(due), attempts, 'retry', NULL FROM d WHERE event_type = 'error' AND attempts <= 3 AND (following IS NULL OR due < following)
UNION ALL SELECT user_id, make_timestamp(t), attempts, 'gave_up', NULL FROM d WHERE event_type = 'error' AND attempts = 4
UNION ALL SELECT user_id, make_timestamp(t), attempts, 'done', NULL FROM d WHERE event_type = 'purchase' AND attempts > 0
UNION ALL SELECT user_id, make_timestamp(t + 7200000000), attempts, 'lease_expired', NULL FROM d WHERE event_type = 'view' AND (following IS NULL OR t + 7200000000 < following)
""",
    "sink_by_key": "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand <> 'Brand#11' OR p_size > 10",
    "sink_csv": "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS priorities, count(*) AS n FROM orders GROUP BY 1",
    "sink_json": "SELECT s_suppkey, s_name, '1' AS data_version, 'a' AS contract FROM supplier",
    "sink_publish": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <= 15",
    "source_records": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 9 <> 0 UNION ALL SELECT count(*)::INT, 'rejected' FROM nation WHERE n_nationkey % 9 = 0",
    "source_prices": "SELECT p_partkey::VARCHAR AS product_id, CASE WHEN p_size % 5 <> 0 THEN round(p_retailprice, 2) END AS amount, 'CNY' AS currency, p_brand AS source FROM part",
    "source_feed": "SELECT DISTINCT 'https://shop.test/' || o_orderkey AS link, 'Order ' || o_orderkey AS title, date_trunc('second', o_orderdate) AS published FROM orders WHERE year(o_orderdate) >= 1995",
    "source_feed_pages": """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, date_trunc('second', o_orderdate) AS at0, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS p FROM orders),
g AS (SELECT *, p // 3 + 1 AS page FROM o), e AS (SELECT o_custkey, min(page) AS last FROM g WHERE at0 < TIMESTAMP '1997-07-01' GROUP BY 1)
SELECT g.o_custkey, page::INT AS page, 'https://shop.test/' || o_orderkey AS link, 'Order ' || o_orderkey AS title, 'c' || o_orderstatus AS author, at0 AS published, 'a b…' AS description, '<p>' || o_orderkey || '</p>' AS content_html, 'one,two' AS categories
FROM g LEFT JOIN e ON g.o_custkey = e.o_custkey WHERE page <= least(coalesce(last, 4), 4, CASE WHEN g.o_custkey % 5 = 0 THEN 2 ELSE 4 END) AND at0 >= TIMESTAMP '1997-07-01'
""",
    "source_captions": r"""
WITH t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(min(text), '[<>]|-->', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM conversations GROUP BY 1, 2)
SELECT conv_id, turn * 7 + 0.5::DOUBLE AS start, turn * 7 + 5.5::DOUBLE AS "end", md5(text) AS digest FROM t WHERE text <> ''
""",
}
