"""Queries over events: status, progress, queues, as-of, islands, phases."""

from __future__ import annotations

from pyspark.sql import functions as F

from partledger.operators import sequence as S
from partledger.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str, name: str = "events"):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(table(spark, sf_dir, name))
        ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return keep


@query("SELECT event_type AS status, count(*) AS count FROM events GROUP BY 1")
def status_counts(events):
    return events.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("count"))


@query("""
WITH k AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS ready, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed FROM events GROUP BY 1)
SELECT count(*) AS total, sum(ready)::BIGINT AS ready, sum(CASE WHEN ready = 0 THEN failed ELSE 0 END)::BIGINT AS failed, (count(*) - sum(ready) - sum(CASE WHEN ready = 0 THEN failed ELSE 0 END))::BIGINT AS pending,
  CASE WHEN count(*) > 0 THEN round_even(sum(ready) / count(*), 4) ELSE 1.0 END AS ready_ratio FROM k
""")
def object_progress(events):
    """Progress by unique key: a key is ready if any of its rows is; ratio 1 where there are no keys."""
    has = lambda t: F.max(F.when(F.col("event_type") == t, 1).otherwise(0))
    keys = events.groupBy("user_id").agg(has("purchase").alias("ready"), has("error").alias("failed"))
    failed = F.sum(F.when(F.col("ready") == 0, F.col("failed")).otherwise(0))
    totals = keys.agg(F.count("*").alias("total"), F.coalesce(F.sum("ready"), F.lit(0)).alias("ready"), F.coalesce(failed, F.lit(0)).alias("failed"))
    return totals.withColumns({"pending": F.col("total") - F.col("ready") - F.col("failed"), "ready_ratio": F.when(F.col("total") > 0, F.bround(F.col("ready") / F.col("total"), 4)).otherwise(F.lit(1.0))})


@query("""
SELECT kind, event_id, ts FROM (SELECT CASE WHEN event_type LIKE 'p%' THEN 'p' ELSE 'other' END AS kind, event_id, ts FROM events) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_run(events):
    kind = F.when(F.col("event_type").like("p%"), "p").otherwise("other")
    best = events.groupBy(kind.alias("kind")).agg(F.max(F.struct("ts", "event_id")).alias("b"))
    return best.select("kind", "b.event_id", "b.ts")


@query("""
WITH done AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value >= 90), e AS (SELECT user_id, max(CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 ELSE 2 END) AS latest, min(CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 ELSE 2 END) AS priority, min(ts) AS first_ts FROM events GROUP BY 1)
SELECT user_id, priority::INT AS priority, first_ts FROM e ANTI JOIN done USING (user_id)
""")
def backfill_queue(events):
    """Keys that are not done, by priority; the done ones are excluded by an anti-join, which nulls cannot empty."""
    done = events.filter("event_type = 'purchase' and value >= 90").select("user_id").distinct()
    priority = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    keys = events.groupBy("user_id").agg(F.min(priority).alias("priority"), F.min("ts").alias("first_ts"))
    return keys.join(done, "user_id", "left_anti").orderBy("priority", "first_ts", "user_id")


def as_queue(events):
    """A work queue from events: the type gives the state, the value the attempts, the time the lease or when it is due."""
    status = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "processing").otherwise("done")
    return events.select(
        F.col("event_id").alias("item_id"), status.alias("status"), (F.col("event_id") % 4).alias("attempts"),
        F.when(status == "processing", F.col("ts")).alias("started_at"), F.when((status == "queued") & (F.col("event_id") % 3 != 0), F.col("ts")).alias("next_attempt_at"),
    )


_QUEUE = """
WITH q AS (SELECT event_id AS item_id, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing' ELSE 'done' END AS status, event_id % 4 AS attempts, ts,
  CASE WHEN event_type = 'click' AND event_id % 3 <> 0 THEN ts END AS next_attempt_at FROM events)
"""


@query(_QUEUE + """
SELECT item_id, 'processing' AS status, attempts + 1 AS attempts, next_attempt_at FROM q
WHERE attempts < 3 AND (status = 'queued' AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '2024-01-15') OR status = 'processing' AND TIMESTAMP '2024-01-15' - ts > INTERVAL 2 HOUR)
ORDER BY next_attempt_at NULLS FIRST, item_id LIMIT 50
""")
def queue_claim_lease(events):
    """A claim for 50 workers; the number is the feature."""
    return S.claim(as_queue(events), F.lit("2024-01-15").cast("timestamp_ntz"), 7200, 3, 50).select("item_id", "status", "attempts", "next_attempt_at")


@query(_QUEUE + """
SELECT item_id, attempts, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END AS status, CASE WHEN attempts < 3 THEN TIMESTAMP '2024-01-15 00:05:00' END AS next_attempt_at FROM q WHERE status = 'processing'
""")
def queue_retry(events):
    return S.after_failure(as_queue(events), F.lit("2024-01-15").cast("timestamp_ntz"), 3, 300)


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_signup FROM events
QUALIFY event_type = 'click'
""")
def asof_narrative_side(events):
    """The last sign-up before each click of a user."""
    marked = S.asof_backward(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "last_signup")
    return marked.filter("event_type = 'click'").select("event_id", "user_id", "last_signup")


@query("""
WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM s)
SELECT user_id, island, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS samples, round(sum(value), 2) AS total FROM i GROUP BY 1, 2
""")
def gaps_islands_merge(events):
    rows = S.islands(events, ["user_id"], "ts", 7200, ["event_id"])
    return rows.groupBy("user_id", "island").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("samples"), F.round(F.sum("value"), 2).alias("total"))


@query("""
SELECT event_id, bool_or(event_type = 'signup') OVER w AS started, bool_or(event_type = 'purchase') OVER w AS summary FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def phase_state_flags(events):
    flags = {"started": F.col("event_type") == "signup", "summary": F.col("event_type") == "purchase"}
    return S.phase_flags(events, ["user_id"], ["ts", "event_id"], flags).select("event_id", *flags)


@query("""
WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT event_id, sum(length(event_type)) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)::BIGINT AS around FROM i
""")
def neighbourhood_gap(events):
    rows = S.islands(events, ["user_id"], "ts", 86400, ["event_id"])
    return S.neighbourhood(rows, ["user_id", "island"], ["ts", "event_id"], 2, F.length("event_type"), "around").select("event_id", "around")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, md5(props) AS digest FROM events")
def json_payload_fields(events):
    return events.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.md5("props").alias("digest"))


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2
""")
def tumbling_days(events):
    """Extension: tumbling windows over the events."""
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query("""
SELECT s AS start_ts, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1, 2
""")
def sliding_windows(events):
    """Extension: windows of 12 hours every 6 hours."""
    return events.groupBy(F.window("ts", "12 hours", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_ts"), "event_type", "n")


@query("""
WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 2 HOUR AS end_ts, count(*) AS n FROM i GROUP BY user_id, island
""")
def session_windows(events):
    """Extension: sessions that end after two hours without events."""
    return events.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS heading FROM conversations
""", "conversations")
def heading_carry_forward(conversations):
    marked = S.carried_forward(conversations, ["conv_id"], ["turn", "role", "text"], F.col("role") == "user", F.col("text"), "heading")
    return marked.select("conv_id", "turn", "heading")


@query("""
WITH d AS (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY 1, 2), t AS (SELECT conv_id, turn AS place, text AS v FROM d WHERE role = 'system'),
n AS (SELECT d.conv_id, d.turn, v, abs(place - d.turn) AS dist, row_number() OVER (PARTITION BY d.conv_id, d.turn ORDER BY abs(place - d.turn), place) AS k FROM d JOIN t ON d.conv_id = t.conv_id AND abs(place - d.turn) <= 4)
SELECT d.conv_id, d.turn, v AS near, dist AS near_distance FROM d LEFT JOIN n ON d.conv_id = n.conv_id AND d.turn = n.turn AND k = 1
""", "conversations")
def nearest_within_k(conversations):
    """The nearest system turn within four turns."""
    turns = conversations.groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    return S.nearest_within(turns, ["conv_id"], "turn", F.col("role") == "system", "text", 4, "near").select("conv_id", "turn", "near", "near_distance")
