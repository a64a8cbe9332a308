"""Streaming queries, run to the end of what is there; the events' own tables are the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import incremental as I  # noqa: E741
from ..streaming import live as L
from .repair_queries import replay_sql


def _events(spark, sf_dir):
    rows = I.stream(spark, f"{sf_dir}/events.parquet")
    return rows.withColumns({"ts": F.col("ts").cast("timestamp"), "cents": F.floor(F.col("value") * 100).cast("long")})


def stream_tumbling(spark, sf_dir):
    """Hourly counts and sums: windows are updated in a table as rows come, and leave the state two hours after their end."""
    windows = I.tumbling(_events(spark, sf_dir))
    table = I.upsert(windows, ["start", "event_type"], F.max_by, F.col("n"), I.place(spark, "windows"), "update")
    return table.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "cents")


def stream_latest_per_user(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "cents")
    return I.upsert_latest(rows, ["user_id"], "event_id", I.place(spark, "latest"))


def stream_first_seen(spark, sf_dir):
    """The first event of each user and kind."""
    rows = _events(spark, sf_dir).select("user_id", "event_type", "event_id")
    return I.first_seen(rows, ["user_id", "event_type"], "event_id", I.place(spark, "first-seen"))


def stream_early_stops(spark, sf_dir):
    """Each user's events as iterations of a repair."""
    score, interaction = F.floor(F.col("value") * 7).cast("long") % 101, F.floor(F.col("value") * 3).cast("long") % 26
    rows = _events(spark, sf_dir).select("user_id", "event_id", "ts", score.alias("score"), interaction.alias("interaction"), (F.col("event_type") == "error").alias("keyboard_broken"))
    return I.upsert(I.early_stops(rows), ["user_id"], F.max_by, F.col("iterations"), I.place(spark, "stops"), "update")


def _outcomes(spark, sf_dir):
    """Events as results of their users: the kind tells the status."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "signup", "completed_with_fallback").otherwise("processing")
    rate = F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 11) / 10)
    return _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("item_id"), "event_id", status.alias("eval_status"), (F.col("cents") % 101).alias("total"), rate.alias("test_pass_rate"))


def stream_live_state(spark, sf_dir):
    """The state of a watched run over customers as items, after its last micro-batch."""
    at = I.place(spark, "live")
    now = L.watched(_outcomes(spark, sf_dir), "item_id", "event_id", at)
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("item_id"), (F.col("c_acctbal") > 0).alias("generated"))
    return L.live_state(now, items)


def stream_progress(spark, sf_dir):
    """What the micro-batches of a watched run reported, together."""
    at, rows = I.place(spark, "progress"), _outcomes(spark, sf_dir)
    L.watched(rows, "item_id", "event_id", at)
    return L.progress(rows, at).agg(*(F.sum(c).alias(c) for c in ("rows", "completed", "failed", "points")))


def stream_retries(spark, sf_dir):
    """Tries of users until one completes, three at most; states between are no tries."""
    rows = _outcomes(spark, sf_dir).where("eval_status <> 'processing'").withColumnRenamed("item_id", "uid")
    return L.retries(rows.select("uid", "eval_status", "event_id"), "event_id", I.place(spark, "retries"))


def batch_sessions(spark, sf_dir):
    """Sessions of users with gaps of 30 minutes, in batch."""
    found = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.date_format(F.col("session_window.start"), "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def batch_sliding(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.date_format(F.col("window.start"), "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


#: The replay of recorded traces, by user instead of by user and block of events.
STOPS_SQL = replay_sql("CAST(user_id AS VARCHAR)").replace("SELECT record_id, coalesce(", "SELECT CAST(record_id AS BIGINT) AS user_id, (SELECT count(*) FROM t WHERE t.record_id = f.record_id) AS iterations, coalesce(").replace("AS stop_reason", "AS reason").replace("AS best_score", "AS best")

OUTCOMES = """WITH o AS (SELECT CAST(user_id AS VARCHAR) AS item_id, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'completed_with_fallback' ELSE 'processing' END AS eval_status,
  CAST(floor(value * 100) AS BIGINT) % 101 AS total, CASE WHEN event_id % 3 > 0 THEN (event_id % 11) / 10.0::DOUBLE END AS rate FROM events)"""
ORACLES = {
    "stream_live_state": f"""{OUTCOMES}, l AS (SELECT item_id, arg_max(eval_status, event_id) AS s, max(event_id) AS e FROM o GROUP BY 1),
      j AS (SELECT c_acctbal > 0 AS g, s, total, rate, s LIKE 'completed%' AS done FROM customer LEFT JOIN l ON CAST(c_custkey AS VARCHAR) = l.item_id LEFT JOIN o ON o.event_id = l.e AND o.item_id = l.item_id)
      SELECT count(*) AS total_items, count(*) FILTER (g) AS generated, count(*) FILTER (done OR s = 'failed') AS evaluated, count(*) FILTER (done) AS completed, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (NOT g) AS pending_generation,
        count(*) FILTER (g AND NOT coalesce(done OR s = 'failed', false)) AS pending_evaluation, round_even(avg(total) FILTER (done), 2) AS avg_score_completed, round_even(avg(rate) FILTER (done), 4) AS avg_test_pass_rate_completed FROM j""",
    "stream_progress": f"{OUTCOMES} SELECT count(*) AS rows, count(*) FILTER (eval_status LIKE 'completed%') AS completed, count(*) FILTER (eval_status = 'failed') AS failed, CAST(coalesce(sum(total) FILTER (eval_status LIKE 'completed%'), 0) AS BIGINT) AS points FROM o",
    "stream_retries": f"""{OUTCOMES}, t AS (SELECT item_id AS uid, eval_status LIKE 'completed%' AS ok, row_number() OVER w AS attempt, coalesce(max(CAST(eval_status LIKE 'completed%' AS INT)) OVER (PARTITION BY item_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM o WHERE eval_status <> 'processing' WINDOW w AS (PARTITION BY item_id ORDER BY event_id))
      SELECT uid, CAST(attempt AS INT) AS attempt, CASE WHEN ok THEN 'done' WHEN attempt = 3 THEN 'gave up' ELSE 'retry' END AS action FROM t WHERE before = 0 AND attempt <= 3""",
    "stream_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2",
    "stream_latest_per_user": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, CAST(floor(arg_max(value, event_id) * 100) AS BIGINT) AS cents FROM events GROUP BY user_id",
    "stream_first_seen": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2",
    "stream_early_stops": STOPS_SQL,
    "batch_sessions": "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session",
    "batch_sliding": "SELECT strftime(date_trunc('hour', ts) - to_hours(h), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(h) GROUP BY 1, 2",
}
QUERIES = {name: globals()[name] for name in ORACLES}
