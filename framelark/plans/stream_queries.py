"""Streaming queries over the events table, run over all of it, and the batch SQL that they must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelark.streaming.live import chunk_queue, drain, latest, reports, stream_table
from framelark.streaming.timers import drain_timed, episode_queue, first_frames

STEPS = 8


def _events(spark, d, files_per_batch=None):
    return stream_table(spark, f"{d}/events.parquet", files_per_batch)


def q_latest(spark, d, files_per_batch=None):
    """The newest event of every user."""
    s = latest(_events(spark, d, files_per_batch), "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])
    return drain(s, "update", ["user_id"])


def q_reports(spark, d, files_per_batch=None):
    """Six-hour reports by event type."""
    rows = drain(reports(_events(spark, d, files_per_batch), "ts", "event_type", "value", "6 hours", "1 day"), "update", ["start", "event_type"])
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round(F.col("total") / F.col("n"), 6).alias("avg"))


def q_queue(spark, d, files_per_batch=None):
    """The held action at every event of a user, with a new plan at every eighth."""
    return drain(chunk_queue(_events(spark, d, files_per_batch), "user_id", ["ts", "event_id"], "value", STEPS), "append")


def q_episode_queue(spark, d, files_per_batch=None):
    """The held action at every event of a user, planned at every fifth of a day; each day is an episode of its own."""
    e = _events(spark, d, files_per_batch).withColumn("day", F.unix_date(F.to_date("ts")))
    return drain_timed(episode_queue(e, "user_id", ["ts", "event_id"], "day", "value", 5))


WAIT_HOURS = 24


def q_first_frames(spark, d, files_per_batch=None):
    """How long after its first event each user's first purchase came, or that none came within a day."""
    e = _events(spark, d, files_per_batch).withColumn("bought", F.col("event_type") == "purchase")
    rows = drain_timed(first_frames(e, "user_id", "ts", "bought", WAIT_HOURS * 3_600_000, "1 hour"))
    return rows.select("user_id", F.date_format("began", "yyyy-MM-dd HH:mm:ss").alias("began"), "found", F.coalesce("waited_ms", F.lit(-1).cast("long")).alias("waited_ms"))


QUERIES = {"episode_queue": q_episode_queue, "first_frame_wait": q_first_frames, "stream_latest": q_latest, "stream_reports": q_reports, "chunk_queue": q_queue}

ORACLE = {
    "episode_queue": """WITH e AS (SELECT user_id, event_id, value, ts, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS episode FROM events),
  t AS (SELECT *, row_number() OVER (PARTITION BY user_id, episode ORDER BY ts, event_id) - 1 AS tick FROM e)
  SELECT user_id, event_id, episode, tick, tick % 5 = 0 AS replan, first_value(value) OVER (PARTITION BY user_id, episode, tick // 5 ORDER BY tick) AS held FROM t""",
    "first_frame_wait": f"""WITH b AS (SELECT user_id, min(ts) AS began, max(ts) AS last FROM events GROUP BY user_id), w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events),
  p AS (SELECT b.user_id, began, last, min(e.ts) AS bought FROM b LEFT JOIN events e ON e.user_id = b.user_id AND e.event_type = 'purchase' AND e.ts <= began + INTERVAL {WAIT_HOURS} HOUR GROUP BY ALL)
  SELECT user_id, strftime(began, '%Y-%m-%d %H:%M:%S') AS began, bought IS NOT NULL AS found, coalesce(date_diff('microsecond', began, bought) // 1000, -1) AS waited_ms
  FROM p, w WHERE bought IS NOT NULL OR last > began + INTERVAL {WAIT_HOURS} HOUR OR mark > began + INTERVAL {WAIT_HOURS} HOUR""",
    "stream_latest": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "stream_reports": """SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value) / count(*), 6) AS avg
  FROM events GROUP BY 1, 2""",
    "chunk_queue": f"""WITH e AS (SELECT user_id, event_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick FROM events)
  SELECT user_id, event_id, tick, tick % {STEPS} = 0 AS replan, first_value(value) OVER (PARTITION BY user_id, tick // {STEPS} ORDER BY tick) AS held FROM e""",
}
