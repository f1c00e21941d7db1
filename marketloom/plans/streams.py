"""Streaming queries, drained over what is there and compared with the batch's answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as S
from .registry import query


@query("stream_hourly_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly(spark, sf_dir):
    t = S.drained(S.hourly(S.read_events(spark, sf_dir)), "complete")
    newest = t.agg(F.max("batch").alias("b"))
    return t.join(F.broadcast(newest), F.col("batch") == F.col("b")).select("hour", "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding_counts", """WITH w AS (SELECT unnest([date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts)]) AS start FROM events) SELECT start, start + INTERVAL 2 DAY AS "end", count(*) AS n FROM w GROUP BY start""")
def sliding(spark, sf_dir):
    t = S.drained(S.sliding(S.read_events(spark, sf_dir)), "complete")
    return t.join(F.broadcast(t.agg(F.max("batch").alias("b"))), F.col("batch") == F.col("b")).select("start", "end", "n")


@query("stream_health", """WITH a AS (SELECT user_id % 30 AS source, ts, event_id, event_type NOT IN ('error', 'click') AS ok FROM events),
i AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY source ORDER BY ts, event_id) AS island FROM a),
f AS (SELECT *, sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY source, island ORDER BY ts, event_id) AS failures FROM i)
SELECT source, CAST(arg_max(failures, (ts, event_id)) AS BIGINT) AS consecutive_failures, count(*) AS total_cycles FROM f GROUP BY source""")
def health(spark, sf_dir):
    t = S.drained(S.health(S.read_events(spark, sf_dir)), "update")
    return S.latest_updates(t, "source").select("source", "consecutive_failures", "total_cycles")


@query("stream_closed_hours", """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def closed_hours(spark, sf_dir):
    """Append mode: an hour is written once, when no event of it can still be taken, and its state goes."""
    return S.drained(S.hourly(S.read_events(spark, sf_dir)), "append").select("hour", "event_type", "n")


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 30 MINUTE, TRUE) AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(CAST(first AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM i GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def sessions(spark, sf_dir):
    return S.drained(S.sessions(S.read_events(spark, sf_dir)), "append").select("user_id", "start", "end", "n")


@query("stream_fan_in", "SELECT event_type AS source, event_id, value FROM events WHERE event_type IN ('click', 'purchase')")
def fan_in(spark, sf_dir):
    """Two sources, each a stream of its own."""
    own = [S.read_events(spark, sf_dir).filter(F.col("event_type") == t).select(F.lit(t).alias("source"), "event_id", "value") for t in ("click", "purchase")]
    return S.drained(S.fan_in(own), "append").select("source", "event_id", "value")
