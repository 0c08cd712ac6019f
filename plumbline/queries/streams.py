"""Streaming queries over `events`, run to the end; their SQL is that of the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import windows as W
from .ordered import _KEPT


def tumbling_windows(spark, d):
    rows = W.stream_of(spark, f"{d}/events.parquet")
    out = W.run_once(W.event_windows(rows, "ts", "6 hours", None, "1 day", ("event_type",), "value"), "update", ["window", "event_type"])
    return out.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding_windows(spark, d):
    rows = W.stream_of(spark, f"{d}/events.parquet")
    out = W.run_once(W.event_windows(rows, "ts", "1 day", "12 hours", "1 day", (), "value"), "update", ["window"])
    return out.select(F.unix_seconds("window.start").alias("start"), "n", F.round("total", 4).alias("total"))


def stream_keyframes(spark, d):
    rows = W.stream_of(spark, f"{d}/events.parquet").select("user_id", "ts", "event_id", (F.col("value") / 10).alias("x"), (F.hour("ts") / F.lit(24.0)).alias("z"))
    return W.run_once(W.streaming_keyframes(rows.withColumn("turn", F.col("z") * 6.0), "user_id", "ts", "event_id", ("x", "z"), "turn", 6.0, 60.0))


def session_windows(spark, d):
    """Sessions of each user: events less than six hours apart."""
    rows = W.stream_of(spark, f"{d}/events.parquet")
    out = W.run_once(W.sessions(rows, "ts", "6 hours", "1 day", ("user_id",)), "complete")
    return out.select("user_id", F.unix_seconds("session_window.start").alias("start"), "n")


def stream_chunks(spark, d):
    """Chunks of each user's path and the last trusted position at each event that the watermark has passed."""
    rows = W.stream_of(spark, f"{d}/events.parquet").select("user_id", "event_id", "ts", (F.col("value") / 10).alias("x"), (F.col("event_id") % 40).cast("double").alias("z"), (F.col("event_type") != "view").alias("ok"))
    with W.rocksdb_state(spark):
        out = W.run_once(W.streaming_chunks(rows, "user_id", "ts", "event_id", ("x", "z"), "ok", 20.0, late="1 day", idle="3650 days"))
    return out.select("user_id", "event_id", "chunk", F.round("length", 6).alias("length"), F.round("lx", 6).alias("lx"), "lz")


QUERIES = {f.__name__: f for f in (tumbling_windows, sliding_windows, stream_keyframes, session_windows, stream_chunks)}
ORACLE_SQL = {
    "tumbling_windows": "SELECT CAST(floor(epoch(ts)) AS BIGINT) // 21600 * 21600 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sliding_windows": """WITH e AS (SELECT unnest([(CAST(floor(epoch(ts)) AS BIGINT) // 43200) * 43200, (CAST(floor(epoch(ts)) AS BIGINT) // 43200) * 43200 - 43200]) AS start, value FROM events)
        SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY 1""",

    "stream_keyframes": f"WITH RECURSIVE {_KEPT} SELECT user_id, event_id FROM r WHERE new",
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
        SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "stream_chunks": """WITH e AS (SELECT user_id, event_id, ts, value / 10 AS x, CAST(event_id % 40 AS DOUBLE) AS z, event_type <> 'view' AS ok FROM events),
        s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)), 0) AS step FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (
            SELECT user_id, event_id, ts, sum(step) OVER w AS length, last_value(CASE WHEN ok THEN x END IGNORE NULLS) OVER w AS lx, last_value(CASE WHEN ok THEN z END IGNORE NULLS) OVER w AS lz
            FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT user_id, event_id, CAST(floor(length / 20) AS BIGINT) AS chunk, round(length, 6) AS length, round(lx, 6) AS lx, lz FROM r
        WHERE date_trunc('milliseconds', ts) <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)""",
}
