"""Queries that run a stream over the event files to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.core import R
from tidemark.plans.registry import query
from tidemark.streaming import jobs

_P = "WITH p AS (SELECT user_id AS director, 'Brand#'||(user_id%25+1) AS ticker, ts, value FROM events WHERE event_type='purchase') "


def _events(t):
    return jobs.file_stream(t.spark, f"{t.sf_dir}/events.parquet")


@query("str01_incremental_ingest", "SELECT user_id, event_type, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day, count(DISTINCT event_id) AS seen_count FROM events GROUP BY 1, 2")
def str01(t):
    """Events are counted once each, however often they come, and merged into the table of keys."""
    work = jobs.work_path(t.spark, "ingest")
    return _seen(jobs.ingest_and_upsert(_events(t), ["event_id"], ["user_id", "event_type"], "ts", f"{work}/table", f"{work}/checkpoint"))


def _seen(out):
    return out.select("user_id", "event_type", F.to_date("first_seen").alias("first_day"), F.to_date("last_seen").alias("last_day"), "seen_count")


@query("str01_restarted_ingest", "SELECT user_id, event_type, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day, count(DISTINCT event_id) AS seen_count FROM events GROUP BY 1, 2")
def str01_restarted(t):
    """Events come in three files, the second with copies of some of the first; each run goes on where the last one stopped."""
    work = jobs.work_path(t.spark, "restarted")
    events = t.read("events")
    day = F.to_date("ts")
    for n, inside in enumerate((day < F.lit("2024-01-12").cast("date"), day.between("2024-01-10", "2024-01-20"), day > F.lit("2024-01-20").cast("date"))):
        events.where(inside).write.mode("append").parquet(f"{work}/in")
        out = jobs.ingest_and_upsert(jobs.file_stream(t.spark, f"{work}/in"), ["event_id"], ["user_id", "event_type"], "ts", f"{work}/table", f"{work}/checkpoint")
    return _seen(out)


@query("str02_monthly_activity", "SELECT CAST(date_trunc('month', ts) AS DATE) AS month, CASE event_type WHEN 'purchase' THEN 'BUY' ELSE 'SELL' END AS type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1, 2")
def str02(t):
    """Monthly buys and sells from the days of the stream; clicks stand in for sells."""
    days = jobs.run_available(jobs.daily_activity(_events(t), sell="click"), "update", ["start", "type"], "daily")
    return jobs.by_month(days).select("month", "type", "n", R("total", 4).alias("total"))


@query("str03_first_purchases", _P + "SELECT director, ticker, CAST(min(ts) AS DATE) AS first_day FROM p GROUP BY 1, 2")
def str03(t):
    out = jobs.run_available(jobs.first_purchases(_events(t)), "update", ["director", "ticker"], "first")
    return out.select("director", "ticker", F.to_date("first_ts").alias("first_day"))


@query("str03_first_time_events", _P + "SELECT director, ticker, CAST(min(ts) AS DATE) AS first_day FROM p GROUP BY 1, 2")
def str03_events(t):
    """One event for each director and ticker, when its first purchase arrives."""
    out = jobs.run_available(jobs.first_time_events(_events(t)), "append", ["director", "ticker"], "first-events")
    return out.select("director", "ticker", F.to_date("first_ts").alias("first_day"))


@query("str04_buyer_sessions", _P + """, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY ticker ORDER BY ts) + INTERVAL 30 DAY THEN 0 ELSE 1 END AS new FROM p),
s AS (SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT ticker, CAST(min(ts) AS DATE) AS day, count(*) AS n, list_sort(list(DISTINCT director)) AS directors FROM s GROUP BY ticker, k""")
def str04(t):
    out = jobs.run_available(jobs.buyer_sessions(_events(t)), "complete", ["start", "ticker"], "sessions")
    return out.select("ticker", F.to_date("start").alias("day"), "n", "directors")


@query("str05_sliding_buyers", _P + "SELECT CAST(CAST(ts AS DATE) - CAST(i AS INT) AS DATE) AS day, ticker, CAST(count(DISTINCT director) AS INT) AS n_buyers FROM p CROSS JOIN range(30) v(i) GROUP BY 1, 2")
def str05(t):
    """The stream keeps each director's buying days; starts and ends of their reach are counted over them."""
    days = jobs.run_available(jobs.buying_days(_events(t)), "update", ["day", "ticker", "director"], "sliding")
    return jobs.sliding_counts(days).select(F.col("start").alias("day"), "ticker", "n_buyers")
