"""Batch twins of the streaming jobs (STR01-STR03).  The streams themselves run in
tests/test_streaming.py against the same functions and are compared to these."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.requests import request_hash
from ..streaming import jobs as J
from .registry import query, sql

FX_TELEMETRY = """SELECT user_id AS run_id, ts, value / 100 AS rss_gb,
       CAST(CASE WHEN event_type = 'error' THEN 0.0 ELSE 30.0 + event_id % 50 END AS DOUBLE) AS temp_c FROM events"""


@query("telemetry_windows", f"""WITH fx AS ({FX_TELEMETRY})
SELECT run_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, max(rss_gb) AS rss_peak_gb,
       round(avg(temp_c), 6) AS temp_avg_c, count(*) AS samples FROM fx GROUP BY run_id, date_trunc('hour', ts)""")
def q_telemetry_windows(spark, sf_dir):
    out = J.telemetry_windows(sql(spark, sf_dir, FX_TELEMETRY))
    return out.withColumn("temp_avg_c", F.round("temp_avg_c", 6))


@query("telemetry_sessions", f"""WITH fx AS ({FX_TELEMETRY}),
l AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY run_id ORDER BY ts) IS NULL
                      OR ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS nw FROM fx),
s AS (SELECT *, sum(nw) OVER (PARTITION BY run_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM l)
SELECT run_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS session_start, CAST(floor(epoch(max(ts) + INTERVAL 30 MINUTE)) AS BIGINT) AS session_end,
       count(*) AS samples, max(rss_gb) AS rss_peak_gb FROM s GROUP BY run_id, sid""")
def q_telemetry_sessions(spark, sf_dir):
    return J.telemetry_sessions(sql(spark, sf_dir, FX_TELEMETRY))


FX_REQ_EVENTS = """SELECT event_id, ts, event_type, user_id FROM events"""


@query("dedupe_stream", """SELECT DISTINCT sha256(CAST(to_json([event_type, CAST(user_id AS VARCHAR)]) AS VARCHAR)) AS request_hash FROM events""")
def q_dedupe_stream(spark, sf_dir):
    d = sql(spark, sf_dir, FX_REQ_EVENTS).withColumn("request_hash", request_hash("event_type", "user_id"))
    return J.dedupe_stream(d).select("request_hash")


@query("score_stream", """SELECT d.doc_id, CAST(trim(CAST(l.quality AS VARCHAR)) = trim(CAST(1 - l.toxic AS VARCHAR)) AS DOUBLE) AS correct
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_score_stream(spark, sf_dir):
    resp = sql(spark, sf_dir, "SELECT doc_id, CAST(1 - toxic AS STRING) AS pred FROM labels")
    gold = sql(spark, sf_dir, "SELECT d.doc_id, CAST(l.quality AS STRING) AS gold FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
    return J.score_against_gold(resp, gold).select("doc_id", "correct")
