"""Checked queries of T3, A22-A28, W6-W8, W13, K1, K2."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from chatlake.operators import monitoring as M
from chatlake.operators import usage as U
from chatlake.operators.risk import error_category, error_severity
from chatlake.plans.registry import query
from chatlake.plans.risk_queries import _ERRORS
from chatlake.sources import adapters as S
from chatlake.sources.adapters import AS_OF

#: Prices of the stored event types; "view" has none and takes the first.
PRICES = {"click": ("0.0005", "0.0015"), "purchase": ("0.0300", "0.0900"), "error": ("0.0003", "0.0010"),
          "signup": ("0.0100", "0.0200")}

USE = """u AS (SELECT event_id, user_id, ts, CAST(floor(value * 10) AS BIGINT) AS i, CAST(floor(value) AS BIGINT) AS o, event_type FROM events),
 c AS (SELECT *, CAST(i * CASE event_type WHEN 'purchase' THEN 0.0300 WHEN 'error' THEN 0.0003 WHEN 'signup' THEN 0.0100 ELSE 0.0005 END
 + o * CASE event_type WHEN 'purchase' THEN 0.0900 WHEN 'error' THEN 0.0010 WHEN 'signup' THEN 0.0200 ELSE 0.0015 END AS DECIMAL(28,10)) / 1000 AS cost_d,
 CAST(cost_d AS DECIMAL(28,10)) AS cost FROM u)"""
_AGG = """count(*) AS requests, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
 CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(cost) AS DOUBLE) / greatest(count(*), 1) AS cost_per_request"""


def costed(spark, sf):
    return U.with_cost(S.usage_events(spark, sf), PRICES)


@query(f"WITH {USE} SELECT event_id, CAST(cost AS DOUBLE) AS cost FROM c")
def call_cost(spark, sf):
    return costed(spark, sf).select("event_id", F.col("cost").cast("double").alias("cost"))


@query(f"WITH {USE} SELECT CAST(ts AS DATE) AS day, {_AGG} FROM c GROUP BY 1")
def usage_daily(spark, sf):
    return U.daily_usage(costed(spark, sf))


@query(f"WITH {USE} SELECT CAST(ts AS DATE) AS day, user_id, {_AGG} FROM c GROUP BY 1, 2")
def usage_user_day(spark, sf):
    return U.user_day_usage(costed(spark, sf))


@query(f"""WITH {USE}, a AS (SELECT CAST(ts AS DATE) AS day, user_id, {_AGG} FROM c GROUP BY 1, 2)
 SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY day ORDER BY cost DESC, user_id) AS INTEGER) AS cost_rank FROM a) WHERE cost_rank <= 10""")
def top_cost_users(spark, sf):
    return U.top_users_by_day(costed(spark, sf))


@query(f"""WITH {USE} SELECT CAST(ts AS DATE) AS day, user_id, {_AGG} FROM c WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY 1, 2
 ORDER BY cost DESC, user_id LIMIT 10""")
def top_cost_users_of_day(spark, sf):
    return U.top_users(costed(spark, sf), dt.date(2024, 1, 15))


@query(f"""WITH {USE} SELECT user_id, date_trunc('hour', ts) AS hour, CAST(sum(i + o) AS BIGINT) AS tokens FROM c GROUP BY 1, 2
 HAVING sum(i + o) > 1000""")
def hourly_token_breaches(spark, sf):
    return U.hourly_token_breaches(S.usage_events(spark, sf), 1000)


def _alerts_sql(keys: str, threshold: str) -> str:
    return f"""WITH {USE}, r AS (SELECT *, CAST(ts AS DATE) AS day, sum(cost) OVER (PARTITION BY {keys} ORDER BY ts, event_id
 ROWS UNBOUNDED PRECEDING) AS running FROM c), l AS (SELECT *, CASE WHEN running > {threshold} THEN CAST(floor(running / {threshold}) AS BIGINT) ELSE 0 END AS level
 FROM r), g AS (SELECT *, lag(level, 1, 0) OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS before FROM l)
 SELECT event_id, day, user_id, level, CAST(running AS DOUBLE) AS running_cost FROM g WHERE level > before"""


@query(_alerts_sql("CAST(ts AS DATE), user_id", "0.005"))
def cost_alerts(spark, sf):
    rows = U.cost_alerts(costed(spark, sf), "0.005")
    return rows.select("event_id", "day", "user_id", "level", F.col("running_cost").cast("double").alias("running_cost"))


@query(_alerts_sql("CAST(ts AS DATE)", "0.1"))
def global_cost_alerts(spark, sf):
    rows = U.cost_alerts(costed(spark, sf), "0.1", keys=())
    return rows.select("event_id", "day", "user_id", "level", F.col("running_cost").cast("double").alias("running_cost"))


@query("""SELECT event_id, user_id, ts, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id
 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 100""")
def keep_last_n(spark, sf):
    return U.keep_last(S.usage_events(spark, sf), ("user_id",), 100).select("event_id", "user_id", "ts", "rn")


@query("""SELECT event_id, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE)
 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 100""")
def keep_last_per_day(spark, sf):
    rows = S.usage_events(spark, sf).withColumn("day", F.to_date("ts"))
    return U.keep_last(rows, ("user_id", "day"), 100).select("event_id", "rn")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'")
def keep_young(spark, sf):
    return U.keep_young(S.usage_events(spark, sf), AS_OF, days=7).select("event_id", "ts")


@query("""SELECT event_id, user_id, date_trunc('day', ts) AS window_start, n AS request_no, n > 3 AS rejected FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events)""")
def rate_limited(spark, sf):
    rows = U.rate_limited(S.usage_events(spark, sf), "user_id", 3, window="1 day", unit="hour")
    return rows.select("event_id", "user_id", "window_start", "request_no", "rejected")


_CALLS = """calls AS (SELECT event_id, user_id, ts, event_type AS operation, value / 100 AS seconds,
 CAST(json_extract(props, '$.k') AS BIGINT) AS k, k % 8 = 0 AS failed FROM events)"""


@query(f"""WITH {_CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY ts DESC, event_id DESC) AS rn FROM calls),
 p AS (SELECT operation, count(*) AS call_count, round(avg(seconds), 9) AS avg_seconds, max(seconds) AS max_seconds,
 min(seconds) AS min_seconds, avg(CAST(failed AS INTEGER)) AS error_rate, count(*) FILTER (WHERE seconds > 1) AS slow_count
 FROM r WHERE rn <= 100 GROUP BY operation)
 SELECT *, concat_ws('; ', CASE WHEN avg_seconds > 0.5 THEN 'high average time' END, CASE WHEN error_rate > 0.1 THEN 'high error rate' END,
 CASE WHEN slow_count > 10 THEN 'many slow calls' END) AS recommendations FROM p""")
def operation_profile(spark, sf):
    return M.operation_profile(S.operation_calls(spark, sf)).withColumn("avg_seconds", F.round("avg_seconds", 9)).withColumn(
        "recommendations", F.array_join("recommendations", "; "))


@query(f"""WITH {_CALLS}, r AS (SELECT * FROM calls ORDER BY ts DESC, event_id DESC LIMIT 1000)
 SELECT count(*) AS total_calls, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-30 23:00:00') AS recent_calls,
 round(avg(seconds), 9) AS avg_seconds, count(*) FILTER (WHERE seconds > 1) AS slow_count,
 avg(CAST(seconds > 1 AS INTEGER)) AS slow_rate FROM r""")
def overall_profile(spark, sf):
    return M.overall_profile(S.operation_calls(spark, sf), AS_OF).withColumn("avg_seconds", F.round("avg_seconds", 9))


@query(f"WITH {_CALLS} SELECT event_id, operation, seconds FROM calls WHERE seconds > 1 ORDER BY seconds DESC, event_id LIMIT 10")
def slowest_operations(spark, sf):
    return M.slowest(S.operation_calls(spark, sf)).select("event_id", "operation", "seconds")


@query(f"WITH {_CALLS} SELECT event_id, operation, seconds FROM calls WHERE ts > TIMESTAMP '2024-01-30 00:00:00'")
def operation_log(spark, sf):
    return M.operation_log(S.operation_calls(spark, sf), AS_OF).select("event_id", "operation", "seconds")


@query(f"""WITH {_ERRORS} SELECT CASE grouping(category, severity) WHEN 0 THEN 'category_severity' WHEN 1 THEN 'category' WHEN 2 THEN 'severity'
 ELSE 'total' END AS scope, category, severity, count(*) AS errors FROM err
 GROUP BY GROUPING SETS ((category), (severity), (category, severity), ())""")
def error_summary(spark, sf):
    return M.error_summary(_errors(spark, sf))


def _errors(spark, sf):
    m = F.col("message")
    return S.error_events(spark, sf).withColumn("category", error_category(m)).withColumn("severity", error_severity(m))


@query(f"""WITH {_ERRORS}, n AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY ts, event_id) AS error_no FROM err)
 SELECT event_id, severity, error_no FROM n WHERE error_no % CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 10 WHEN 'low' THEN 50 END = 0""")
def error_alerts(spark, sf):
    return M.error_alerts(_errors(spark, sf), unit="hour").select("event_id", "severity", "error_no")


@query(f"""WITH {_CALLS}, r AS (SELECT *, seconds * 4 AS s4 FROM calls ORDER BY ts DESC, event_id DESC LIMIT 10000)
 SELECT count(*) AS total, count(*) FILTER (WHERE s4 > 10) AS slow, count(*) FILTER (WHERE k % 5 = 0) AS fallbacks,
 count(*) FILTER (WHERE failed) AS errors FROM r""")
def processing_counters(spark, sf):
    rows = S.operation_calls(spark, sf).withColumn("seconds", F.col("seconds") * 4).withColumn("failed", F.col("status") == "error")
    return M.processing_counters(rows)


@query("""WITH RECURSIVE ev AS (SELECT event_type AS category, ts, event_id FROM events),
 kept(category, ts) AS (SELECT category, min(ts) FROM ev GROUP BY category
 UNION ALL SELECT k.category, (SELECT min(e.ts) FROM ev e WHERE e.category = k.category AND e.ts >= k.ts + INTERVAL 30 MINUTES)
 FROM kept k WHERE k.ts IS NOT NULL)
 SELECT k.category, k.ts, min(e.event_id) AS event_id FROM kept k JOIN ev e ON e.category = k.category AND e.ts = k.ts
 WHERE k.ts IS NOT NULL GROUP BY 1, 2""")
def alert_cooldown(spark, sf):
    alerts = S.usage_events(spark, sf).select(F.col("model").alias("category"), "ts", "event_id")
    return M.throttle(alerts, "category", dt.timedelta(minutes=30))
