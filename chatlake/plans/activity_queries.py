"""Checked queries of F1-F10 and A1-A8."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from chatlake.operators import analytics as N
from chatlake.plans.registry import query
from chatlake.sources import adapters as S
from chatlake.sources.adapters import AS_OF
from chatlake.sources.tables import scan

ACT = """act AS (SELECT event_id AS id, user_id, ts, CAST(floor(value) AS BIGINT) AS token_count,
 event_type IN ('error', 'purchase') AS important_flag FROM events)"""
SUMS = ACT + """, su AS (SELECT user_id, count(*) AS total_messages,
 count(*) FILTER (WHERE important_flag) AS important_messages, max(ts) AS last_interaction, min(ts) AS first_interaction,
 CAST(sum(token_count) AS BIGINT) AS total_tokens FROM act GROUP BY user_id)"""


@query(f"""WITH {ACT} SELECT count(*) AS total_messages, count(DISTINCT user_id) AS unique_users,
 count(*) FILTER (WHERE important_flag) AS important_messages FROM act""")
def overview(spark, sf):
    return N.overview(S.activity(spark, sf))


@query(f"""WITH {ACT} SELECT count(*) AS total_messages, count(DISTINCT user_id) AS unique_users,
 count(*) FILTER (WHERE important_flag) AS important_messages FROM act WHERE ts >= TIMESTAMP '2024-01-25 00:00:00'""")
def overview_lookback(spark, sf):
    return N.overview(N.since(S.activity(spark, sf), as_of=AS_OF, days=7))


@query(f"""WITH {ACT} SELECT CAST(ts AS DATE) AS day, count(*) AS total_messages,
 count(*) FILTER (WHERE important_flag) AS important_messages, CAST(sum(token_count) AS BIGINT) AS total_tokens
 FROM act GROUP BY 1""")
def daily_totals(spark, sf):
    return N.daily_totals(S.activity(spark, sf))


@query(f"""WITH {SUMS} SELECT user_id, total_messages, important_messages, last_interaction, total_tokens FROM su""")
def user_summaries(spark, sf):
    return N.user_summaries(S.activity(spark, sf))


@query(f"""WITH {SUMS} SELECT user_id, total_messages, important_messages, last_interaction, total_tokens FROM su
 ORDER BY last_interaction DESC, user_id LIMIT 25""")
def newest_users(spark, sf):
    return N.newest_users(N.user_summaries(S.activity(spark, sf)), 25)


@query(f"""WITH {SUMS} SELECT user_id, total_messages, important_messages, first_interaction, last_interaction,
 total_tokens, round(important_messages / total_messages, 3) AS important_ratio FROM su""")
def user_snapshot(spark, sf):
    return N.user_snapshots(S.activity(spark, sf))


@query(f"""WITH {SUMS} SELECT CASE WHEN total_messages <= 1 THEN '1' WHEN total_messages <= 5 THEN '2-5'
 WHEN total_messages <= 15 THEN '6-15' WHEN total_messages <= 30 THEN '16-30' ELSE '31+' END AS bucket,
 CAST(CASE WHEN total_messages <= 1 THEN 0 WHEN total_messages <= 5 THEN 1 WHEN total_messages <= 15 THEN 2
 WHEN total_messages <= 30 THEN 3 ELSE 4 END AS INTEGER) AS bucket_rank, count(*) AS users FROM su GROUP BY 1, 2""")
def retention_buckets(spark, sf):
    return N.retention_buckets(S.activity(spark, sf))


@query("""WITH act AS (SELECT user_id, ts, CAST(floor(value) AS BIGINT) AS token_count FROM events
 WHERE ts >= TIMESTAMP '2024-01-30 00:00:00'),
 su AS (SELECT user_id, count(*) AS n FROM act GROUP BY user_id)
 SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 15 THEN '6-15' WHEN n <= 30 THEN '16-30'
 ELSE '31+' END AS bucket, CAST(CASE WHEN n <= 1 THEN 0 WHEN n <= 5 THEN 1 WHEN n <= 15 THEN 2 WHEN n <= 30 THEN 3
 ELSE 4 END AS INTEGER) AS bucket_rank, count(*) AS users FROM su GROUP BY 1, 2""")
def retention_buckets_lookback(spark, sf):
    return N.retention_buckets(N.since(S.activity(spark, sf), as_of=AS_OF, days=2))


@query(f"""WITH {ACT} SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS unique_users, count(*) AS total_messages,
 round(count(*) / count(DISTINCT user_id), 1) AS avg_messages_per_user,
 round(CAST(sum(token_count) AS BIGINT) / count(*), 1) AS avg_tokens_per_message FROM act GROUP BY 1""")
def depth_trend(spark, sf):
    return N.depth_trend(S.activity(spark, sf))


@query(f"""WITH {SUMS} SELECT user_id, total_messages, important_messages, total_tokens,
 strftime(last_interaction, '%Y-%m-%d %H:%M:%S') AS last_interaction FROM su""")
def user_stats(spark, sf):
    return N.user_stats(S.activity(spark, sf))


@query(f"""WITH {SUMS}, r AS (SELECT *, round(important_messages / total_messages, 3) AS ratio FROM su),
 k AS (SELECT count(*) AS active_users, count(*) FILTER (WHERE total_messages >= 10) AS returning_users,
  count(*) FILTER (WHERE ratio >= 0.4) AS high_focus_users,
  count(*) FILTER (WHERE ratio >= 0.15 AND ratio < 0.4) AS growth_watch_users,
  count(*) FILTER (WHERE total_tokens >= 2000) AS deep_conversation_users,
  CAST(sum(total_messages) AS BIGINT) AS m, CAST(sum(important_messages) AS BIGINT) AS i,
  CAST(sum(total_tokens) AS BIGINT) AS t FROM r)
 SELECT active_users, returning_users, high_focus_users, growth_watch_users,
  greatest(active_users - high_focus_users - growth_watch_users, 0) AS monitor_users, deep_conversation_users,
  round(m / active_users, 1) AS avg_messages_per_user, round(t / m, 2) AS avg_tokens_per_message,
  round(i / m, 3) AS important_message_share FROM k""")
def engagement_kpis(spark, sf):
    return N.engagement(S.activity(spark, sf))


@query(f"""WITH {ACT} SELECT id, user_id, ts, token_count, important_flag, CAST(rn AS INTEGER) AS rn FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rn FROM act) WHERE rn <= 20""")
def conversation_feeds(spark, sf):
    return N.feeds(S.activity(spark, sf), limit=20)


@query(f"""WITH {ACT} SELECT * FROM act WHERE user_id = (SELECT min(user_id) FROM act) ORDER BY ts DESC, id DESC LIMIT 20""")
def conversation_feed(spark, sf):
    activity = S.activity(spark, sf)
    return N.feed(activity, activity.agg(F.min("user_id").alias("u")).select("u").scalar(), limit=20)


@query(f"""WITH {ACT} SELECT id, substr(sha256('pepper' || CAST(user_id AS VARCHAR)), 1, 12) AS user_hash, ts, token_count,
 important_flag FROM act WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 23:59:59.999999'
 ORDER BY ts, id LIMIT 50000""")
def export_pseudonymised(spark, sf):
    return N.export_rows(N.between(S.activity(spark, sf), "2024-01-10", "2024-01-12"), "pepper", limit=50_000)


@query("""WITH f AS (SELECT event_id AS id, user_id, CASE WHEN event_type = 'purchase' THEN 'completed'
 WHEN event_type = 'view' THEN 'sent' ELSE 'pending' END AS status FROM events)
 SELECT count(*) AS active_follow_ups FROM f WHERE status <> 'completed'""")
def active_follow_ups(spark, sf):
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "view", "sent").otherwise("pending")
    return N.active_follow_ups(scan(spark, sf, "events").select("event_id", "user_id", status.alias("status")))


@query(f"""WITH {ACT} SELECT a.user_id, count(*) AS rows_kept FROM act a WHERE EXISTS (SELECT 1 FROM events e
 WHERE e.user_id = a.user_id AND e.event_type = 'signup') GROUP BY a.user_id""")
def registered_activity(spark, sf):
    """Activity of all users that ever signed up."""
    kept = N.registered_only(S.activity(spark, sf), S.registrations(spark, sf))
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows_kept"))


@query("""WITH c AS (SELECT event_id, user_id, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
 WHERE event_type = 'signup'), v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC,
 lpad(CAST(event_id AS VARCHAR), 6, '0') DESC) AS rn FROM c WHERE k % 2 = 0)
 SELECT user_id, ts AS verified_at, CASE WHEN k % 3 = 0 THEN '' ELSE 'summary ' || CAST(event_id AS VARCHAR) END AS ai_summary
 FROM v WHERE rn = 1""")
def latest_forms(spark, sf):
    return N.latest_form(S.codes(spark, sf))


@query("""SELECT event_id, TRY_CAST(t AS TIMESTAMP) AS parsed FROM (SELECT event_id,
 CASE WHEN event_type = 'error' THEN 'not a time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS t FROM events)""")
def timestamp_coercion(spark, sf):
    from chatlake.functions.text import parse_timestamp

    text = F.when(F.col("event_type") == "error", F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return scan(spark, sf, "events").select("event_id", parse_timestamp(text).alias("parsed"))


@query("""WITH r AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_type = 'error' THEN 'high' ELSE 'medium' END AS lvl,
 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
 WHERE event_type IN ('error', 'purchase') AND ts >= TIMESTAMP '2024-01-29'),
 e AS (SELECT user_id, string_agg(lvl || '@' || strftime(ts, '%Y-%m-%d %H:%M:%S'), ';' ORDER BY rn) AS events
 FROM r WHERE rn <= 5 GROUP BY user_id), u AS (SELECT user_id, count(*) AS total_messages FROM events GROUP BY user_id)
 SELECT u.user_id, u.total_messages, coalesce(e.events, '') AS events FROM u LEFT JOIN e ON e.user_id = u.user_id""")
def users_with_events(spark, sf):
    from chatlake.operators.risk import recent_events

    users = N.user_summaries(S.activity(spark, sf)).select("user_id", "total_messages")
    recent = recent_events(N.since(S.progress(spark, sf), as_of=AS_OF, days=3))
    joined = N.with_events(users, recent)
    text = F.transform("events", lambda e: F.concat(e["risk_level"], F.lit("@"), F.date_format(e["ts"], "yyyy-MM-dd HH:mm:ss")))
    return joined.select("user_id", "total_messages", F.array_join(text, ";").alias("events"))
