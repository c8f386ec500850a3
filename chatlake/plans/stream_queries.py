"""Checked queries of ST1-ST5, ST7, ST8: the stored tables replayed as file streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from chatlake.operators.risk import score
from chatlake.plans.probe import PROBE
from chatlake.plans.registry import CHECKS, query
from chatlake.plans.risk_queries import scored_sql
from chatlake.plans.usage_queries import PRICES, USE
from chatlake.schemas import MESSAGES
from chatlake.session import scratch_path
from chatlake.sources import adapters as S
from chatlake.streaming import jobs as J


@query(CHECKS["risk_scored"])
def stream_scored_messages(spark, sf):
    rows = score(J.read_files(spark, sf, "conversations.parquet", MESSAGES), PROBE).select(
        "conv_id", "turn", "risk_level", F.array_join("keywords", "|").alias("keywords"), "category")
    return J.run_available(rows, "scored")


@query(f"""WITH {scored_sql("(SELECT * FROM conversations WHERE role = 'user')", 'conv_id, turn', 'text')}
 SELECT conv_id AS user_id, count(*) AS messages, count(*) FILTER (WHERE risk_level = 'high') AS high, high AS alerts FROM scored GROUP BY 1""")
def stream_scored_log(spark, sf):
    """ST1 with its sink; the batch is delivered twice, as after a failure."""
    base = scratch_path(spark, "scored-sink")
    rows = J.scored_messages(J.read_files(spark, sf, "conversations.parquet", MESSAGES).where("role = 'user'").select(
        F.col("conv_id").alias("user_id"), "turn", F.lit(S.AS_OF).cast("timestamp_ntz").alias("ts"), F.col("text").alias("user_message"),
        F.lit("").alias("bot_response")), PROBE)
    sink = J.write_scored(f"{base}/log", f"{base}/alerts")

    def twice(batch, number):
        sink(batch, number)
        sink(batch, number)

    J.run_batches(rows, "scored-sink", twice)
    log = spark.read.parquet(f"{base}/log").groupBy("user_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("risk_level") == "high").alias("high"))
    alerts = spark.read.parquet(f"{base}/alerts").groupBy(F.col("extra")["user_id"].cast("bigint").alias("user_id")).agg(F.count(F.lit(1)).alias("alerts"))
    return log.join(alerts, "user_id", "left").select("user_id", "messages", "high", F.coalesce("alerts", F.lit(0)).alias("alerts"))


@query(f"""WITH {USE} SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS requests, CAST(sum(i) AS BIGINT) AS input_tokens,
 CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(cost) AS DOUBLE) AS cost FROM c GROUP BY 1, 2""")
def stream_daily_usage(spark, sf):
    rows = J.daily_counts(S.event_stream(spark, sf), per_user=True, prices=PRICES)
    return J.run_upsert(rows, "usage", ["day", "user_id"]).withColumn("cost", F.col("cost").cast("double"))


@query("""WITH g AS (SELECT event_id, user_id, ts, lag(ts) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 n AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
 ROWS UNBOUNDED PRECEDING) AS s FROM g)
 SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 DAY AS session_end, count(*) AS messages FROM n GROUP BY user_id, s""")
def stream_sessions(spark, sf):
    path, gap = scratch_path(spark, "sessions-table"), dt.timedelta(days=1)
    J.run_batches(S.event_stream(spark, sf).select("user_id", "ts"), "sessions", J.session_batches(path, gap))
    rows = J.sessions_of(spark, path, gap)
    return rows.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "messages")


@query(CHECKS["alert_cooldown"])
def stream_alert_cooldown(spark, sf):
    alerts = S.event_stream(spark, sf).select(F.col("model").alias("category"), "ts", F.col("event_id").alias("alert_id"))
    path = scratch_path(spark, "throttle-table")
    J.run_batches(alerts, "throttle", J.throttle_batches(path, dt.timedelta(minutes=30)))
    return spark.read.parquet(f"{path}/kept").select("category", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("alert_id").alias("event_id"))


@query("""SELECT user_id, date_trunc('day', ts) AS window_start, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 3""")
def stream_rate_breaches(spark, sf):
    rows = J.run_upsert(J.rate_breaches(S.event_stream(spark, sf), "user_id", 3, window="1 day"), "rate", ["user_id", "window_start"])
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"""WITH {USE}, r AS (SELECT *, CAST(ts AS DATE) AS day, sum(cost) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id
 ROWS UNBOUNDED PRECEDING) AS running FROM c), l AS (SELECT *, CASE WHEN running > 0.005 THEN CAST(floor(running / 0.005) AS BIGINT) ELSE 0 END AS level FROM r),
 g AS (SELECT *, lag(level, 1, 0) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS before FROM l)
 SELECT CAST(user_id AS VARCHAR) AS user_id, day, event_id, level FROM g WHERE level > before""")
def stream_cost_alerts(spark, sf):
    path = scratch_path(spark, "cost-table")
    J.run_batches(S.event_stream(spark, sf), "cost", J.cost_level_batches(path, 0.005, prices=PRICES))
    return spark.read.schema("user_id string, day date, event_id bigint, level bigint").parquet(f"{path}/levels").drop("batch")


@query("SELECT event_id, user_id FROM events")
def stream_replays(spark, sf):
    events = S.event_stream(spark, sf)
    twice = events.unionByName(S.event_stream(spark, sf))
    return J.run_available(J.without_replays(twice, "event_id").select("event_id", "user_id"), "replays")
