"""Activity filters, feeds and dashboard roll-ups.

``activity`` rows carry user_id, ts, token_count and important_flag. Every roll-up is one aggregation with
map-side combine on a small key; no operator sorts a whole user.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.operators.segments import top_n

# Bounds of the request parameters (F5). Plans apply them; operators take what they are given.
LIMITS = {
    "lookback": (1, 180), "feed": (1, 200), "summaries": (1, 500), "users": (1, 100), "keywords": (1, 50),
    "history": (10, 200), "export": (1, 50_000),
}
# Message-count buckets in display order (A5, K6).
RETENTION_BUCKETS = (("1", 1), ("2-5", 5), ("6-15", 15), ("16-30", 30), ("31+", None))


def clamp(kind: str, value: int) -> int:
    low, high = LIMITS[kind]
    return max(low, min(high, int(value)))


def lookback_start(as_of: dt.datetime, days: int) -> dt.datetime:
    """midnight of the first day of the window that ends on the day of ``as_of``."""
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    return midnight - dt.timedelta(days=max(1, days) - 1)


def since(df: DataFrame, *, cutoff: dt.datetime | None = None, as_of: dt.datetime | None = None,
          days: int | None = None, ts: str = "ts") -> DataFrame:
    """inclusive look-back; an explicit cutoff wins, neither means no filter."""
    if cutoff is None and as_of is not None and days is not None:
        cutoff = lookback_start(as_of, days)
    return df if cutoff is None else df.where(F.col(ts) >= F.lit(cutoff).cast("timestamp_ntz"))


def parse_bound(text: str, *, end: bool = False) -> dt.datetime:
    """ISO bound; an offset is converted to UTC and dropped, a bare end date means the end of that day."""
    value = dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    if value.tzinfo is not None:
        value = value.astimezone(dt.UTC).replace(tzinfo=None)
    if end and len(text.strip()) == 10:
        value = value.replace(hour=23, minute=59, second=59, microsecond=999_999)
    return value


def between(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """inclusive range with literal bounds, so the reader can skip row groups."""
    low, high = parse_bound(start), parse_bound(end, end=True)
    if low > high:
        raise ValueError("start lies after end")
    return df.where(F.col(ts).between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")))


def _tokens() -> Column:
    return F.coalesce(F.col("token_count"), F.lit(0)).cast("bigint")


def _important() -> Column:
    return F.coalesce(F.col("important_flag"), F.lit(False))


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(_important()).alias("important_messages"),
    ]


def feed(df: DataFrame, user_id, *, limit: int = 20, order: str = "id") -> DataFrame:
    """F6 for one user: newest first; runs as a distributed top-k."""
    return df.where(F.col("user_id") == user_id).orderBy(F.col("ts").desc(), F.col(order).desc()).limit(limit)


def feeds(df: DataFrame, *, limit: int = 20, order: str = "id") -> DataFrame:
    """F6 for every user: the newest rows with their position."""
    return top_n(df, ["user_id"], [F.col("ts").desc(), F.col(order).desc()], limit)


def pseudonym(user_id: Column, salt: str) -> Column:
    """first twelve hex digits of a salted digest."""
    return F.substring(F.sha2(F.concat(F.lit(salt), user_id.cast("string")), 256), 1, 12)


def export_rows(df: DataFrame, salt: str, *, limit: int, order: str = "id") -> DataFrame:
    """pseudonymised rows, oldest first, absent values replaced."""
    names = set(df.columns)
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("user_message", "bot_response") if c in names]
    return (
        df.orderBy("ts", order).limit(limit)
        .select(F.col(order), pseudonym(F.col("user_id"), salt).alias("user_hash"), "ts", *texts,
                _tokens().alias("token_count"), _important().alias("important_flag"))
    )


def active_follow_ups(follow_ups: DataFrame) -> DataFrame:
    """F8."""
    return follow_ups.where(F.col("status") != "completed").agg(F.count(F.lit(1)).alias("active_follow_ups"))


def registered_only(df: DataFrame, registrations: DataFrame) -> DataFrame:
    """Rows of users with a verified code."""
    verified = registrations.where(F.col("status") == "verified").select("user_id")
    return df.join(verified, "user_id", "left_semi")


def latest_form(codes: DataFrame) -> DataFrame:
    """summary text of each user's newest verified form."""
    return (
        codes.where(F.col("status") == "verified").groupBy("user_id")
        .agg(F.max("verified_at").alias("verified_at"),
             F.max_by("form_data", F.struct("verified_at", "code")).alias("form_data"))
        .select("user_id", "verified_at", F.get_json_object("form_data", "$.ai_summary").alias("ai_summary"))
    )


def overview(df: DataFrame) -> DataFrame:
    """A1. Users are reduced to one row each first, so the distinct count never meets in one task."""
    return df.groupBy("user_id").agg(*_counts()).agg(
        F.coalesce(F.sum("total_messages"), F.lit(0)).alias("total_messages"),
        F.count("user_id").alias("unique_users"),
        F.coalesce(F.sum("important_messages"), F.lit(0)).alias("important_messages"),
    )


def daily_totals(df: DataFrame) -> DataFrame:
    """A2."""
    return df.groupBy(F.to_date("ts").alias("day")).agg(*_counts(), F.sum(_tokens()).alias("total_tokens"))


def user_summaries(df: DataFrame) -> DataFrame:
    """A3: one row per user; order and limit are applied by `newest_users`."""
    return df.groupBy("user_id").agg(
        *_counts(), F.max("ts").alias("last_interaction"), F.sum(_tokens()).alias("total_tokens"),
    )


def newest_users(summaries: DataFrame, limit: int | None = None) -> DataFrame:
    """K5: newest first; with a limit this is a distributed top-k."""
    ordered = summaries.orderBy(F.col("last_interaction").desc(), "user_id")
    return ordered if limit is None else ordered.limit(limit)


def user_snapshots(df: DataFrame) -> DataFrame:
    """A4: A3 plus the first interaction and the important share."""
    return (
        df.groupBy("user_id").agg(
            *_counts(), F.min("ts").alias("first_interaction"), F.max("ts").alias("last_interaction"),
            F.sum(_tokens()).alias("total_tokens"),
        ).withColumn("important_ratio", _ratio())
    )


def _ratio() -> Column:
    return F.coalesce(F.round(F.try_divide("important_messages", "total_messages"), 3), F.lit(0.0))


def retention_buckets(df: DataFrame) -> DataFrame:
    """A5: users per message-count bucket with the bucket's display rank."""
    n = F.col("n")
    label = rank = None
    for position, (name, top) in enumerate(RETENTION_BUCKETS):
        if top is None:
            label, rank = label.otherwise(F.lit(name)), rank.otherwise(F.lit(position))
        elif label is None:
            label, rank = F.when(n <= top, name), F.when(n <= top, F.lit(position))
        else:
            label, rank = label.when(n <= top, name), rank.when(n <= top, F.lit(position))
    return (
        df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(label.alias("bucket"), rank.alias("bucket_rank")).agg(F.count(F.lit(1)).alias("users"))
    )


def depth_trend(df: DataFrame) -> DataFrame:
    """Two levels (day and user, then day) keep the distinct count exact and spread."""
    per_user = df.groupBy(F.to_date("ts").alias("day"), "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(_tokens()).alias("t"))
    return (
        per_user.groupBy("day").agg(
            F.count("user_id").alias("unique_users"), F.sum("n").alias("total_messages"), F.sum("t").alias("tokens"))
        .select("day", "unique_users", "total_messages",
                F.round(F.try_divide("total_messages", "unique_users"), 1).alias("avg_messages_per_user"),
                F.round(F.try_divide("tokens", "total_messages"), 1).alias("avg_tokens_per_message"))
    )


def user_stats(df: DataFrame, missing: str = "-") -> DataFrame:
    """The four scalar statistics of every user in one pass."""
    return user_summaries(df).select(
        "user_id", "total_messages", "important_messages", "total_tokens",
        F.coalesce(F.date_format("last_interaction", "yyyy-MM-dd HH:mm:ss"), F.lit(missing)).alias("last_interaction"),
    )


def engagement(df: DataFrame) -> DataFrame:
    """One row of KPIs over all users."""
    ratio = F.col("important_ratio")
    users = user_summaries(df).withColumn("important_ratio", _ratio())
    k = users.agg(
        F.count(F.lit(1)).alias("active_users"),
        F.count_if(F.col("total_messages") >= 10).alias("returning_users"),
        F.count_if(ratio >= 0.4).alias("high_focus_users"),
        F.count_if((ratio >= 0.15) & (ratio < 0.4)).alias("growth_watch_users"),
        F.count_if(F.col("total_tokens") >= 2000).alias("deep_conversation_users"),
        F.coalesce(F.sum("total_messages"), F.lit(0)).alias("m"),
        F.coalesce(F.sum("important_messages"), F.lit(0)).alias("i"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("t"),
    )
    share = lambda a, b, places: F.coalesce(F.round(F.try_divide(a, b), places), F.lit(0.0))
    return k.select(
        "active_users", "returning_users", "high_focus_users", "growth_watch_users",
        F.greatest(F.col("active_users") - F.col("high_focus_users") - F.col("growth_watch_users"), F.lit(0))
        .alias("monitor_users"),
        "deep_conversation_users",
        share("m", "active_users", 1).alias("avg_messages_per_user"),
        share("t", "m", 2).alias("avg_tokens_per_message"),
        share("i", "m", 3).alias("important_message_share"),
    )


def with_events(users: DataFrame, events: DataFrame) -> DataFrame:
    """Attach each user's recent events, an empty list where there are none."""
    joined = users.join(events, "user_id", "left")
    empty = F.from_json(F.lit("[]"), events.schema["events"].dataType)
    return joined.withColumn("events", F.coalesce("events", empty))
