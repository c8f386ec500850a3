"""Token and cost accounting.

Money is summed as DECIMAL, so totals do not depend on the order in which partitions arrive.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.operators.segments import numbered, running, time_segment, top_n

# Price per 1000 tokens as (input, output); the first entry prices unknown models.
PRICES = {
    "grok-4": ("0.0005", "0.0015"),
    "grok-4-1-fast-reasoning": ("0.0005", "0.0015"),
    "grok-2": ("0.0003", "0.0010"),
}
# Alert thresholds.
USER_DAILY_COST = "1.0"
GLOBAL_DAILY_COST = "100.0"
USER_HOURLY_TOKENS = 100_000
_MONEY = "DECIMAL(28,10)"


def call_cost(model: Column, input_tokens: Column, output_tokens: Column,
              prices: dict[str, tuple[str, str]] | None = None) -> Column:
    """Cost of a call; the first price applies to models without one."""
    prices = prices or PRICES
    default = next(iter(prices.values()))

    def price(i: int) -> Column:
        out = F.lit(default[i])
        for name, pair in prices.items():
            out = F.when(model == name, F.lit(pair[i])).otherwise(out)
        return out.cast("DECIMAL(12,8)")

    per_thousand = lambda tokens, i: tokens.cast("DECIMAL(18,0)") * price(i)
    total = per_thousand(input_tokens, 0) + per_thousand(output_tokens, 1)
    return (total / F.lit(1000).cast("DECIMAL(4,0)")).cast(_MONEY)


def with_cost(events: DataFrame, prices: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    return events.withColumn("cost", call_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), prices))


def _totals() -> list[Column]:
    return [F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"), F.sum("cost").cast(_MONEY).alias("cost")]


def _per_request(df: DataFrame) -> DataFrame:
    each = F.col("cost").cast("double") / F.greatest(F.col("requests"), F.lit(1))
    return df.withColumn("cost_per_request", each).withColumn("cost", F.col("cost").cast("double"))


def daily_usage(costed: DataFrame) -> DataFrame:
    """A22."""
    return _per_request(costed.groupBy(F.to_date("ts").alias("day")).agg(*_totals()))


def user_day_usage(costed: DataFrame) -> DataFrame:
    """A23."""
    return _per_request(costed.groupBy(F.to_date("ts").alias("day"), "user_id").agg(*_totals()))


def top_users(costed: DataFrame, day: dt.date, n: int = 10) -> DataFrame:
    """A24 for one day: a distributed top-k."""
    rows = user_day_usage(costed.where(F.to_date("ts") == F.lit(day)))
    return rows.orderBy(F.col("cost").desc(), "user_id").limit(n)


def top_users_by_day(costed: DataFrame, n: int = 10) -> DataFrame:
    """A24 for all days."""
    return top_n(user_day_usage(costed), ["day"], [F.col("cost").desc(), F.col("user_id").asc()], n, rank="cost_rank")


def hourly_token_breaches(events: DataFrame, limit: int = USER_HOURLY_TOKENS) -> DataFrame:
    """Users whose tokens within an hour pass the limit."""
    return (
        events.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour"))
        .agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens")).where(F.col("tokens") > limit)
    )


def cost_alerts(costed: DataFrame, threshold: str, keys: tuple[str, ...] = ("user_id",), *,
                order: str = "event_id", unit: str = "minute") -> DataFrame:
    """A row for every call that lifts the running cost of the day to a new multiple of the threshold.

    Use ``keys=()`` for the global daily cost. The level before a row follows from its own cost, so the
    only order-dependent step is the running sum.
    """
    t = F.lit(threshold).cast("DECIMAL(12,4)")
    level = lambda c: F.when(c > t, F.floor(c / t)).otherwise(F.lit(0)).cast("bigint")
    days = costed.withColumn("day", F.to_date("ts"))
    summed = running(days, ["day", *keys], time_segment("ts", unit), [F.col("ts"), F.col(order)],
                     {"running_cost": F.col("cost")})
    return (
        summed.withColumn("level", level(F.col("running_cost")))
        .where(F.col("level") > level(F.col("running_cost") - F.col("cost")))
        .withColumn("running_cost", F.col("running_cost").cast(_MONEY))
    )


def keep_last(df: DataFrame, keys: tuple[str, ...], n: int, *, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """K1: newest ``n`` rows per key."""
    return top_n(df, list(keys), [F.col(ts).desc(), F.col(order).desc()], n)


def keep_last_overall(df: DataFrame, n: int, *, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """K1 without a key."""
    return df.orderBy(F.col(ts).desc(), F.col(order).desc()).limit(n)


def keep_young(df: DataFrame, as_of: dt.datetime, *, ts: str = "ts", **age: int) -> DataFrame:
    """K2: rows no older than the age given as timedelta arguments."""
    return df.where(F.col(ts) >= F.lit(as_of - dt.timedelta(**age)).cast("timestamp_ntz"))


def rate_limited(df: DataFrame, key: str, limit: int, *, window: str = "1 hour", ts: str = "ts",
                 order: str = "event_id", unit: str = "minute") -> DataFrame:
    """Number each request within its client's fixed window and flag the ones past the limit."""
    windows = df.withColumn("window_start", F.window(F.col(ts), window).start)
    counted = numbered(windows, [key, "window_start"], time_segment(ts, unit), [F.col(ts), F.col(order)], "request_no")
    return counted.withColumn("rejected", F.col("request_no") > limit)
