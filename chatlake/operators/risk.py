"""R8e-R8h, A9-A12, A21: scoring of messages and the roll-ups over risk events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chatlake.functions import risk as R
from chatlake.functions.lexicon import Lexicon
from chatlake.functions.text import estimate_tokens, strip
from chatlake.operators.segments import top_n
from chatlake.schemas import ALERTS

LEVELS = ("high", "medium", "general")

# Ordered substring rules of error texts -> (category, severity); the last entry is the default (R8h).
ERROR_RULES = (
    (("database", "mysql"), "database", "high"),
    (("network", "connection", "timeout"), "network", "medium"),
    (("api", "http"), "external_api", "medium"),
    (("auth", "permission"), "authentication", "high"),
    (("validation", "invalid"), "validation", "low"),
    ((), "system", "medium"),
)


def score(messages: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Add risk_level, keywords and category. Narrow: no exchange, no Python."""
    prepared = R.prepare(F.col(text))
    return (
        messages.withColumn("__p", prepared)
        .withColumn("__h", R.high_hits(F.col("__p"), lexicon))
        .withColumn("__m", R.medium_hits(F.col("__p"), lexicon))
        .withColumn("__a", R.assess(F.col("__h"), F.col("__m"), lexicon))
        .withColumn("risk_level", F.col("__a")["level"]).withColumn("keywords", F.col("__a")["keywords"])
        .withColumn("category", F.when(F.size("keywords") > 0, R.category(F.col("keywords"), lexicon)))
        .drop("__p", "__h", "__m", "__a")
    )


def score_exchanges(exchanges: DataFrame, lexicon: Lexicon) -> DataFrame:
    """R8e: tokens, level, keywords and importance of each (user_message, bot_response)."""
    scored = score(exchanges, lexicon, "user_message")
    both = F.concat(F.coalesce("user_message", F.lit("")), F.coalesce("bot_response", F.lit("")))
    return scored.withColumn("token_count", estimate_tokens(both)).withColumn(
        "important_flag", R.is_important(F.col("user_message"), F.col("bot_response"), F.col("risk_level")))


def template_key(level: Column, category: Column) -> Column:
    """R8f: which reply a message calls for."""
    return (
        F.when((level == "high") & category.isin("suicide", "overdose"), category)
        .when(level == "high", "other").otherwise("general")
    )


def fill_templates(rows: DataFrame, templates: DataFrame, key: str, *arguments: str) -> DataFrame:
    """R8f: caller-supplied (template_key, template) rows filled by printf rules.

    A template table is a handful of rows; it still joins by the optimizer's own size check.
    """
    t = templates.select(F.col("template_key").alias("__key"), F.col("template").alias("__template"))
    filled = F.call_function("format_string", F.col("__template"), *[F.col(a) for a in arguments])
    return rows.join(t, rows[key] == F.col("__key"), "left").withColumn("reply", filled).drop("__key", "__template")


def checkin_key(level: Column) -> Column:
    return F.when(level.isin("high", "medium"), level).otherwise("general")


def _alert(category: Column, severity: Column, ts: Column, text: Column, **extra: Column) -> list[Column]:
    pairs = [c for k, v in extra.items() for c in (F.lit(k), v.cast("string"))]
    return [category.alias("category"), severity.alias("severity"), ts.alias("ts"), text.alias("text"),
            F.create_map(*pairs).alias("extra")]


def _short_id(user_id: Column) -> Column:
    return F.concat(F.substring(user_id.cast("string"), 1, 8), F.lit("..."))


def high_risk_alerts(scored: DataFrame) -> DataFrame:
    """R8g: one critical alert per high-risk message, first five keywords."""
    user = F.col("user_id").cast("string")
    return scored.where(F.col("risk_level") == "high").select(*_alert(
        F.concat(F.lit("high_risk:"), user), F.lit("critical"), F.col("ts"),
        F.concat(F.lit("high risk signals from user "), _short_id(user)),
        risk_level=F.col("risk_level"), keywords=F.array_join(F.slice("keywords", 1, 5), ", "), user_id=user))


def critical_error_alerts(errors: DataFrame) -> DataFrame:
    """R8g: (user_id, ts, user_message, error) rows."""
    user = F.col("user_id").cast("string")
    return errors.select(*_alert(
        F.lit("critical_error"), F.lit("critical"), F.col("ts"),
        F.concat(F.lit("critical error for user "), _short_id(user)),
        user_id=user, user_message=F.substring("user_message", 1, 100), error=F.substring("error", 1, 200)))


def breaker_alerts(changes: DataFrame) -> DataFrame:
    """R8g: (name, state, failure_count, ts) rows."""
    return changes.select(*_alert(
        F.concat(F.lit("circuit_breaker:"), F.col("name")), F.when(F.col("state") == "open", "warning").otherwise("info"),
        F.col("ts"), F.format_string("breaker %s is %s", "name", "state"),
        breaker_name=F.col("name"), new_state=F.col("state"), failure_count=F.col("failure_count")))


def cost_alert_rows(costs: DataFrame) -> DataFrame:
    """R8g: (current_cost, threshold, model, ts) rows."""
    money = lambda c: F.format_string("$%.2f", F.col(c).cast("double"))
    return costs.select(*_alert(
        F.lit("cost_threshold"), F.lit("warning"), F.col("ts"),
        F.concat(F.lit("cost of the day "), money("current_cost"), F.lit(" exceeds "), money("threshold")),
        current_cost=money("current_cost"), threshold=money("threshold"), model=F.col("model")))


def all_alerts(*frames: DataFrame) -> DataFrame:
    shape = StructType.fromDDL(ALERTS)
    out = frames[0].to(shape)
    for f in frames[1:]:
        out = out.unionByName(f.to(shape))
    return out


def _rule_value(text: Column, index: int) -> Column:
    lowered, out = F.lower(text), F.lit(ERROR_RULES[-1][index])
    for rule in reversed(ERROR_RULES[:-1]):
        out = F.when(R.any_term(lowered, rule[0]), F.lit(rule[index])).otherwise(out)
    return out


def error_category(text: Column) -> Column:
    """R8h."""
    return _rule_value(text, 1)


def error_severity(text: Column) -> Column:
    return _rule_value(text, 2)


def risk_summary(events: DataFrame) -> DataFrame:
    """Every level outside the three counts as unknown."""
    level = R.normalise_level(F.col("risk_level"))
    return events.agg(
        *[F.count_if(level == name).alias(name) for name in LEVELS],
        F.count_if(~level.isin(*LEVELS)).alias("unknown"),
    )


def risk_trend(events: DataFrame) -> DataFrame:
    """A10: fixed pivot values, so the levels are never collected first."""
    level = R.normalise_level(F.col("risk_level"))
    return events.groupBy(F.to_date("ts").alias("day")).agg(*[F.count_if(level == name).alias(name) for name in LEVELS])


def top_keywords(events: DataFrame, lexicon: Lexicon, k: int = 10, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Keywords by count, shown in their first spelling, classed by lexicon level."""
    # The outer form spares the optimizer's "not empty" filter, which would score the messages a second time.
    words = events.select(*order, F.explode_outer("keywords").alias("w")).select(*order, strip(F.col("w")).alias("w")).where("w <> ''")
    counted = words.groupBy(F.lower("w").alias("key")).agg(
        F.count(F.lit(1)).alias("uses"), F.min_by("w", F.struct(*order)).alias("keyword"))
    level = (
        F.when(F.col("key").isin(*lexicon.high), "high").when(F.col("key").isin(*lexicon.medium), "medium")
        .otherwise("contextual")
    )
    return counted.orderBy(F.col("uses").desc(), "key").limit(max(1, k)).select(
        "keyword", "uses", level.alias("risk_class"))


def recent_events(events: DataFrame, n: int = 5, order: str = "event_id", key: str = "user_id") -> DataFrame:
    """Each user's newest high and medium events, newest first; lists hold at most ``n`` entries."""
    level = R.normalise_level(F.col("risk_level"))
    risky = events.withColumn("risk_level", level).where(F.col("risk_level").isin("high", "medium"))
    newest = top_n(risky, [key], [F.col("ts").desc(), F.col(order).desc()], n)
    entry = F.struct("rn", "ts", "risk_level", "keywords")
    return newest.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("events"))


def progress_report(events: DataFrame, key: str = "user_id") -> DataFrame:
    """A21."""
    level = R.normalise_level(F.col("risk_level"))
    return events.groupBy(key).agg(
        F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"),
        *[F.count_if(level == name).alias(name) for name in LEVELS],
    )


def latest_level(events: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Newest level per user."""
    return events.groupBy("user_id").agg(F.max_by("risk_level", F.struct(*order)).alias("risk_level"))
