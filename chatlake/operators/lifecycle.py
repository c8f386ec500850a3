"""Follow-ups, check-ins, sessions, registration and erasure."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.risk import score_band
from chatlake.functions.text import strip
from chatlake.operators.monitoring import throttle
from chatlake.operators.segments import previous, time_segment

# Follow-up days after the first interaction.
FOLLOW_UP_DAYS = (1, 3, 7, 14, 30)
# Inactivity limits, batch size and cooldown of check-ins.
INACTIVE_RISK_DAYS, INACTIVE_DAYS, MAX_CHECKINS, CHECKIN_COOLDOWN_DAYS = 3, 7, 10, 7
# Session limit, warning distance, verification wait, context life.
SESSION_DAYS, WARN_DAYS, SUMMARY_WAIT_SECONDS, CONTEXT_DAYS = 7, 1, 300, 90


def _at(moment: dt.datetime) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def _days(n: Column) -> Column:
    return F.make_dt_interval(n)


def follow_ups(activity: DataFrame, state: DataFrame, as_of: dt.datetime) -> DataFrame:
    """L1: next due date per user, counted from the first interaction.

    ``state`` rows are (user_id, due_at, last_days). A due date still ahead stays; else the search starts
    after the last interval used and takes the first date in the future.
    """
    firsts = activity.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    rows = firsts.join(state.select("user_id", "due_at", "last_days"), "user_id", "left")
    days = F.array(*[F.lit(d) for d in FOLLOW_UP_DAYS])
    start = F.least(F.coalesce(F.array_position(days, F.col("last_days")), F.lit(0)), F.lit(len(FOLLOW_UP_DAYS) - 1))
    open_days = F.slice(days, (start + 1).cast("int"), F.lit(len(FOLLOW_UP_DAYS)))
    ahead = F.get(F.filter(open_days, lambda d: F.col("first_ts") + _days(d) > _at(as_of)), F.lit(0))
    keeps = F.coalesce(F.col("due_at") > _at(as_of), F.lit(False))
    return rows.withColumn("__next", ahead).select(
        "user_id", "first_ts",
        F.when(keeps, F.col("due_at")).otherwise(F.col("first_ts") + _days(F.col("__next"))).alias("due_at"),
        F.when(keeps, F.col("last_days")).otherwise(F.coalesce("__next", "last_days")).alias("last_days"),
        F.when(keeps, "kept").when(F.col("__next").isNotNull(), "scheduled").otherwise("none").alias("outcome"),
    )


def due(queue: DataFrame, as_of: dt.datetime) -> DataFrame:
    """L2."""
    return queue.where(F.col("due_at") <= _at(as_of))


def follow_up_status(queue: DataFrame, as_of: dt.datetime) -> DataFrame:
    """L3: time left and intervals still to come."""
    left = F.greatest(F.lit(0), F.timestamp_diff("SECOND", _at(as_of), F.col("due_at")))
    days = F.array(*[F.lit(d) for d in FOLLOW_UP_DAYS])
    used = F.coalesce(F.array_position(days, F.col("last_days")), F.lit(0)).cast("int")
    return queue.select(
        "user_id", "due_at", F.floor(left / 86400).alias("days_left"), F.floor(F.pmod(left, F.lit(86400)) / 3600).alias("hours_left"),
        F.floor(F.pmod(left, F.lit(3600)) / 60).alias("minutes_left"),
        F.slice(days, used + 1, F.lit(len(FOLLOW_UP_DAYS))).alias("remaining_days"))


def inactive_users(activity: DataFrame, codes: DataFrame, as_of: dt.datetime, days: int, limit: int | None = None) -> DataFrame:
    """J1 + HAVING: registered users whose last message is older than ``days``, longest silence first.

    Several verified codes of a user do not change the maximum, so the join is a semi join; users are
    reduced to one row before it.
    """
    last = activity.groupBy("user_id").agg(F.max("ts").alias("last_active")).where(
        F.col("last_active") < _at(as_of - dt.timedelta(days=days)))
    verified = codes.where(F.col("status") == "verified").select("user_id")
    rows = last.join(verified, "user_id", "left_semi")
    return rows.orderBy("last_active", "user_id").limit(limit) if limit else rows


def verified_activity(activity: DataFrame, codes: DataFrame) -> DataFrame:
    """J1 as the inner join: a row repeats for every verified code of its user."""
    return activity.join(codes.where(F.col("status") == "verified").select("user_id", "code"), "user_id")


def check_ins(activity: DataFrame, codes: DataFrame, levels: DataFrame, cooling: DataFrame, as_of: dt.datetime, *,
              limit: int = MAX_CHECKINS) -> DataFrame:
    """L4: risky users after a short silence first, then anyone after a long one, up to ``limit``.

    ``levels`` rows are (user_id, risk_level), ``cooling`` holds users with a recent check-in. Candidates per
    phase are the ``2 * limit`` longest silences, taken before the other conditions.
    """
    silence = F.timestamp_diff("SECOND", F.col("last_active"), _at(as_of))

    def phase(number: int, days: int) -> DataFrame:
        rows = inactive_users(activity, codes, as_of, days, limit * 2)
        rows = rows.join(cooling.select("user_id"), "user_id", "left_anti").join(
            levels.select("user_id", "risk_level"), "user_id", "left")
        return rows.select(
            "user_id", "last_active", F.coalesce("risk_level", F.lit("general")).alias("risk_level"),
            F.floor(silence / 86400).alias("days_inactive"), F.lit(number).alias("phase"))

    risky = phase(1, INACTIVE_RISK_DAYS).where(F.col("risk_level").isin("high", "medium"))
    risky = risky.orderBy("last_active", "user_id").limit(limit)
    others = phase(2, INACTIVE_DAYS).join(risky.select("user_id"), "user_id", "left_anti")
    return risky.unionByName(others).orderBy("phase", "last_active", "user_id").limit(limit)


def erase(tables: dict[str, DataFrame], requests: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """L6 / IO11: the tables without the requested users' rows, and the number of rows removed per table and user."""
    users = requests.select("user_id").distinct()
    kept = {name: df.join(users, "user_id", "left_anti") for name, df in tables.items()}
    counts = None
    for name, df in tables.items():
        part = df.join(users, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("removed"))
        part = part.select(F.lit(name).alias("table_name"), "user_id", "removed")
        counts = part if counts is None else counts.unionByName(part)
    return kept, counts


def consent_after(consent: DataFrame, requests: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Consent rows with revocation and deletion times of the requested users; new users get a row."""
    asked = requests.select("user_id").distinct().withColumn("__asked", F.lit(True))
    rows = consent.join(asked, "user_id", "full_outer")
    when = lambda c: F.when(F.col("__asked"), _at(as_of)).otherwise(F.col(c)).alias(c)
    return rows.select("user_id", "consent_given_at", when("consent_revoked_at"), when("data_deleted_at"), when("updated_at"))


def import_codes(codes: DataFrame, incoming: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected rows with a reason); of equal new codes the first by form text enters.

    ``incoming`` rows are (code, full_data) with full_data as JSON text.
    """
    trimmed = incoming.select(strip(F.col("code")).alias("code"), "full_data")
    good = trimmed.where(F.col("code").rlike(r"^\d{6}$"))
    bad = trimmed.where(~F.coalesce(F.col("code").rlike(r"^\d{6}$"), F.lit(False))).select("code", F.lit("invalid_code").alias("reason"))
    known = codes.select("code").distinct()
    taken = good.join(known, "code", "left_semi").select("code", F.lit("duplicate").alias("reason"))
    fresh = good.join(known, "code", "left_anti").groupBy("code").agg(
        F.min("full_data").alias("full_data"), F.count(F.lit(1)).alias("n"))
    repeats = fresh.where("n > 1").select("code", F.explode(F.array_repeat(F.lit("duplicate"), (F.col("n") - 1).cast("int"))).alias("reason"))
    form = F.concat(
        F.lit('{"full_data":'), F.coalesce("full_data", F.lit("{}")),
        F.lit(f',"ai_summary":"","processed_at":"{as_of.isoformat()}","ai_processed_at":null}}'))
    rows = fresh.select(
        "code", F.lit(None).cast("string").alias("user_id"), _at(as_of).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("verified_at"), F.lit("pending").alias("status"), form.alias("form_data"))
    return rows, bad.unionByName(taken).unionByName(repeats)


def verification_outcomes(codes: DataFrame, requests: DataFrame, as_of: dt.datetime) -> DataFrame:
    """(user_id, code, outcome, minutes_left) per request; the first user to ask for a code gets it.

    Outcomes: invalid, waiting (no summary yet and less than five minutes old), verified.
    """
    first = requests.groupBy("code").agg(F.min("user_id").alias("__winner"))
    pending = codes.where(F.col("status") == "pending").select("code", "form_data")
    rows = requests.join(first, "code").join(pending, "code", "left")
    summary = F.coalesce(F.get_json_object("form_data", "$.ai_summary"), F.lit(""))
    processed = F.get_json_object("form_data", "$.processed_at").try_cast("timestamp_ntz")
    age = F.timestamp_diff("MICROSECOND", processed, _at(as_of)) / 1_000_000
    open_ = F.col("form_data").isNotNull() & (F.col("user_id") == F.col("__winner"))
    waiting = (summary == "") & F.coalesce(age < SUMMARY_WAIT_SECONDS, F.lit(False))
    return rows.select(
        "user_id", "code", F.when(~open_, "invalid").when(waiting, "waiting").otherwise("verified").alias("outcome"),
        F.when(open_ & waiting, F.floor((SUMMARY_WAIT_SECONDS - age) / 60).cast("int") + 1).alias("minutes_left"))


def codes_after(codes: DataFrame, outcomes: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The code table with verified codes assigned."""
    done = outcomes.where(F.col("outcome") == "verified").select("code", F.col("user_id").alias("__user"))
    rows = codes.join(done, "code", "left")
    hit = F.col("__user").isNotNull()
    return rows.select(
        "code", F.coalesce("__user", "user_id").alias("user_id"), "created_at",
        F.when(hit, _at(as_of)).otherwise(F.col("verified_at")).alias("verified_at"),
        F.when(hit, "verified").otherwise(F.col("status")).alias("status"), "form_data")


def form_lines(codes: DataFrame) -> DataFrame:
    """R8 per substance of each form: (code, substance, score, band)."""
    scores = F.from_json(F.coalesce(F.get_json_object("form_data", "$.full_data.assistScores"),
                                    F.get_json_object("form_data", "$.assistScores")), "MAP<STRING, DOUBLE>")
    rows = codes.select("code", F.explode_outer(scores).alias("substance", "score")).where(F.col("substance").isNotNull())
    return rows.withColumn("band", score_band(F.col("substance"), F.col("score")))


def form_summary(codes: DataFrame) -> DataFrame:
    """One text per form; a form lists a handful of substances."""
    scores = F.from_json(F.coalesce(F.get_json_object("form_data", "$.full_data.assistScores"),
                                    F.get_json_object("form_data", "$.assistScores")), "MAP<STRING, DOUBLE>")
    overall = F.coalesce(F.get_json_object("form_data", "$.full_data.riskAssessment.overallRisk"),
                         F.get_json_object("form_data", "$.riskAssessment.overallRisk"))
    line = lambda e: F.format_string("- %s: %.0f points (%s)", e["key"], e["value"], score_band(e["key"], e["value"]))
    return codes.select("code", F.concat_ws(
        "\n", F.array_join(F.transform(F.map_entries(scores), line), "\n"),
        F.when(overall.isNotNull(), F.concat(F.lit("overall risk: "), overall))).alias("summary"))


def update_forms(codes: DataFrame, summaries: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Set the summary and its time inside the stored JSON; unknown codes change nothing.

    Raw values of the other fields are kept by splicing JSON text instead of re-typing it.
    """
    new = summaries.select("code", F.col("ai_summary").alias("__summary"))
    rows = codes.join(new, "code", "left")
    quoted = F.regexp_replace(F.to_json(F.struct(F.col("__summary").alias("v"))), r'^\{"v":|\}$', "")
    fields = F.map_filter(F.coalesce(F.from_json("form_data", "MAP<STRING, STRING>"), F.expr("cast(map() AS MAP<STRING, STRING>)")),
                          lambda k, v: ~k.isin("ai_summary", "ai_processed_at"))
    kept = F.transform(F.map_entries(fields), lambda e: F.concat(
        F.lit('"'), e["key"], F.lit('":'),
        F.when(e["value"].isNull(), F.lit("null"))
        .when(e["value"].rlike(r"^[\[{]"), e["value"])
        .when(e["value"].rlike(r"^(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false)$"), e["value"])
        .otherwise(F.regexp_replace(F.to_json(F.struct(e["value"].alias("v"))), r'^\{"v":|\}$', ""))))
    added = F.array(F.concat(F.lit('"ai_summary":'), quoted), F.lit(f'"ai_processed_at":"{as_of.isoformat()}"'))
    text = F.concat(F.lit("{"), F.array_join(F.concat(kept, added), ","), F.lit("}"))
    return rows.withColumn("form_data", F.when(F.col("__summary").isNotNull(), text).otherwise(F.col("form_data"))).drop("__summary")


def user_contexts(latest_forms: DataFrame, as_of: dt.datetime, days: int = CONTEXT_DAYS) -> DataFrame:
    """Contexts of users' newest forms within their life; ``latest_forms`` comes from `analytics.latest_form`."""
    rows = latest_forms.where(F.coalesce("ai_summary", F.lit("")) != "")
    return rows.where(F.col("verified_at") >= _at(as_of - dt.timedelta(days=days))).select(
        "user_id", F.col("ai_summary").alias("context"), F.col("verified_at").alias("created_at"))


def with_sessions(activity: DataFrame, *, order: str = "id", days: int = SESSION_DAYS, unit: str = "day") -> DataFrame:
    """Number each user's sessions; a new one starts when the gap is longer than the limit.

    Starts within a slice follow from its own rows; whether a slice's first row starts a session follows from the last
    time of the slice before. So one summary per slice (first and last time, starts inside) numbers all sessions.
    """
    limit = F.expr(f"INTERVAL {days} DAYS")
    row = Window.partitionBy("user_id", "__slice").orderBy("ts", order)
    rows = activity.withColumn("__slice", time_segment("ts", unit)).withColumn("__near", F.lag("ts").over(row))
    rows = rows.withColumn("__start", (F.col("ts") - F.col("__near") > limit).cast("bigint"))
    slices = rows.groupBy("user_id", "__slice").agg(F.min("ts").alias("__low"), F.max("ts").alias("__high"), F.coalesce(F.sum("__start"), F.lit(0)).alias("__inside"))
    by_user = Window.partitionBy("user_id").orderBy("__slice")
    before = F.lag("__high").over(by_user)
    opened = slices.withColumn("__before", before).withColumn(
        "__opens", (F.col("__before").isNull() | (F.col("__low") - F.col("__before") > limit)).cast("bigint"))
    total = F.sum(F.col("__inside") + F.col("__opens")).over(by_user.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__inside")
    known = opened.select(F.col("user_id").alias("__user"), F.col("__slice").alias("__of"), "__before", total.alias("__offset"))
    met = rows.join(known, F.col("user_id").eqNullSafe(F.col("__user")) & (F.col("__slice") == F.col("__of")))
    inside = F.coalesce(F.sum("__start").over(row.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    previous_ts = F.coalesce("__near", "__before")
    starts = (previous_ts.isNull() | (F.col("ts") - previous_ts > limit)).cast("bigint")
    numbered = met.withColumns({"previous_ts": previous_ts, "starts": starts, "session_no": F.col("__offset") + inside})
    return numbered.drop("__slice", "__near", "__start", "__user", "__of", "__before", "__offset")


def sessions(activity: DataFrame, **options) -> DataFrame:
    """One row per session."""
    return with_sessions(activity, **options).groupBy("user_id", "session_no").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("messages"))


def expiry_warnings(activity: DataFrame, *, order: str = "id", days: int = SESSION_DAYS, warn: int = WARN_DAYS) -> DataFrame:
    """Activity that came within a day of expiry (or later), at most one warning a day per user."""
    rows = previous(activity, ["user_id"], time_segment("ts", "day"), ["ts", order], {"ts": "previous_ts"})
    late = rows.where(F.col("ts") - F.col("previous_ts") > F.expr(f"INTERVAL {days - warn} DAYS"))
    return throttle(late, "user_id", dt.timedelta(days=1), order=order)
