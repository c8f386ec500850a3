"""Operation latencies, error counts and alert throttling."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.operators.segments import numbered, time_segment, top_n
from chatlake.session import materialise

SLOW_SECONDS = 1.0
# Errors of a severity between two alerts.
ERROR_THRESHOLDS = {"critical": 1, "high": 3, "medium": 10, "low": 50}


def operation_profile(calls: DataFrame, *, last: int = 100, slow: float = SLOW_SECONDS, order: str = "event_id",
                      key: str = "operation") -> DataFrame:
    """Latency profile of each operation's last calls, with recommendations."""
    kept = top_n(calls, [key], [F.col("ts").desc(), F.col(order).desc()], last)
    profile = kept.groupBy(key).agg(
        F.count(F.lit(1)).alias("call_count"), F.avg("seconds").alias("avg_seconds"),
        F.max("seconds").alias("max_seconds"), F.min("seconds").alias("min_seconds"),
        F.avg((F.col("status") == "error").cast("double")).alias("error_rate"),
        F.count_if(F.col("seconds") > slow).alias("slow_count"),
    )
    return profile.withColumn("recommendations", F.array_compact(F.array(
        F.when(F.col("avg_seconds") > 0.5, "high average time"),
        F.when(F.col("error_rate") > 0.1, "high error rate"),
        F.when(F.col("slow_count") > 10, "many slow calls"),
    )))


def overall_profile(calls: DataFrame, as_of: dt.datetime, *, last: int = 1000, slow: float = SLOW_SECONDS,
                    order: str = "event_id") -> DataFrame:
    """Summary of the last calls of all operations."""
    kept = calls.orderBy(F.col("ts").desc(), F.col(order).desc()).limit(last)
    recent = F.col("ts") > F.lit(as_of - dt.timedelta(hours=1)).cast("timestamp_ntz")
    return kept.agg(
        F.count(F.lit(1)).alias("total_calls"), F.count_if(recent).alias("recent_calls"),
        F.avg("seconds").alias("avg_seconds"), F.count_if(F.col("seconds") > slow).alias("slow_count"),
        F.avg((F.col("seconds") > slow).cast("double")).alias("slow_rate"),
    )


def slowest(calls: DataFrame, *, over: float = SLOW_SECONDS, n: int = 10, order: str = "event_id") -> DataFrame:
    """A26."""
    return calls.where(F.col("seconds") > over).orderBy(F.col("seconds").desc(), order).limit(n)


def operation_log(calls: DataFrame, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    """Calls of the last hours; `overall_profile` of the same frame is the summary."""
    return calls.where(F.col("ts") > F.lit(as_of - dt.timedelta(hours=hours)).cast("timestamp_ntz"))


def error_summary(errors: DataFrame, as_of: dt.datetime | None = None, hours: int = 24) -> DataFrame:
    """Counts by category, by severity, by both and in total, from one expansion of the rows."""
    if as_of is not None:
        errors = errors.where(F.col("ts") > F.lit(as_of - dt.timedelta(hours=hours)).cast("timestamp_ntz"))
    both = errors.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))
    grouped = both.groupingSets(
        [["category"], ["severity"], ["category", "severity"], []], "category", "severity",
    ).agg(F.sum("n").alias("errors"), F.grouping_id().alias("level"))
    scope = F.when(F.col("level") == 0, "category_severity").when(F.col("level") == 1, "category").when(
        F.col("level") == 2, "severity").otherwise("total")
    return grouped.select(scope.alias("scope"), "category", "severity", F.coalesce("errors", F.lit(0)).alias("errors"))


def error_alerts(errors: DataFrame, thresholds: dict[str, int] | None = None, *, order: str = "event_id",
                 unit: str = "minute") -> DataFrame:
    """The error whose running number within its severity is a multiple of the severity's threshold."""
    limits = thresholds or ERROR_THRESHOLDS
    every: Column = F.lit(None).cast("bigint")
    for severity, n in limits.items():
        every = F.when(F.col("severity") == severity, F.lit(n).cast("bigint")).otherwise(every)
    counted = numbered(errors, ["severity"], time_segment("ts", unit), [F.col("ts"), F.col(order)], "error_no")
    return counted.where(F.col("error_no") % every == 0)


def processing_counters(rows: DataFrame, *, last: int = 10_000, slow: float = 10.0, order: str = "event_id") -> DataFrame:
    """Slow replies, fallbacks and errors among the newest rows."""
    return rows.orderBy(F.col("ts").desc(), F.col(order).desc()).limit(last).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("seconds") > slow).alias("slow"),
        F.count_if("fallback").alias("fallbacks"), F.count_if("failed").alias("errors"),
    )


#: Alerts of one slice, and slices (then ranges of slices) that are combined at once.
SLICE_ROWS, FAN = 4096, 32


def _after(upto: np.ndarray, leaves: np.ndarray, carry: int | None, gap: int) -> int | None:
    """A step function applied: the last kept alert after a slice, given the one before it (None: none yet)."""
    at = int(np.searchsorted(upto, -(2**62) if carry is None else carry + gap))
    return int(leaves[at]) if at < len(upto) else carry


def _steps(us: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function of a slice of sorted alerts: ``upto``, the largest earliest-allowed time of a step, and ``leaves``.

    What was kept before lies before the slice, so only alerts within one cooldown of its start, and the next, can be kept first.
    """
    nxt = np.searchsorted(us, us + gap)
    last = us.copy()
    for i in range(len(us) - 1, -1, -1):
        if nxt[i] < len(us):
            last[i] = last[nxt[i]]
    heads = np.arange(min(np.searchsorted(us, us[0] + gap) + 1, len(us)))
    keep = np.ones(len(heads), dtype=bool)
    keep[:-1] = last[heads[:-1]] != last[heads[1:]]
    return us[heads[keep]], last[heads[keep]]


def _then(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function of two neighbouring ranges: steps of the first go on through the second; times beyond them see the second alone."""
    on = np.array([_after(*second, int(x), gap) for x in first[1]], dtype=np.int64)
    more = second[0] > first[0][-1]
    upto, leaves = np.concatenate((first[0], second[0][more])), np.concatenate((on, second[1][more]))
    keep = np.append(leaves[:-1] != leaves[1:], True)
    return upto[keep], leaves[keep]


def throttle(alerts: DataFrame, key: str, cooldown: dt.timedelta, *, ts: str = "ts", order: str = "event_id",
             segment: dt.timedelta | None = None, rows: int = SLICE_ROWS, fan: int = FAN) -> DataFrame:
    """Keep an alert when at least the cooldown has passed since the last *kept* alert of its key.

    Whether an alert is kept depends on what was kept before, which no window expresses. A key's alerts are cut into slices of
    ``rows`` alerts; each slice is summarised by a step function (last kept alert before the slice -> last kept alert after it).
    Composing step functions is associative, so ``fan`` neighbouring ones are combined into one, and again until one is left for a
    key; on the way back each range hands its entry state down to its parts. At last every slice is replayed from its entry state.
    No group holds more than a slice's alerts or ``fan`` functions, and a function has at most a step for each alert within one
    cooldown of its start. ``segment`` is the time over which a key's alerts are numbered at once.
    """
    gap = int(cooldown.total_seconds() * 1_000_000)
    if gap <= 0:
        return alerts
    width = int((segment or max(cooldown * 24, dt.timedelta(hours=1))).total_seconds() * 1_000_000)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    # Of alerts at one instant only the first can be kept.
    firsts = alerts.groupBy(F.col(key).alias("k"), micros.alias("us")).agg(F.min(order).alias("first"))
    placed = numbered(firsts, ["k"], F.floor(F.col("us") / F.lit(width)), [F.col("us")], name="n")
    placed = materialise(placed.select("k", "us", "first", F.floor((F.col("n") - 1) / rows).cast("bigint").alias("slice")), "throttle-slices")
    key_type, order_type = (alerts.schema[c].dataType.simpleString() for c in (key, order))
    function = f"k {key_type}, slice bigint, upto bigint, leaves bigint"

    def frame(k, number: int, steps: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"k": k, "slice": number, "upto": steps[0], "leaves": steps[1]})

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        return frame(pdf["k"].iloc[0], pdf["slice"].iloc[0], _steps(np.sort(pdf["us"].to_numpy()), gap))

    def parts(pdf: pd.DataFrame) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        for number, part in pdf.sort_values(["slice", "upto"]).groupby("slice", sort=True):
            yield number, (part["upto"].to_numpy(), part["leaves"].to_numpy())

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for _, steps in parts(pdf):
            whole = steps if whole is None else _then(whole, steps, gap)
        return frame(pdf["k"].iloc[0], pdf["slice"].iloc[0] // fan, whole)

    def hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
        entry, out = pdf["entry"].iloc[0], []
        carry = None if pd.isna(entry) else int(entry)
        for number, steps in parts(pdf):
            out.append((pdf["k"].iloc[0], number, carry))
            carry = _after(*steps, carry, gap)
        found = pd.DataFrame(out, columns=["k", "slice", "entry"])
        found["entry"] = found["entry"].astype("Int64")
        return found

    highest = placed.agg(F.max("slice")).first()[0] or 0
    levels = [placed.groupBy("k", "slice").applyInPandas(summarise, function)] if highest else []
    levels = [materialise(x, "throttle-steps") for x in levels]
    while highest >= fan:
        highest //= fan
        levels.append(materialise(levels[-1].groupBy("k", F.floor(F.col("slice") / fan)).applyInPandas(combine, function), "throttle-steps"))

    def with_entry(frame: DataFrame, slice_of: Column, entries: DataFrame) -> DataFrame:
        known = entries.select(F.col("k").alias("__k"), F.col("slice").alias("__slice"), "entry")
        return frame.withColumn("__of", slice_of).join(known, F.col("k").eqNullSafe(F.col("__k")) & (F.col("__of") == F.col("__slice")), "left").drop("__k", "__slice", "__of")

    # Before the first range of a key nothing was kept.
    none = F.lit(None).cast("bigint").alias("entry")
    entries = placed.select("k", F.lit(0).cast("bigint").alias("slice"), none).limit(0)
    for steps in reversed(levels):
        known = with_entry(steps, F.floor(F.col("slice") / fan), entries)
        entries = materialise(known.groupBy("k", F.floor(F.col("slice") / fan)).applyInPandas(hand_down, f"k {key_type}, slice bigint, entry bigint"), "throttle-entries")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("us")
        us, entry = pdf["us"].to_numpy(), pdf["entry"].iloc[0]
        at = 0 if pd.isna(entry) else int(np.searchsorted(us, int(entry) + gap))
        kept = []
        while at < len(us):
            kept.append(at)
            at = int(np.searchsorted(us, us[at] + gap))
        return pdf.iloc[kept][["k", "us", "first"]]

    joined = with_entry(placed, F.col("slice"), entries).select("k", "slice", "us", "first", "entry")
    kept = joined.groupBy("k", "slice").applyInPandas(replay, f"k {key_type}, us bigint, first {order_type}")
    return alerts.join(
        kept, alerts[key].eqNullSafe(kept["k"]) & (micros == kept["us"]) & (alerts[order] == kept["first"]), "left_semi")
