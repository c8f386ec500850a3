"""Scoring of competing answers and the roll-ups over the consensus log.

``candidates`` rows are (item, provider, priority, content); an item has as many rows as there are providers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.text import WS, json_map, strip
from chatlake.schemas import SCORES_JSON, TIMES_JSON, TOKENS_JSON

NEUTRAL_SCORE = 50.0
SINGLE_SCORE = 100.0


def ranked(candidates: DataFrame) -> DataFrame:
    """Candidates of an item numbered by explicit provider priority, which also breaks ties."""
    w = Window.partitionBy("item").orderBy("priority", "provider")
    return candidates.withColumn("candidate_no", F.row_number().over(w))


def label_of(candidate_no: Column, evaluator_no: Column) -> Column:
    """M1: letter an evaluator sees for a candidate; its own answer has none."""
    shown = F.when(candidate_no < evaluator_no, candidate_no).when(candidate_no > evaluator_no, candidate_no - 1)
    return F.char(F.lit(64) + shown)


def candidate_of(label: Column, evaluator_no: Column) -> Column:
    """M3: number of the candidate behind a letter."""
    shown = F.ascii(label) - 64
    return F.when(shown < evaluator_no, shown).otherwise(shown + 1)


def parse_scores(raw: Column, labels: Column) -> Column:
    """M2: MAP<label, score> from an evaluation text: JSON first, ``label: number`` for what it lacks."""
    text = strip(raw)
    fenced = F.regexp_extract(text, rf"(?s)```(?:json)?[{WS}]*(\{{.*?\}})[{WS}]*```", 1)
    braces = F.regexp_extract(text, r"(\{[^{}]+\})", 1)
    body = F.when(fenced != "", fenced).when(F.startswith(text, F.lit("{")) | (braces == ""), text).otherwise(braces)
    parsed = json_map(body)
    spoken = rf"([A-Z])[\"']?[{WS}]*:[{WS}]*(\d+(?:\.\d+)?)"
    letters = F.regexp_extract_all(raw, F.lit(spoken), F.lit(1))
    numbers = F.regexp_extract_all(raw, F.lit(spoken), F.lit(2))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))

    def entry(label: Column) -> Column:
        quoted = F.get(numbers, (F.array_position(letters, label) - 1).cast("int")).try_cast("double")
        score = F.coalesce(F.try_element_at(parsed, label).try_cast("double"), quoted)
        return F.struct(label.alias("key"), F.when(score.isNotNull(), clamp(score)).alias("value"))

    return F.map_from_entries(F.filter(F.transform(labels, entry), lambda e: e["value"].isNotNull()))


def letters(n: Column) -> Column:
    """The first ``n`` labels."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.char(F.lit(64) + i))).otherwise(
        F.expr("cast(array() AS ARRAY<STRING>)"))


def received_scores(candidates: DataFrame, evaluations: DataFrame) -> DataFrame:
    """M1-M3: (item, candidate_no, score) per parsed label of each (item, evaluator, raw, success) row.

    Labels are arithmetic on candidate numbers, so no candidate x evaluator pairs are built.
    """
    order = ranked(candidates).select("item", "provider", "candidate_no")
    sizes = order.groupBy("item").agg(F.max("candidate_no").alias("n"))
    known = evaluations.where(F.coalesce("success", F.lit(True))).join(
        order.select("item", F.col("provider").alias("evaluator"), F.col("candidate_no").alias("evaluator_no")),
        ["item", "evaluator"]).join(sizes, "item")
    labels = letters((F.col("n") - 1).cast("int"))
    parsed = known.select(
        "item", "evaluator_no", F.explode_outer(parse_scores(F.col("raw"), labels)).alias("label", "score"),
    ).where(F.col("label").isNotNull())
    return parsed.select("item", candidate_of(F.col("label"), F.col("evaluator_no")).alias("candidate_no"), "score")


def aggregate(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean score per candidate; 50 without any, unknown candidates ignored."""
    means = scores.groupBy("item", "candidate_no").agg(
        F.avg("score").alias("mean"), F.count("score").alias("received"))
    return ranked(candidates).join(means, ["item", "candidate_no"], "left").withColumn(
        "score", F.coalesce("mean", F.lit(NEUTRAL_SCORE))).withColumn("received", F.coalesce("received", F.lit(0))).drop("mean")


def best(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """M5 / K4: the winner per item.

    One candidate wins with 100 unevaluated; without any score the first candidate wins with 50, because
    every candidate then has the neutral score and the lowest number breaks the tie.
    """
    scored = aggregate(candidates, scores)
    rank = F.struct("score", -F.col("candidate_no"))
    return scored.groupBy("item").agg(
        F.max_by("provider", rank).alias("best_provider"), F.max_by("content", rank).alias("best_response"),
        F.max("score").alias("top"), F.count(F.lit(1)).alias("providers_used"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "score")))).alias("all_scores"),
    ).select("item", "best_provider", "best_response",
             F.when(F.col("providers_used") == 1, F.lit(SINGLE_SCORE)).otherwise(F.col("top")).alias("best_score"),
             "providers_used",
             F.when(F.col("providers_used") == 1, F.transform_values("all_scores", lambda k, v: F.lit(SINGLE_SCORE)))
             .otherwise(F.col("all_scores")).alias("all_scores"))


def usage_maps(calls: DataFrame) -> DataFrame:
    """M6: per item, token usage of providers that used any and the times of all of them."""
    used = F.when(F.col("total_tokens") > 0, F.struct(
        F.col("provider").alias("key"),
        F.struct(F.col("prompt_tokens").alias("prompt"), F.col("completion_tokens").alias("completion"),
                 F.col("total_tokens").alias("total")).alias("value")))
    times = F.struct(F.col("provider").alias("key"), F.struct(
        F.round(F.coalesce("gen_ms", F.lit(0.0)), 0).alias("gen_ms"),
        F.round(F.coalesce("eval_ms", F.lit(0.0)), 0).alias("eval_ms")).alias("value"))
    return calls.groupBy("item").agg(
        F.map_from_entries(F.array_sort(F.collect_list(used))).alias("token_usage"),
        F.map_from_entries(F.array_sort(F.collect_list(times))).alias("provider_times"))


def summary(runs: DataFrame) -> DataFrame:
    """Zeros where nothing ran."""
    return runs.agg(
        F.count(F.lit(1)).alias("total_evaluations"),
        F.coalesce(F.round(F.avg("total_time_ms"), 0), F.lit(0.0)).alias("avg_total_time_ms"),
        F.coalesce(F.round(F.avg(_exact("best_score")), 1), F.lit(0)).cast("double").alias("avg_best_score"),
    )


def _exact(name: str) -> Column:
    """Averages of scores run on decimals, so they do not depend on the order of addition."""
    return F.col(name).cast("DECIMAL(18,6)")


def provider_wins(runs: DataFrame) -> DataFrame:
    """A14."""
    wins = runs.groupBy(F.col("best_provider").alias("provider")).agg(F.count(F.lit(1)).alias("wins"))
    total = wins.agg(F.sum("wins").alias("n")).select("n").scalar()
    return wins.withColumn("share", F.round(F.col("wins") / total, 3))


def _entries(runs: DataFrame, column: str, schema: str, value: str) -> DataFrame:
    """One row per provider of a JSON map; the outer form keeps the JSON from being parsed again for a filter."""
    rows = runs.select(F.explode_outer(json_map(F.col(column), schema)).alias("provider", value))
    return rows.where(F.col("provider").isNotNull())


def provider_scores(runs: DataFrame) -> DataFrame:
    """A15."""
    scores = _entries(runs, "all_scores", SCORES_JSON, "score")
    return scores.groupBy("provider").agg(
        F.round(F.avg(F.col("score").cast("DECIMAL(18,6)")), 1).cast("double").alias("avg_score"),
        F.count("score").alias("evaluations"))


def provider_tokens(runs: DataFrame) -> DataFrame:
    """A16."""
    usage = _entries(runs, "token_usage", TOKENS_JSON, "u")
    total = lambda field: F.sum(F.coalesce(F.col("u")[field], F.lit(0)))
    return usage.groupBy("provider").agg(
        total("prompt").alias("total_prompt"), total("completion").alias("total_completion"),
        total("total").alias("total_tokens"))


def provider_times(runs: DataFrame) -> DataFrame:
    """Means over positive times only; providers without any are left out."""
    t = _entries(runs, "provider_times", TIMES_JSON, "t")
    gen, ev = F.col("t")["gen_ms"], F.col("t")["eval_ms"]
    mean = lambda c: F.coalesce(F.round(F.avg(F.when(c > 0, c)), 0), F.lit(0.0))
    return t.groupBy("provider").agg(
        mean(gen).alias("avg_gen_ms"), mean(ev).alias("avg_eval_ms"),
        F.count_if(gen > 0).alias("gen_count"), F.count_if(ev > 0).alias("eval_count"),
    ).where((F.col("gen_count") > 0) | (F.col("eval_count") > 0))


def phase_times(runs: DataFrame) -> DataFrame:
    """One row per phase."""
    one = runs.agg(
        F.coalesce(F.round(F.avg("generation_time_ms"), 0), F.lit(0.0)).alias("g"),
        F.count("generation_time_ms").alias("gn"),
        F.coalesce(F.round(F.avg("evaluation_time_ms"), 0), F.lit(0.0)).alias("e"),
        F.count("evaluation_time_ms").alias("en"))
    return one.select(F.stack(F.lit(2), F.lit("generation"), "g", "gn", F.lit("evaluation"), "e", "en")
                      .alias("phase", "avg_ms", "runs"))


def daily_trend(runs: DataFrame) -> DataFrame:
    """Per day, runs, mean best score and wins per provider.

    A provider group without any score counts as zero; within a group the mean over its scored rows is
    weighted by all its rows.
    """
    groups = runs.groupBy(F.to_date("ts").alias("day"), F.col("best_provider").alias("provider")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(_exact("best_score")).alias("mean"))
    weighted = F.coalesce("mean", F.lit(0)).cast("double") * F.col("n")
    return groups.groupBy("day").agg(
        F.sum("n").alias("evaluations"),
        F.round(F.sum(weighted.cast("DECIMAL(28,8)")) / F.sum("n"), 1).cast("double").alias("avg_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "n")))).alias("best_provider_counts"))


def recent_timings(runs: DataFrame, n: int = 200, order: str = "id") -> DataFrame:
    """The first runs by time, rounded, absent values as zero."""
    value = lambda c, name: F.coalesce(F.round(c, 0), F.lit(0.0)).alias(name)
    return runs.orderBy("ts", order).limit(n).select(
        order, "ts", value("generation_time_ms", "gen_ms"), value("evaluation_time_ms", "eval_ms"),
        value("total_time_ms", "total_ms"), "best_provider")
