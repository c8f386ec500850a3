"""Checked queries of M1-M6, A13-A20 and A29."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.operators import consensus as C
from chatlake.plans.registry import query
from chatlake.sources import adapters as S

RUNS = """b AS (SELECT event_id AS id, user_id, ts, event_type AS best_provider, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
 CAST(floor(value) AS BIGINT) AS v FROM events),
 runs AS (SELECT *, CASE WHEN k % 10 <> 0 THEN CAST(value AS DECIMAL(18,6)) END AS best_score, k * 10 AS gen,
 CASE WHEN k % 3 = 0 THEN 0 ELSE k * 2 END AS ev FROM b)"""


@query(f"""WITH {RUNS} SELECT count(*) AS total_evaluations, round(avg(CAST(gen + ev AS DOUBLE)), 0) AS avg_total_time_ms,
 CAST(round(CAST(sum(best_score) AS DOUBLE) / count(best_score), 1) AS DOUBLE) AS avg_best_score FROM runs""")
def consensus_summary(spark, sf):
    return C.summary(S.model_runs(spark, sf))


@query(f"""WITH {RUNS} SELECT best_provider AS provider, count(*) AS wins, round(count(*) / (SELECT count(*) FROM runs), 3) AS share FROM runs GROUP BY 1""")
def provider_wins(spark, sf):
    return C.provider_wins(S.model_runs(spark, sf))


@query(f"""WITH {RUNS}, s AS (SELECT best_provider AS provider, k AS score FROM runs UNION ALL SELECT 'peer', (k * 7) % 100 FROM runs)
 SELECT provider, round(CAST(sum(score) AS BIGINT) / count(*), 1) AS avg_score, count(*) AS evaluations FROM s GROUP BY 1""")
def provider_scores(spark, sf):
    return C.provider_scores(S.model_runs(spark, sf))


@query(f"""WITH {RUNS}, s AS (SELECT best_provider AS provider, v AS p, k AS c FROM runs UNION ALL SELECT 'peer', k, v FROM runs)
 SELECT provider, CAST(sum(p) AS BIGINT) AS total_prompt, CAST(sum(c) AS BIGINT) AS total_completion, CAST(sum(p + c) AS BIGINT) AS total_tokens FROM s GROUP BY 1""")
def provider_tokens(spark, sf):
    return C.provider_tokens(S.model_runs(spark, sf))


@query(f"""WITH {RUNS}, s AS (SELECT best_provider AS provider, gen AS g, ev AS e FROM runs UNION ALL
 SELECT 'peer', CASE WHEN k % 5 = 0 THEN 0 ELSE k END, gen FROM runs)
 SELECT provider, coalesce(round(avg(g) FILTER (WHERE g > 0), 0), 0) AS avg_gen_ms, coalesce(round(avg(e) FILTER (WHERE e > 0), 0), 0) AS avg_eval_ms,
 count(*) FILTER (WHERE g > 0) AS gen_count, count(*) FILTER (WHERE e > 0) AS eval_count FROM s GROUP BY 1""")
def provider_times(spark, sf):
    return C.provider_times(S.model_runs(spark, sf))


@query(f"""WITH {RUNS} SELECT 'generation' AS phase, round(avg(gen), 0) AS avg_ms, count(gen) AS runs FROM runs UNION ALL
 SELECT 'evaluation', round(avg(ev) FILTER (WHERE k % 4 <> 0), 0), count(*) FILTER (WHERE k % 4 <> 0) FROM runs""")
def phase_times(spark, sf):
    return C.phase_times(S.model_runs(spark, sf))


@query(f"""WITH {RUNS}, g AS (SELECT CAST(ts AS DATE) AS day, best_provider AS p, count(*) AS n,
 coalesce(CAST(sum(best_score) AS DOUBLE) / count(best_score), 0) AS m FROM runs GROUP BY 1, 2)
 SELECT day, CAST(sum(n) AS BIGINT) AS evaluations, round(CAST(sum(CAST(m * n AS DECIMAL(28,8))) AS DOUBLE) / sum(n), 1) AS avg_score,
 string_agg(p || '=' || CAST(n AS VARCHAR), ';' ORDER BY p) AS best_provider_counts FROM g GROUP BY 1""")
def consensus_trend(spark, sf):
    text = F.array_join(F.transform(F.map_entries("best_provider_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return C.daily_trend(S.model_runs(spark, sf)).withColumn("best_provider_counts", text)


@query(f"""WITH {RUNS} SELECT id, ts, CAST(gen AS DOUBLE) AS gen_ms, CAST(CASE WHEN k % 4 <> 0 THEN ev ELSE 0 END AS DOUBLE) AS eval_ms,
 CAST(gen + ev AS DOUBLE) AS total_ms, best_provider FROM runs ORDER BY ts, id LIMIT 200""")
def recent_timings(spark, sf):
    return C.recent_timings(S.model_runs(spark, sf))


_EVALS = """cand AS (SELECT conv_id AS item, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no,
 count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'assistant'),
 ev AS (SELECT item, turn, no, n, length(text) AS len, length(text) % 101 AS a, (length(text) * 7) % 130 AS b FROM cand),
 parsed AS (SELECT item, turn, no, n, len, 1 AS l, CAST(a AS DOUBLE) AS score FROM ev WHERE len % 5 <> 4 UNION ALL
 SELECT item, turn, no, n, len, 2, CAST(least(b, 100) AS DOUBLE) FROM ev WHERE len % 5 <> 4)"""


@query(f"""WITH {_EVALS} SELECT item, turn, string_agg(chr(CAST(64 + l AS INTEGER)) || '=' || CAST(score AS VARCHAR), ';' ORDER BY l) AS scores FROM parsed GROUP BY 1, 2""")
def consensus_parse(spark, sf):
    rows = S.evaluations(spark, sf).withColumn("s", C.parse_scores(F.col("raw"), C.letters(F.lit(2)))).where(F.size("s") > 0)
    text = F.array_join(F.transform(F.map_entries("s"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return rows.select("item", F.substring("evaluator", 2, 9).cast("bigint").alias("turn"), text.alias("scores"))


_AGG = f"""WITH {_EVALS}, recv AS (SELECT item, CASE WHEN l < no THEN l ELSE l + 1 END AS no, score FROM parsed WHERE len % 11 <> 0 AND l <= n - 1),
 agg AS (SELECT c.item, c.no, 'p' || CAST(c.turn AS VARCHAR) AS provider, c.text, coalesce(avg(r.score), 50.0) AS score, count(r.score) AS received, c.n
 FROM cand c LEFT JOIN recv r ON r.item = c.item AND r.no = c.no GROUP BY c.item, c.no, c.turn, c.text, c.n)"""


@query(_AGG + " SELECT item, provider, CAST(no AS INTEGER) AS candidate_no, round(score, 6) AS score, received FROM agg")
def consensus_scores(spark, sf):
    candidates = S.candidates(spark, sf)
    rows = C.aggregate(candidates, C.received_scores(candidates, S.evaluations(spark, sf)))
    return rows.select("item", "provider", "candidate_no", F.round("score", 6).alias("score"), "received")


@query(_AGG + """, r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, no) AS rk FROM agg)
 SELECT item, provider AS best_provider, text AS best_response, CASE WHEN n = 1 THEN 100.0 ELSE round(score, 6) END AS best_score,
 n AS providers_used FROM r WHERE rk = 1""")
def consensus_best(spark, sf):
    candidates = S.candidates(spark, sf)
    rows = C.best(candidates, C.received_scores(candidates, S.evaluations(spark, sf)))
    return rows.drop("all_scores").withColumn("best_score", F.round("best_score", 6))


@query("""WITH c AS (SELECT conv_id AS item, 'p' || CAST(turn AS VARCHAR) AS provider, turn, length(text) AS n FROM conversations WHERE role = 'assistant')
 SELECT item, coalesce(string_agg(provider || '=' || CAST(n + turn AS VARCHAR), ';' ORDER BY provider) FILTER (WHERE n % 2 = 0), '') AS tokens,
 string_agg(provider || '=' || printf('%.1f', CAST(n AS DOUBLE)), ';' ORDER BY provider) AS times FROM c GROUP BY 1""")
def usage_maps(spark, sf):
    n = F.char_length("content").cast("bigint")
    calls = S.candidates(spark, sf).select(
        "item", "provider", n.alias("prompt_tokens"), F.col("priority").alias("completion_tokens"),
        F.when(n % 2 == 0, n + F.col("priority")).otherwise(F.lit(0)).alias("total_tokens"),
        n.cast("double").alias("gen_ms"), F.lit(None).cast("double").alias("eval_ms"))
    show = lambda name, field: F.array_join(F.transform(F.map_entries(name), lambda e: F.concat(
        e["key"], F.lit("="), e["value"][field].cast("string"))), ";")
    return C.usage_maps(calls).select("item", show("token_usage", "total").alias("tokens"), show("provider_times", "gen_ms").alias("times"))
