"""Checked queries of W1-W3, W9-W12, C1-C6, A31, J4 and L10."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.functions.text import estimate_tokens
from chatlake.operators import context as X
from chatlake.operators import lifecycle as L
from chatlake.plans.probe import PROBE
from chatlake.plans.registry import query
from chatlake.plans.risk_queries import PAIRS, scored_sql, tokens_sql
from chatlake.sources import adapters as S

_EACH = f"({tokens_sql('text')} + 4 + CASE WHEN role = 'system' THEN 2 ELSE 0 END)"


@query(f"WITH {PAIRS} SELECT * FROM ex")
def exchanges(spark, sf):
    return X.exchanges(S.messages(spark, sf))


@query("""WITH d AS (SELECT conv_id, turn, role, lag(role, 1, '') OVER w AS b, lead(role, 1, '') OVER w AS a FROM conversations
 WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT conv_id, turn, role FROM d WHERE (role = 'user' AND a <> 'assistant') OR (role = 'assistant' AND b <> 'user')""")
def unpaired_messages(spark, sf):
    return X.unpaired(S.messages(spark, sf)).select("conv_id", "turn", "role")


@query("""SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN 'dialogue' WHEN role = 'system_summary' THEN 'summary'
 ELSE 'preserved' END AS class FROM conversations""")
def role_split(spark, sf):
    return S.messages(spark, sf).select("conv_id", "turn", X.role_class(F.col("role"), F.col("text")).alias("class"))


@query(f"""SELECT conv_id, count(*) AS n_messages, CAST(trunc((sum({_EACH}) + 4) * 1.05::DOUBLE) AS BIGINT) AS session_tokens
 FROM conversations GROUP BY conv_id""")
def session_tokens(spark, sf):
    return X.session_tokens(S.messages(spark, sf))


@query(f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
 t AS (SELECT conv_id, count(*) AS n_messages, CAST(trunc((sum({_EACH}) + 4) * 1.05::DOUBLE) AS BIGINT) AS session_tokens
 FROM k WHERE rn <= 100 GROUP BY conv_id)
 SELECT *, session_tokens / 1500 AS budget_share, session_tokens > 1500 * 0.7::DOUBLE AS warning FROM t""")
def session_state(spark, sf):
    return X.session_state(S.messages(spark, sf), budget=1500)


@query("""WITH a AS (SELECT event_id, user_id, ts, CAST(floor(value) AS BIGINT) AS t, event_type IN ('error', 'purchase') AS imp, event_type FROM events),
 r AS (SELECT *, CASE WHEN t = 0 THEN greatest(1, CAST(trunc(0.6::DOUBLE) AS BIGINT)) ELSE t END AS used_tokens,
 row_number() OVER (PARTITION BY user_id ORDER BY imp DESC, ts DESC, event_id DESC) AS rn FROM a),
 s AS (SELECT *, sum(used_tokens) OVER (PARTITION BY user_id ORDER BY rn) AS running FROM r WHERE rn <= 200)
 SELECT event_id AS id, user_id, CAST(rn AS INTEGER) AS rn, used_tokens, CAST(running AS BIGINT) AS running_tokens FROM s WHERE running <= 1000""")
def token_budget_history(spark, sf):
    rows = X.token_budget(S.activity(spark, sf), 1000, estimate=estimate_tokens(F.lit("word")))
    return rows.select("id", "user_id", "rn", "used_tokens", "running_tokens")


@query("""WITH d AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
 count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role IN ('user', 'assistant'))
 SELECT conv_id, turn, rn, n AS dialogue_rows, CASE WHEN n <= 4 THEN 'whole' WHEN rn > n - 4 THEN 'recent' ELSE 'older' END AS part FROM d""")
def keep_recent(spark, sf):
    return X.keep_recent(S.messages(spark, sf), 2).select("conv_id", "turn", "rn", "dialogue_rows", "part")


_RESTORED = f"""{PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM ex)"""


@query(f"""WITH {_RESTORED} SELECT conv_id, turn AS source_turn, CAST(0 AS INTEGER) AS side, 'user' AS role, user_message AS text FROM n
 WHERE rn <= 2 AND user_message <> '' UNION ALL
 SELECT conv_id, turn, 1, 'assistant', bot_response FROM n WHERE rn <= 2 AND bot_response <> ''""")
def history_restore(spark, sf):
    return X.restore(X.exchanges(S.messages(spark, sf)), 2)


@query(f"WITH {_RESTORED} SELECT conv_id, turn, user_message, bot_response FROM n WHERE rn > 2")
def unused_history(spark, sf):
    history = X.exchanges(S.messages(spark, sf))
    return X.unused_history(history, X.restore(history, 2))


@query(f"""WITH {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM ex)
 SELECT conv_id, CAST(CASE WHEN n > 2 THEN (rn - 1) // 2 ELSE 0 END AS INTEGER) AS chunk, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns,
 CAST(count(*) AS INTEGER) AS n_pairs FROM n GROUP BY 1, 2""")
def history_chunks(spark, sf):
    rows = X.history_chunks(X.exchanges(S.messages(spark, sf)), size=2, longer_than=2)
    turns = F.array_join(F.transform("pairs", lambda p: p["turn"].cast("string")), ",")
    return rows.select("conv_id", "chunk", turns.alias("turns"), "n_pairs")


_COMPACT = f"""WITH sz AS (SELECT conv_id, CAST(trunc((sum({_EACH}) + 4) * 1.05::DOUBLE) AS BIGINT) AS t,
 count(*) FILTER (WHERE role IN ('user', 'assistant')) AS d FROM conversations GROUP BY conv_id),
 fl AS (SELECT conv_id, t >= 300 AND d > 2 AS is_full FROM sz),
 dl AS (SELECT c.*, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY c.conv_id) AS n
  FROM conversations c JOIN fl USING (conv_id) WHERE is_full AND role IN ('user', 'assistant')),
 ol AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS pr, lag(text) OVER w AS pt, lead(role) OVER w AS nr, lead(text) OVER w AS nt
  FROM dl WHERE rn <= n - 2 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 pq AS (SELECT *, CASE WHEN role = 'user' THEN coalesce(nr = 'assistant', false) ELSE coalesce(pr = 'user', false) END AS paired,
  CASE WHEN role = 'user' THEN text ELSE pt END AS u, CASE WHEN role = 'user' THEN nt ELSE text END AS b FROM ol),
 {scored_sql("pq", "conv_id, turn", "coalesce(u, '')")},
 cl AS (SELECT pq.*, paired AND NOT (risk_level IN ('high', 'medium') OR coalesce(length(u) > 300, false) OR coalesce(length(b) > 500, false)) AS plain
  FROM pq JOIN scored USING (conv_id, turn))"""


@query(_COMPACT + """ SELECT conv_id, turn, role, 'whole' AS part, CAST(0 AS INTEGER) AS part_rank FROM conversations JOIN fl USING (conv_id) WHERE NOT is_full
 UNION ALL SELECT conv_id, turn, role, 'preserved', 0 FROM conversations JOIN fl USING (conv_id) WHERE is_full AND role = 'system'
 UNION ALL SELECT conv_id, turn, role, 'passthrough', 2 FROM cl WHERE NOT plain
 UNION ALL SELECT conv_id, turn, role, 'recent', 3 FROM dl WHERE rn > n - 2""")
def context_compaction(spark, sf):
    return X.compact(S.messages(spark, sf), max_tokens=300, keep=1, lexicon=PROBE).drop("text")


@query(_COMPACT + """ SELECT conv_id, CAST(0 AS INTEGER) AS chunk, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns,
 string_agg(CAST(length(text) AS VARCHAR) || '/' || CAST(length(nt) AS VARCHAR), ',' ORDER BY turn) AS lengths
 FROM cl WHERE plain AND role = 'user' GROUP BY 1""")
def compaction_buckets(spark, sf):
    rows = X.compaction_buckets(S.messages(spark, sf), max_tokens=300, keep=1, lexicon=PROBE)
    turns = F.array_join(F.transform("pairs", lambda p: p["turn"].cast("string")), ",")
    sizes = F.array_join(F.transform("pairs", lambda p: F.concat(
        F.char_length(p["user_message"]), F.lit("/"), F.char_length(p["bot_response"]))), ",")
    return rows.select("conv_id", "chunk", turns.alias("turns"), sizes.alias("lengths"))


# Every assistant turn 1 stands in for a stored summary.
_SUMMED = """s AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn <= 1 THEN 'system_summary' ELSE role END AS role, text FROM conversations)"""


@query(f"""WITH {_SUMMED}, j AS (SELECT conv_id, trim(string_agg(text, chr(10) || chr(10) ORDER BY turn), chr(10) || ' ') AS m FROM s WHERE role = 'system_summary' GROUP BY 1),
 r AS (SELECT * FROM s WHERE role <> 'system_summary'), h AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'system') AS h FROM r GROUP BY 1)
 SELECT r.conv_id, r.turn, r.role, CASE WHEN r.turn = h.h AND m IS NOT NULL THEN text || chr(10) || chr(10) || 'Further information (for the assistant only):' || chr(10) || m ELSE text END AS text
 FROM r LEFT JOIN j USING (conv_id) LEFT JOIN h USING (conv_id)
 UNION ALL SELECT j.conv_id, -1, 'system', 'Further information (for the assistant only):' || chr(10) || m FROM j LEFT JOIN h USING (conv_id) WHERE h.h IS NULL""")
def summary_merge(spark, sf):
    role = F.when((F.col("role") == "assistant") & (F.col("turn") <= 1), "system_summary").otherwise(F.col("role"))
    return X.merge_summaries(S.messages(spark, sf).withColumn("role", role))


@query("SELECT conv_id, arg_max(text, turn) AS user_message, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id")
def latest_user_message(spark, sf):
    return X.latest_user_message(S.messages(spark, sf))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS context FROM conversations WHERE role = 'system' GROUP BY conv_id")
def system_context(spark, sf):
    return X.system_context(S.messages(spark, sf))


@query("""WITH f AS (SELECT conv_id, min(turn) AS t, arg_min(role, turn) AS r FROM conversations GROUP BY 1),
 a AS (SELECT conv_id, CAST(turn AS DOUBLE) AS p, role, text FROM conversations UNION ALL
 SELECT conv_id, t + CASE WHEN r = 'system' THEN 0.5 ELSE -0.5 END, 'system', 'User context from the intake form:' || chr(10) || 'context ' || CAST(conv_id AS VARCHAR) FROM f)
 SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS turn, role, text FROM a""")
def context_injection(spark, sf):
    messages = S.messages(spark, sf)
    contexts = messages.select("conv_id").distinct().select("conv_id", F.concat(F.lit("context "), F.col("conv_id").cast("string")).alias("context"))
    return X.inject_context(messages, contexts)


@query("""WITH g AS (SELECT event_id, user_id, ts, lag(ts) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 n AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
 ROWS UNBOUNDED PRECEDING) AS s FROM g)
 SELECT user_id, CAST(s AS BIGINT) AS session_no, min(ts) AS session_start, max(ts) AS session_end, count(*) AS messages FROM n GROUP BY 1, 2""")
def sessions(spark, sf):
    return L.sessions(S.activity(spark, sf), days=1)


@query("""WITH RECURSIVE g AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
 late AS (SELECT * FROM g WHERE ts - p > INTERVAL 1 DAY),
 kept(user_id, ts) AS (SELECT user_id, min(ts) FROM late GROUP BY 1 UNION ALL
 SELECT k.user_id, (SELECT min(l.ts) FROM late l WHERE l.user_id = k.user_id AND l.ts >= k.ts + INTERVAL 1 DAY) FROM kept k WHERE k.ts IS NOT NULL)
 SELECT k.user_id, k.ts, min(l.event_id) AS id FROM kept k JOIN late l USING (user_id, ts) GROUP BY 1, 2""")
def expiry_warnings(spark, sf):
    return L.expiry_warnings(S.activity(spark, sf), days=2, warn=1).select("user_id", "ts", "id")
