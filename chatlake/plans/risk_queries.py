"""Checked queries of R1-R8h, A9-A12, A21 and L5."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.functions import risk as R
from chatlake.functions.lexicon import is_boundary_term
from chatlake.operators import context as X
from chatlake.operators import risk as K
from chatlake.plans.probe import FACILITY, INTENT, PRIORITY, PROBE
from chatlake.plans.registry import query
from chatlake.sources import adapters as S

_WORD = r"\p{L}\p{N}_"


def _list(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def _any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def _lexicon_rows() -> str:
    rows = []
    for level, terms in (("high", PROBE.high), ("medium", PROBE.medium)):
        rows += [f"({i}, '{t}', '{level}', {str(is_boundary_term(t)).lower()})" for i, t in enumerate(terms)]
    return ", ".join(rows)


def _ends(text: str) -> str:
    return " OR ".join(f"ends_with({text}, '{n}')" for n in PROBE.negations)


def scored_sql(source: str, keys: str, text: str) -> str:
    """CTEs up to ``scored`` (keys, risk_level, keywords list) for a table with a text column."""
    return f"""lex(pos, term, lvl, alone) AS (VALUES {_lexicon_rows()}),
 m AS (SELECT {keys}, lower({text}) AS t FROM {source}),
 hit AS (SELECT {keys}, lex.*, CASE WHEN alone
   THEN regexp_extract(t, '^((?s:.*?)(?:^|[^{_WORD}]))' || term || '(?:$|[^{_WORD}])', 1)
   ELSE substr(t, 1, strpos(t, term) - 1) END AS before
  FROM m JOIN lex ON CASE WHEN alone THEN regexp_matches(t, '(^|[^{_WORD}])' || term || '($|[^{_WORD}])')
   ELSE contains(t, term) END),
 neg AS (SELECT *, ({_ends("right(before, 12)")}) AS negated FROM hit),
 med AS (SELECT * FROM neg a WHERE lvl = 'medium' AND NOT negated AND NOT EXISTS (SELECT 1 FROM neg b WHERE b.lvl = 'medium'
   AND NOT b.negated AND {" AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))}
   AND a.term <> b.term AND contains(b.term, a.term))),
 agg AS (SELECT {keys},
   list(term ORDER BY pos) FILTER (WHERE lvl = 'high' AND NOT negated) AS firm,
   list(term ORDER BY pos) FILTER (WHERE lvl = 'high' AND negated) AS soft FROM neg GROUP BY {keys}),
 magg AS (SELECT {keys}, list(term ORDER BY length(term) DESC, pos) AS kept FROM med GROUP BY {keys}),
 scored AS (SELECT m.*, CASE WHEN len(firm) > 0 THEN 'high' WHEN len(soft) > 0 THEN 'medium' WHEN len(kept) >= 2 THEN 'high'
   WHEN len(kept) = 1 THEN 'medium' ELSE 'general' END AS risk_level,
   CASE WHEN len(firm) > 0 THEN firm WHEN len(soft) > 0 THEN soft WHEN len(kept) >= 1 THEN kept ELSE [] END AS keywords
  FROM m LEFT JOIN agg USING ({keys}) LEFT JOIN magg USING ({keys}))"""


SCORED = "WITH " + scored_sql("conversations", "conv_id, turn", "text")
CATEGORY = f"""CASE WHEN len(keywords) = 0 THEN NULL WHEN list_has_any(keywords, {_list(PROBE.suicide)}) THEN 'suicide'
 WHEN list_has_any(keywords, {_list(PROBE.overdose)}) THEN 'overdose'
 WHEN {_any("array_to_string(keywords, '|')", PROBE.substance_signals)} THEN 'substance' ELSE 'emotional' END"""
LEVEL = """CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' WHEN 'view' THEN 'general'
 WHEN 'signup' THEN 'general' ELSE 'unknown' END"""
PROGRESS = f"""p AS (SELECT event_id, user_id, ts, {LEVEL} AS lvl, event_type,
 CAST(json_extract(props, '$.k') AS BIGINT) % 13 AS k FROM events)"""


@query(SCORED + f" SELECT conv_id, turn, risk_level, array_to_string(keywords, '|') AS keywords, {CATEGORY} AS category FROM scored")
def risk_scored(spark, sf):
    return K.score(S.messages(spark, sf), PROBE).select(
        "conv_id", "turn", "risk_level", F.array_join("keywords", "|").alias("keywords"), "category")


@query(SCORED + """ SELECT count(*) FILTER (WHERE risk_level = 'high') AS high, count(*) FILTER (WHERE risk_level = 'medium') AS medium,
 count(*) FILTER (WHERE risk_level = 'general') AS general, CAST(0 AS BIGINT) AS unknown FROM scored""")
def message_risk_summary(spark, sf):
    return K.risk_summary(K.score(S.messages(spark, sf), PROBE))


@query(f"""WITH {PROGRESS} SELECT count(*) FILTER (WHERE lvl = 'high') AS high, count(*) FILTER (WHERE lvl = 'medium') AS medium,
 count(*) FILTER (WHERE lvl = 'general') AS general, count(*) FILTER (WHERE lvl = 'unknown') AS unknown FROM p""")
def risk_summary(spark, sf):
    return K.risk_summary(S.progress(spark, sf))


@query(f"""WITH {PROGRESS} SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE lvl = 'high') AS high,
 count(*) FILTER (WHERE lvl = 'medium') AS medium, count(*) FILTER (WHERE lvl = 'general') AS general FROM p GROUP BY 1""")
def risk_trend(spark, sf):
    return K.risk_trend(S.progress(spark, sf))


@query(SCORED + f""", w AS (SELECT conv_id, turn, unnest(keywords) AS w FROM scored)
 SELECT w AS keyword, count(*) AS uses, CASE WHEN w IN {tuple(PROBE.high)} THEN 'high'
 WHEN w IN {tuple(PROBE.medium)} THEN 'medium' ELSE 'contextual' END AS risk_class FROM w GROUP BY w
 ORDER BY uses DESC, keyword LIMIT 10""")
def top_keywords(spark, sf):
    scored = K.score(S.messages(spark, sf), PROBE)
    return K.top_keywords(scored, PROBE, 10, order=("conv_id", "turn"))


@query(f"""WITH {PROGRESS}, w AS (SELECT event_id, unnest([event_type, 'Key' || CAST(k AS VARCHAR)]) AS w FROM p)
 SELECT arg_min(w, event_id) AS keyword, count(*) AS uses, 'contextual' AS risk_class FROM w GROUP BY lower(w)
 ORDER BY uses DESC, lower(keyword) LIMIT 12""")
def top_event_keywords(spark, sf):
    return K.top_keywords(S.progress(spark, sf), PROBE, 12, order=("event_id",))


@query(f"""WITH {PROGRESS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
 FROM p WHERE lvl IN ('high', 'medium')) SELECT user_id, string_agg(lvl || '@' || strftime(ts, '%Y-%m-%d %H:%M:%S'), ';'
 ORDER BY rn) AS events FROM r WHERE rn <= 5 GROUP BY user_id""")
def recent_risk(spark, sf):
    text = F.transform("events", lambda e: F.concat(e["risk_level"], F.lit("@"), F.date_format(e["ts"], "yyyy-MM-dd HH:mm:ss")))
    return K.recent_events(S.progress(spark, sf)).select("user_id", F.array_join(text, ";").alias("events"))


@query(f"""WITH {PROGRESS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM p)
 SELECT user_id, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day,
 count(*) FILTER (WHERE lvl = 'high') AS high, count(*) FILTER (WHERE lvl = 'medium') AS medium,
 count(*) FILTER (WHERE lvl = 'general') AS general FROM r WHERE rn <= 100 GROUP BY user_id""")
def progress_report(spark, sf):
    from chatlake.operators.usage import keep_last

    return K.progress_report(keep_last(S.progress(spark, sf), ("user_id",), 100))


@query(f"""WITH {PROGRESS} SELECT user_id, arg_max(lvl, (ts, event_id)) AS risk_level FROM p GROUP BY user_id""")
def latest_risk(spark, sf):
    events = S.progress(spark, sf).withColumn("risk_level", R.normalise_level(F.col("risk_level")))
    return K.latest_level(events, ("ts", "event_id"))


_RECENT = """ctx AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS q,
 trim(regexp_replace(array_to_string(list(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) OVER
 (PARTITION BY conv_id ORDER BY turn ROWS 3 PRECEDING), ' '), ' +', ' ', 'g')) AS recent FROM conversations)"""
_ASKS = "|".join(f"(?:{p})" for p in INTENT.patterns)


@query(SCORED + f""", {_RECENT}, f AS (SELECT conv_id, turn, risk_level, q, regexp_matches(q, '{_ASKS}') AS asks,
 {_any("q", INTENT.domain)} AS dom, {_any("q", INTENT.disclosure)} AS dis, {_any("q", INTENT.direct)} AS dir,
 {_any("q", INTENT.follow_up)} AS fol, {_any("q", INTENT.question)} AS que,
 ({_any("recent", INTENT.domain)} OR regexp_matches(recent, '{_ASKS}')) AS rel
 FROM scored JOIN ctx USING (conv_id, turn))
 SELECT conv_id, turn, CASE WHEN risk_level = 'high' THEN 'crisis' WHEN q <> '' AND ((asks AND dom AND NOT dis) OR dir
 OR (fol AND (asks OR dom OR que) AND rel)) THEN 'info' ELSE 'general' END AS intent FROM f""")
def intent(spark, sf):
    rows = K.score(X.recent_text(S.messages(spark, sf)), PROBE)
    return rows.select("conv_id", "turn", R.intent(F.col("text"), F.col("risk_level"), F.col("recent"), INTENT).alias("intent"))


@query(f"""SELECT conv_id, turn, CAST(least(10, 5 + 3 * len(list_filter({_list(PRIORITY.high)}, lambda w: contains(lower(text), w)))
 + len(list_filter({_list(PRIORITY.medium)}, lambda w: contains(lower(text), w)))) AS INTEGER) AS priority FROM conversations""")
def message_priority(spark, sf):
    return S.messages(spark, sf).select("conv_id", "turn", R.priority(F.col("text"), PRIORITY).alias("priority"))


@query(f"""SELECT conv_id, turn, ({_any("lower(text)", FACILITY.facility)} AND ({_any("lower(text)", FACILITY.location)} OR
 ({_any("lower(text)", FACILITY.ask)} AND {_any("lower(text)", FACILITY.place)}))) AS facility_inquiry FROM conversations""")
def facility_inquiry(spark, sf):
    return S.messages(spark, sf).select("conv_id", "turn", R.facility_inquiry(F.col("text"), FACILITY).alias("facility_inquiry"))


PAIRS = """prv AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS pr, lag(text) OVER w AS pt FROM conversations
 WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 ex AS (SELECT conv_id, turn, pt AS user_message, text AS bot_response FROM prv WHERE role = 'assistant' AND pr = 'user')"""
TOKENS = r"""CAST(len(regexp_extract_all({t}, '[\x{{0E00}}-\x{{0E7F}}]')) * 1.2::DOUBLE + len(regexp_extract_all({t}, '[a-zA-Z]+')) * 0.6::DOUBLE
 + len(regexp_extract_all({t}, '[0-9]+')) + len(regexp_extract_all({t}, '[^\p{{L}}\p{{N}}_\s\x{{0E00}}-\x{{0E7F}}]')) AS DOUBLE)"""


def tokens_sql(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN 0 ELSE greatest(1, CAST(trunc({TOKENS.format(t=text)}) AS BIGINT)) END"


@query(f"WITH {PAIRS}, " + scored_sql("ex", "conv_id, turn", "user_message") + f"""
 SELECT conv_id, turn, risk_level, array_to_string(keywords, '|') AS keywords, {CATEGORY} AS category,
 {tokens_sql("user_message || bot_response")} AS token_count,
 risk_level IN ('high', 'medium') OR length(user_message) > 300 OR length(bot_response) > 500 AS important_flag
 FROM scored JOIN ex USING (conv_id, turn)""")
def message_log(spark, sf):
    rows = K.score_exchanges(X.exchanges(S.messages(spark, sf)), PROBE)
    return rows.select("conv_id", "turn", "risk_level", F.array_join("keywords", "|").alias("keywords"), "category",
                       "token_count", "important_flag")


@query(SCORED + f""", k AS (SELECT *, {CATEGORY} AS category FROM scored) SELECT conv_id, turn, CASE
 WHEN risk_level = 'high' AND category IN ('suicide', 'overdose') THEN category || ' reply: ' || array_to_string(keywords, ', ')
 WHEN risk_level = 'high' THEN 'other reply: ' || array_to_string(keywords, ', ')
 ELSE 'general reply: ' || array_to_string(keywords, ', ') END AS reply FROM k""")
def reply_templates(spark, sf):
    keys = ["suicide", "overdose", "other", "general"]
    templates = spark.createDataFrame([(k, f"{k} reply: %s") for k in keys], "template_key STRING, template STRING")
    rows = K.score(S.messages(spark, sf), PROBE)
    rows = rows.withColumn("key", K.template_key(F.col("risk_level"), F.coalesce("category", F.lit(""))))
    rows = rows.withColumn("words", F.array_join("keywords", ", "))
    return K.fill_templates(rows, templates, "key", "words").select("conv_id", "turn", "reply")


_ERRORS = """er AS (SELECT event_id, user_id, ts, CASE CAST(json_extract(props, '$.k') AS BIGINT) % 6 WHEN 0 THEN 'MySQL gone'
 WHEN 1 THEN 'Connection reset' WHEN 2 THEN 'HTTP 500' WHEN 3 THEN 'Permission denied' WHEN 4 THEN 'Invalid code' ELSE 'boom' END
 || ' #' || CAST(event_id AS VARCHAR) AS message FROM events WHERE event_type = 'error'),
 err AS (SELECT *, CASE WHEN message LIKE 'MySQL%' THEN 'database' WHEN message LIKE 'Conn%' THEN 'network'
 WHEN message LIKE 'HTTP%' THEN 'external_api' WHEN message LIKE 'Perm%' THEN 'authentication'
 WHEN message LIKE 'Inv%' THEN 'validation' ELSE 'system' END AS category,
 CASE WHEN message LIKE 'MySQL%' OR message LIKE 'Perm%' THEN 'high' WHEN message LIKE 'Inv%' THEN 'low' ELSE 'medium' END AS severity
 FROM er)"""


@query(SCORED + f""", h AS (SELECT 'high_risk:' || CAST(conv_id AS VARCHAR) AS category, 'critical' AS severity,
 'high risk signals from user ' || substr(CAST(conv_id AS VARCHAR), 1, 8) || '...' AS text,
 array_to_string(keywords[1:5], ', ') AS detail FROM scored WHERE risk_level = 'high'), {_ERRORS},
 e AS (SELECT 'critical_error', 'critical', 'critical error for user ' || substr(CAST(user_id AS VARCHAR), 1, 8) || '...',
 substr(message, 1, 200) FROM err WHERE severity = 'high'),
 d AS (SELECT CAST(ts AS DATE) AS day, round(sum(CAST(value AS DECIMAL(18,2))), 2) AS c FROM events GROUP BY 1),
 c AS (SELECT 'cost_threshold', 'warning', 'cost of the day $' || printf('%.2f', CAST(c AS DOUBLE)) || ' exceeds $5000.00',
 '$' || printf('%.2f', CAST(c AS DOUBLE)) FROM d WHERE c > 5000)
 SELECT * FROM h UNION ALL SELECT * FROM e UNION ALL SELECT * FROM c""")
def alert_rows(spark, sf):
    from chatlake.sources.tables import scan

    scored = K.score(S.messages(spark, sf), PROBE).withColumnRenamed("conv_id", "user_id").withColumn(
        "ts", F.lit(S.AS_OF).cast("timestamp_ntz"))
    errors = S.error_events(spark, sf).where(K.error_severity(F.col("message")) == "high").withColumn("error", F.col("message"))
    errors = errors.withColumn("user_message", F.lit(""))
    costs = scan(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.sum(F.col("value").cast("DECIMAL(18,2)")).alias("current_cost")).where("current_cost > 5000")
    costs = costs.select(F.col("day").cast("timestamp_ntz").alias("ts"), "current_cost", F.lit(5000.0).alias("threshold"), F.lit("all").alias("model"))
    rows = K.all_alerts(K.high_risk_alerts(scored), K.critical_error_alerts(errors), K.cost_alert_rows(costs))
    detail = F.coalesce(F.col("extra")["keywords"], F.col("extra")["error"], F.col("extra")["current_cost"])
    return rows.select("category", "severity", "text", detail.alias("detail"))


@query(f"WITH {_ERRORS} SELECT event_id, category, severity FROM err")
def error_categories(spark, sf):
    m = F.col("message")
    return S.error_events(spark, sf).select("event_id", K.error_category(m).alias("category"), K.error_severity(m).alias("severity"))


@query("""WITH c AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v
 FROM events WHERE event_type = 'signup'), s AS (
 SELECT event_id, 'alcohol' AS substance, CAST(v % 40 AS DOUBLE) AS score FROM c UNION ALL
 SELECT event_id, 'cannabis', CAST(k % 40 AS DOUBLE) FROM c)
 SELECT lpad(CAST(event_id AS VARCHAR), 6, '0') AS code, substance, score, CASE
 WHEN score <= CASE WHEN substance = 'alcohol' THEN 10 ELSE 3 END THEN 'low' WHEN score <= 26 THEN 'medium' ELSE 'high' END AS band FROM s""")
def score_bands(spark, sf):
    from chatlake.operators.lifecycle import form_lines

    return form_lines(S.codes(spark, sf))
