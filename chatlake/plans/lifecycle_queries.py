"""Checked queries of L1-L12, J1, IO4, IO8, IO9 and IO11."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from chatlake.functions.text import json_map
from chatlake.operators import analytics as N
from chatlake.operators import ingest as I
from chatlake.operators import lifecycle as L
from chatlake.plans.registry import query
from chatlake.sources import adapters as S
from chatlake.sources.adapters import AS_OF
from chatlake.sources.tables import scan

MID = dt.datetime(2024, 1, 10)


def state(spark, sf):
    """Follow-up state: the last interval and due date follow from the user id."""
    users = S.activity(spark, sf).groupBy("user_id").agg(F.min("ts").alias("f"))
    pick = F.pmod("user_id", F.lit(6))
    last = F.when(pick == 1, 1).when(pick == 2, 7).when(pick == 3, 30).when(pick == 4, 5)
    due = F.when(pick == 5, F.col("f") + F.expr("INTERVAL 40 DAYS")).when(pick == 2, F.col("f") + F.expr("INTERVAL 7 DAYS"))
    return users.select("user_id", due.alias("due_at"), last.alias("last_days"))


_STATE = """u AS (SELECT user_id, min(ts) AS f FROM events GROUP BY 1), s AS (SELECT user_id, f, user_id % 6 AS p,
 CASE user_id % 6 WHEN 1 THEN 1 WHEN 2 THEN 7 WHEN 3 THEN 30 WHEN 4 THEN 5 END AS last_days,
 CASE user_id % 6 WHEN 5 THEN f + INTERVAL 40 DAYS WHEN 2 THEN f + INTERVAL 7 DAYS END AS due_at FROM u),
 nx AS (SELECT s.*, CASE last_days WHEN 1 THEN 2 WHEN 7 THEN 4 WHEN 30 THEN 5 ELSE 1 END AS start FROM s),
 ls AS (SELECT nx.*, (SELECT min(d) FROM (SELECT unnest([1, 3, 7, 14, 30]) AS d, unnest([1, 2, 3, 4, 5]) AS i) x WHERE x.i >= nx.start
  AND nx.f + to_days(CAST(x.d AS INTEGER)) > TIMESTAMP '2024-01-10 00:00:00') AS nxt FROM nx),
 fu AS (SELECT user_id, f AS first_ts, CASE WHEN due_at > TIMESTAMP '2024-01-10 00:00:00' THEN due_at ELSE f + to_days(CAST(nxt AS INTEGER)) END AS due_at,
 CAST(CASE WHEN due_at > TIMESTAMP '2024-01-10 00:00:00' THEN last_days ELSE coalesce(nxt, last_days) END AS INTEGER) AS last_days,
 CASE WHEN due_at > TIMESTAMP '2024-01-10 00:00:00' THEN 'kept' WHEN nxt IS NOT NULL THEN 'scheduled' ELSE 'none' END AS outcome FROM ls)"""


@query(f"WITH {_STATE} SELECT user_id, first_ts, due_at, coalesce(last_days, 0) AS last_days, outcome FROM fu")
def followups(spark, sf):
    return L.follow_ups(S.activity(spark, sf), state(spark, sf), MID).withColumn("last_days", F.coalesce("last_days", F.lit(0)))


@query(f"WITH {_STATE} SELECT user_id, due_at FROM fu WHERE due_at <= TIMESTAMP '2024-01-16 00:00:00'")
def due_followups(spark, sf):
    queue = L.follow_ups(S.activity(spark, sf), state(spark, sf), MID)
    return L.due(queue, dt.datetime(2024, 1, 16)).select("user_id", "due_at")


@query(f"""WITH {_STATE}, t AS (SELECT *, greatest(0, date_diff('microsecond', TIMESTAMP '2024-01-15 00:00:00', due_at) // 1000000) AS secs FROM fu)
 SELECT user_id, due_at, secs // 86400 AS days_left, (secs % 86400) // 3600 AS hours_left, (secs % 3600) // 60 AS minutes_left,
 array_to_string(list_filter([1, 3, 7, 14, 30], lambda d: list_position([1, 3, 7, 14, 30], d) > coalesce(list_position([1, 3, 7, 14, 30], last_days), 0)), ',') AS remaining_days FROM t""")
def followup_status(spark, sf):
    queue = L.follow_ups(S.activity(spark, sf), state(spark, sf), MID)
    rows = L.follow_up_status(queue, dt.datetime(2024, 1, 15))
    return rows.withColumn("remaining_days", F.array_join(F.col("remaining_days").cast("array<string>"), ","))


_CODES = """cd AS (SELECT lpad(CAST(event_id AS VARCHAR), 6, '0') AS code, user_id, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id,
 CAST(floor(value) AS BIGINT) AS v FROM events WHERE event_type = 'signup')"""
# The silence queries look back from a week after the last events, so that some users have been silent for long.
QUIET_AS_OF = dt.datetime(2024, 2, 6)
_QUIET = "la AS (SELECT user_id, max(ts) AS last_active FROM events GROUP BY 1)"


@query(f"""WITH {_CODES}, {_QUIET} SELECT user_id, last_active FROM la WHERE last_active < TIMESTAMP '2024-01-30' AND EXISTS
 (SELECT 1 FROM cd WHERE cd.user_id = la.user_id AND k % 2 = 0)""")
def inactive_users(spark, sf):
    return L.inactive_users(S.activity(spark, sf), S.codes(spark, sf), QUIET_AS_OF, 7)


@query(f"""WITH {_CODES} SELECT e.user_id, count(*) AS joined_rows, max(e.ts) AS last_active FROM events e JOIN cd ON cd.user_id = e.user_id AND cd.k % 2 = 0 GROUP BY 1""")
def verified_activity(spark, sf):
    rows = L.verified_activity(S.activity(spark, sf), S.codes(spark, sf))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("joined_rows"), F.max("ts").alias("last_active"))


@query(f"""WITH {_CODES}, {_QUIET}, reg AS (SELECT DISTINCT user_id FROM cd WHERE k % 2 = 0),
 lv AS (SELECT user_id, arg_max(CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' WHEN 'click' THEN 'unknown' ELSE 'general' END, (ts, event_id)) AS lvl FROM events GROUP BY 1), cool AS (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 200),
 b AS (SELECT la.*, lvl, date_diff('microsecond', last_active, TIMESTAMP '2024-02-06') // 86400000000 AS days_inactive FROM la JOIN lv USING (user_id) WHERE user_id IN (SELECT user_id FROM reg)),
 c1 AS (SELECT * FROM b WHERE last_active < TIMESTAMP '2024-02-03' ORDER BY last_active, user_id LIMIT 20),
 p1 AS (SELECT * FROM c1 WHERE user_id NOT IN (SELECT user_id FROM cool) AND lvl IN ('high', 'medium') ORDER BY last_active, user_id LIMIT 10),
 c2 AS (SELECT * FROM b WHERE last_active < TIMESTAMP '2024-01-30' ORDER BY last_active, user_id LIMIT 20),
 p2 AS (SELECT * FROM c2 WHERE user_id NOT IN (SELECT user_id FROM cool) AND user_id NOT IN (SELECT user_id FROM p1)),
 a AS (SELECT *, 1 AS phase FROM p1 UNION ALL SELECT *, 2 FROM p2)
 SELECT user_id, last_active, lvl AS risk_level, days_inactive, CAST(phase AS INTEGER) AS phase FROM a ORDER BY phase, last_active, user_id LIMIT 10""")
def checkins(spark, sf):
    from chatlake.functions.risk import normalise_level
    from chatlake.operators.risk import latest_level

    events = S.progress(spark, sf)
    levels = latest_level(events.withColumn("risk_level", normalise_level(F.col("risk_level"))), ("ts", "event_id"))
    cooling = scan(spark, sf, "events", (F.col("event_type") == "purchase") & (F.col("value") > 200)).select("user_id").distinct()
    return L.check_ins(S.activity(spark, sf), S.codes(spark, sf), levels, cooling, QUIET_AS_OF)


_REQ = "rq AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100)"


def requests(spark, sf):
    return scan(spark, sf, "events", (F.col("event_type") == "purchase") & (F.col("value") > 100)).select("user_id")


def erasable(spark, sf):
    return {"conversations": S.activity(spark, sf), "progress": S.progress(spark, sf), "usage": S.usage_events(spark, sf)}


@query(f"""WITH {_REQ} SELECT t.n AS table_name, e.user_id, count(*) AS removed FROM events e JOIN rq USING (user_id),
 (VALUES ('conversations'), ('progress'), ('usage')) t(n) GROUP BY 1, 2""")
def erasure_counts(spark, sf):
    return L.erase(erasable(spark, sf), requests(spark, sf))[1]


@query(f"WITH {_REQ} SELECT event_id AS id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM rq)")
def erasure(spark, sf):
    return L.erase(erasable(spark, sf), requests(spark, sf))[0]["conversations"].select("id", "user_id")


@query(f"""WITH {_REQ}, c AS (SELECT user_id, min(ts) AS g FROM events WHERE event_type = 'signup' AND value > 50 GROUP BY 1)
 SELECT user_id, g AS consent_given_at, CASE WHEN r.user_id IS NOT NULL THEN TIMESTAMP '2024-01-31' END AS data_deleted_at,
 CASE WHEN r.user_id IS NOT NULL THEN TIMESTAMP '2024-01-31' ELSE g END AS updated_at FROM c FULL JOIN (SELECT user_id FROM rq) r USING (user_id)""")
def consent(spark, sf):
    given = scan(spark, sf, "events", (F.col("event_type") == "signup") & (F.col("value") > 50)).groupBy("user_id").agg(F.min("ts").alias("consent_given_at"))
    none = F.lit(None).cast("timestamp_ntz")
    table = given.select("user_id", "consent_given_at", none.alias("consent_revoked_at"), none.alias("data_deleted_at"), F.col("consent_given_at").alias("updated_at"))
    return L.consent_after(table, requests(spark, sf), AS_OF).drop("consent_revoked_at")


# Incoming codes: the order keys, some too short, some already taken, some twice.
_IN = """inc AS (SELECT CASE WHEN event_type = 'view' THEN CAST(event_id % 1000 AS VARCHAR) ELSE lpad(CAST(event_id // 2 AS VARCHAR), 6, '0') END AS code, event_id
 FROM events WHERE event_type IN ('view', 'click', 'error'))"""


def incoming(spark, sf):
    code = F.when(F.col("event_type") == "view", (F.col("event_id") % 1000).cast("string")).otherwise(
        F.lpad(F.floor(F.col("event_id") / 2).cast("string"), 6, "0"))
    rows = scan(spark, sf, "events", F.col("event_type").isin("view", "click", "error"))
    return rows.select(code.alias("code"), F.concat(F.lit('{"n":'), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit("}")).alias("full_data"))


@query(f"""WITH {_CODES}, {_IN}, g AS (SELECT code, min(event_id) AS e FROM inc WHERE regexp_matches(code, '^\\d{{6}}$') AND code NOT IN (SELECT code FROM cd) GROUP BY 1)
 SELECT code, 'pending' AS status, '{{"full_data":{{"n":' || lpad(CAST(e AS VARCHAR), 9, '0') || '}},"ai_summary":"","processed_at":"2024-01-31T00:00:00","ai_processed_at":null}}' AS form_data FROM g""")
def code_import(spark, sf):
    return L.import_codes(S.codes(spark, sf), incoming(spark, sf), AS_OF)[0].select("code", "status", "form_data")


@query(f"""WITH {_CODES}, {_IN}, v AS (SELECT code, regexp_matches(code, '^\\d{{6}}$') AS ok, code IN (SELECT code FROM cd) AS taken,
 row_number() OVER (PARTITION BY code ORDER BY event_id) AS rn FROM inc)
 SELECT code, CASE WHEN NOT ok THEN 'invalid_code' ELSE 'duplicate' END AS reason, count(*) AS n FROM v WHERE NOT ok OR taken OR rn > 1 GROUP BY 1, 2""")
def code_rejects(spark, sf):
    rows = L.import_codes(S.codes(spark, sf), incoming(spark, sf), AS_OF)[1]
    return rows.groupBy("code", "reason").agg(F.count(F.lit(1)).alias("n"))


# Two users ask for each code of a purchase-neighbour; the instant is shortly after the last forms.
_ASK = """ask AS (SELECT code, 'u' || CAST(user_id AS VARCHAR) AS user_id FROM cd UNION ALL SELECT code, 'v' || CAST(user_id AS VARCHAR) FROM cd WHERE k > 50),
 oc AS (SELECT ask.user_id, code, CASE WHEN k % 2 = 0 OR starts_with(ask.user_id, 'v') THEN 'invalid' WHEN k % 3 = 0 AND
 date_diff('microsecond', date_trunc('second', ts), TIMESTAMP '2024-01-15 12:00:00') < 300000000 THEN 'waiting' ELSE 'verified' END AS outcome,
 CAST(CASE WHEN outcome = 'waiting' THEN floor((300 - date_diff('microsecond', date_trunc('second', ts), TIMESTAMP '2024-01-15 12:00:00') / 1000000) / 60) + 1 END AS INTEGER) AS minutes_left
 FROM ask JOIN cd USING (code))"""
ASKED = dt.datetime(2024, 1, 15, 12)


def asking(spark, sf):
    codes, user = S.codes(spark, sf), scan(spark, sf, "events", F.col("event_type") == "signup")
    k = F.get_json_object("props", "$.k").cast("bigint")
    base = user.select(F.lpad(F.col("event_id").cast("string"), 6, "0").alias("code"), "user_id", k.alias("k"))
    name = lambda p: F.concat(F.lit(p), F.col("user_id").cast("string")).alias("user_id")
    asked = base.select("code", name("u")).unionByName(base.where("k > 50").select("code", name("v")))
    return codes, asked


@query(f"WITH {_CODES}, {_ASK} SELECT user_id, code, outcome, coalesce(minutes_left, 0) AS minutes_left FROM oc")
def verification(spark, sf):
    codes, asked = asking(spark, sf)
    return L.verification_outcomes(codes, asked, ASKED).withColumn("minutes_left", F.coalesce("minutes_left", F.lit(0)))


@query(f"""WITH {_CODES}, {_ASK}, w AS (SELECT code, user_id FROM oc WHERE outcome = 'verified')
 SELECT cd.code, CASE WHEN w.code IS NOT NULL THEN w.user_id WHEN k % 2 = 0 THEN CAST(cd.user_id AS VARCHAR) END AS user_id,
 CASE WHEN w.code IS NOT NULL THEN TIMESTAMP '2024-01-15 12:00:00' WHEN k % 2 = 0 THEN ts END AS verified_at,
 CASE WHEN w.code IS NOT NULL OR k % 2 = 0 THEN 'verified' ELSE 'pending' END AS status FROM cd LEFT JOIN w ON w.code = cd.code""")
def verified_codes(spark, sf):
    codes, asked = asking(spark, sf)
    codes = codes.withColumn("user_id", F.col("user_id").cast("string"))
    return L.codes_after(codes, L.verification_outcomes(codes, asked, ASKED), ASKED).select("code", "user_id", "verified_at", "status")


def _band(c: str, low: int) -> str:
    return f"CASE WHEN {c} <= {low} THEN 'low' WHEN {c} <= 26 THEN 'medium' ELSE 'high' END"


@query(f"""WITH {_CODES} SELECT code, '- alcohol: ' || CAST(v % 40 AS VARCHAR) || ' points (' || {_band('v % 40', 10)} || ')' || chr(10) ||
 '- cannabis: ' || CAST(k % 40 AS VARCHAR) || ' points (' || {_band('k % 40', 3)} || ')' || chr(10) || 'overall risk: ' || CASE WHEN k > 50 THEN 'high' ELSE 'low' END AS summary FROM cd""")
def form_summaries(spark, sf):
    return L.form_summary(S.codes(spark, sf))


@query(f"""WITH {_CODES} SELECT code, CASE WHEN k % 3 = 0 THEN 'new "text" ' || code WHEN k % 3 <> 0 THEN 'summary ' || CAST(event_id AS VARCHAR) END AS ai_summary,
 CASE WHEN k % 3 = 0 THEN '2024-01-31T00:00:00' END AS ai_processed_at, v % 40 AS alcohol FROM cd""")
def form_updates(spark, sf):
    codes = S.codes(spark, sf)
    new = codes.where(F.get_json_object("form_data", "$.ai_summary") == "").select("code", F.concat(F.lit('new "text" '), "code").alias("ai_summary"))
    rows = L.update_forms(codes, new, AS_OF)
    at = lambda path: F.get_json_object("form_data", path)
    return rows.select("code", at("$.ai_summary").alias("ai_summary"), at("$.ai_processed_at").alias("ai_processed_at"),
                       at("$.full_data.assistScores.alcohol").cast("bigint").alias("alcohol"))


@query(f"""WITH {_CODES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, code DESC) AS rn FROM cd WHERE k % 2 = 0)
 SELECT user_id, 'summary ' || CAST(event_id AS VARCHAR) AS context, ts AS created_at FROM r WHERE rn = 1 AND k % 3 <> 0 AND ts >= TIMESTAMP '2024-01-17'""")
def user_contexts(spark, sf):
    return L.user_contexts(N.latest_form(S.codes(spark, sf)), AS_OF, days=14)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'view'")
def json_events(spark, sf):
    text = F.when(F.col("event_type") == "view", F.lit("{broken")).otherwise(F.col("props"))
    rows = scan(spark, sf, "events").select("event_id", F.from_json(text, "k BIGINT").alias("e"))
    return rows.where(F.col("e.k").isNotNull()).select("event_id", "e.k")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS fields FROM events")
def json_tolerance(spark, sf):
    text = F.when(F.col("event_type") == "view", F.lit("{broken")).otherwise(F.col("props"))
    return scan(spark, sf, "events").select("event_id", F.size(json_map(text)).alias("fields"))


def _index_and_files(spark, sf):
    """An index of all documents, and a listing where some are new, changed, renamed or gone - by language and length."""
    docs = scan(spark, sf, "documents")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.concat(F.lit("/docs/"), name)
    index = docs.where("lang <> 'es'").select(
        F.col("doc_id").cast("string").alias("doc_id"), name.alias("doc_name"), F.lit(0).alias("chunk_index"),
        F.struct(path.alias("source_path")).alias("metadata"))
    changed = F.when(F.col("lang") == "de", F.concat(F.lit("new"), F.col("doc_id"))).otherwise(F.col("doc_id").cast("string"))
    files = docs.where("lang <> 'fr'").select(path.alias("path"), name.alias("doc_name"), changed.alias("doc_id"), "text")
    return index, files


@query("SELECT 'doc' || CAST(doc_id AS VARCHAR) || '.txt' AS doc_name, CASE lang WHEN 'es' THEN 'index' WHEN 'de' THEN 'replace' ELSE 'skip' END AS action FROM documents WHERE lang <> 'fr'")
def ingest_plan(spark, sf):
    index, files = _index_and_files(spark, sf)
    return I.classify(files, index).select("doc_name", "action")


@query("SELECT 'doc' || CAST(doc_id AS VARCHAR) || '.txt' AS doc_name FROM documents WHERE lang = 'fr'")
def stale_documents(spark, sf):
    index, files = _index_and_files(spark, sf)
    return I.stale(index, files, "/docs")


@query("SELECT count(*) AS removed FROM documents WHERE lang = 'de'")
def delete_by_key(spark, sf):
    docs = scan(spark, sf, "documents", columns=["doc_id", "lang"])
    return I.delete_rows(docs, docs.where("lang = 'de'"), "doc_id")[1]
