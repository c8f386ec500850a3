"""Checked queries of T12: every type of record, cleaned and split, over fields made from the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators import records as D
from chatlake.plans.registry import query
from chatlake.sources.tables import scan

_E = "SELECT event_id, event_type AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v, user_id FROM events"


def _all(rows: DataFrame, kind: D.RecordType) -> DataFrame:
    valid, rejected = D.split(rows, kind)
    return valid.withColumn("problems", F.lit("")).unionByName(rejected.withColumn("problems", F.array_join("errors", "; ")).drop("errors"))


def _escaped(t: str) -> str:
    return f"replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _clean(t: str) -> str:
    squeezed = rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"
    tags = rf"regexp_replace({squeezed}, '<(/?)(b|i|u|strong|em)(?:[\s/][^>]*)?>', chr(57344) || '\1\2' || chr(57345), 'gi')"
    marked = rf"regexp_replace(regexp_replace({tags}, '<[^>]*>', '', 'g'), '&(#?[A-Za-z0-9]+;)', chr(57346) || '\1', 'g')"
    return _escaped(f"translate({_escaped(marked)}, chr(57344) || chr(57345) || chr(57346), '<>&')")


_USER = "'U' || substr(sha256(CAST({id} AS VARCHAR)), 1, CASE WHEN {k} % 7 = 0 THEN 31 ELSE 32 END)"
_USER_ERROR = "CASE WHEN NOT regexp_matches(user_id, '^U[0-9a-f]{32}$') THEN 'user_id: invalid_format' END"


def _user(identity, k):
    return F.concat(F.lit("U"), F.substring(F.sha2(identity.cast("string"), 256), F.lit(1), F.when(k % 7 == 0, 31).otherwise(32)))


def _events(spark, sf):
    return scan(spark, sf, "events").select("event_id", F.col("event_type").alias("t"), F.get_json_object("props", "$.k").cast("bigint").alias("k"),
                                            F.floor("value").cast("bigint").alias("v"), F.col("user_id").alias("u"))


@query(f"""WITH e AS ({_E}), r AS (SELECT event_id, {_USER.format(id='user_id', k='k')} AS user_id,
  repeat(t || chr(10) || '  <b>x</b> <a href="y">& z</a> ', CAST(1 + k % 7 AS INTEGER)) AS display_name,
  CASE k % 5 WHEN 0 THEN t || k || '@mail.example.org' WHEN 1 THEN 'no at sign' WHEN 3 THEN 'OnClick@x.yz' WHEN 4 THEN repeat('a', 250) || '@x.yz' END AS email,
  CASE k % 4 WHEN 0 THEN '+66 81-234-' || k WHEN 1 THEN '0' || k WHEN 3 THEN 'call me' END AS phone, CAST(k AS INTEGER) AS age,
  CASE k % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'none' WHEN 3 THEN 'other' END AS gender FROM e),
 c AS (SELECT event_id, user_id, {_clean('display_name')} AS display_name, email, regexp_replace(phone, '[^0-9+]', '', 'g') AS phone, age, gender FROM r)
 SELECT *, concat_ws('; ', {_USER_ERROR}, CASE WHEN length(display_name) > 100 THEN 'display_name: too_long' END,
  CASE WHEN email IS NOT NULL AND NOT regexp_matches(email, '^[^@ ]+@[^@ .]+(\\.[^@ .]+)+$') THEN 'email: invalid_format' END,
  CASE WHEN length(email) > 254 THEN 'email: too_long' END, CASE WHEN contains(lower(email), 'onclick') THEN 'email: dangerous_content' END,
  CASE WHEN phone <> '' AND NOT regexp_matches(phone, '^\\+?[1-9][0-9]{{1,14}}$') THEN 'phone: invalid_format' END,
  CASE WHEN NOT age BETWEEN 13 AND 120 THEN 'age: out_of_range' END, CASE WHEN gender NOT IN ('male', 'other') THEN 'gender: not_allowed' END) AS problems FROM c""")
def profile_records(spark, sf):
    k, t = F.col("k"), F.col("t")
    name = F.repeat(F.concat(t, F.lit('\n  <b>x</b> <a href="y">& z</a> ')), (1 + k % 7).cast("int"))
    email = (F.when(k % 5 == 0, F.concat(t, k.cast("string"), F.lit("@mail.example.org"))).when(k % 5 == 1, "no at sign").when(k % 5 == 3, "OnClick@x.yz")
             .when(k % 5 == 4, F.concat(F.repeat(F.lit("a"), 250), F.lit("@x.yz"))))
    phone = F.when(k % 4 == 0, F.concat(F.lit("+66 81-234-"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("0"), k.cast("string"))).when(k % 4 == 3, "call me")
    gender = F.when(k % 4 == 0, "male").when(k % 4 == 1, "none").when(k % 4 == 3, "other")
    rows = _events(spark, sf).select("event_id", _user(F.col("u"), k).alias("user_id"), name.alias("display_name"), email.alias("email"), phone.alias("phone"),
                                     k.cast("int").alias("age"), gender.alias("gender"))
    return _all(rows, D.PROFILE)


@query(f"""WITH e AS ({_E}), r AS (SELECT event_id, {_USER.format(id='user_id', k='k')} AS user_id,
  CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 'Ab' || lpad(CAST(111111 + k AS VARCHAR), 6, '1') ELSE 'AbO0' || k END AS registration_code,
  repeat('1.', CAST(k % 30 AS INTEGER)) AS ip_address, repeat('Agent <i>' || k || '</i>  ', CAST(1 + k % 40 AS INTEGER)) AS user_agent FROM e),
 c AS (SELECT event_id, user_id, registration_code, ip_address, {_clean('user_agent')} AS user_agent FROM r)
 SELECT *, concat_ws('; ', {_USER_ERROR}, CASE WHEN registration_code IS NULL OR NOT regexp_matches(registration_code, '^[1-9A-HJ-NP-Za-km-z]{{8}}$') THEN 'code: invalid_format' END,
  CASE WHEN length(ip_address) > 45 THEN 'ip_address: too_long' END, CASE WHEN length(user_agent) > 500 THEN 'user_agent: too_long' END) AS problems FROM c""")
def registration_records(spark, sf):
    k = F.col("k")
    code = F.when(k % 3 == 1, F.concat(F.lit("Ab"), F.lpad((111111 + k).cast("string"), 6, "1"))).when(k % 3 == 2, F.concat(F.lit("AbO0"), k.cast("string")))
    agent = F.repeat(F.concat(F.lit("Agent <i>"), k.cast("string"), F.lit("</i>  ")), (1 + k % 40).cast("int"))
    rows = _events(spark, sf).select("event_id", _user(F.col("u"), k).alias("user_id"), code.alias("registration_code"),
                                     F.repeat(F.lit("1."), (k % 30).cast("int")).alias("ip_address"), agent.alias("user_agent"))
    return _all(rows, D.REGISTRATION)


_PLAIN = r"""'^[\x{0E00}-\x{0E7F}\s\p{L}\p{N}_.,!?()\[\]{}:;''"@#$%^&*+=<>/-]*$'"""


@query(f"""WITH r AS (SELECT conv_id, turn, {_USER.format(id='conv_id', k='turn')} AS user_id, CASE WHEN turn % 4 = 3 THEN NULL ELSE repeat(text || ' ', 2) END AS user_message,
  text || CASE WHEN turn % 3 = 2 THEN ' ~' ELSE ' <em>a</em> & <p>' END AS bot_response, CASE WHEN turn % 5 <> 4 THEN TIMESTAMP '2024-01-31' END AS ts,
  CAST(length(text) * 8 - 400 AS BIGINT) AS token_count, CASE role WHEN 'user' THEN 'high' WHEN 'system' THEN 'odd' END AS risk_level FROM conversations),
 c AS (SELECT conv_id, turn, user_id, {_clean('user_message')} AS user_message, {_clean('bot_response')} AS bot_response, ts, token_count, risk_level FROM r)
 SELECT *, concat_ws('; ', {_USER_ERROR}, CASE WHEN user_message IS NULL OR length(user_message) > 2000 THEN 'user_message: length' END,
  CASE WHEN bot_response IS NULL OR length(bot_response) > 4000 THEN 'bot_response: length' END,
  CASE WHEN NOT regexp_matches(user_message, {_PLAIN}) THEN 'user_message: invalid_characters' END,
  CASE WHEN NOT regexp_matches(bot_response, {_PLAIN}) THEN 'bot_response: invalid_characters' END, CASE WHEN ts IS NULL THEN 'timestamp: missing' END,
  CASE WHEN NOT token_count BETWEEN 0 AND 10000 THEN 'token_count: out_of_range' END, CASE WHEN risk_level NOT IN ('high') THEN 'risk_level: not_allowed' END) AS problems FROM c""")
def conversation_records(spark, sf):
    turn, text = F.col("turn"), F.col("text")
    rows = scan(spark, sf, "conversations").select(
        "conv_id", "turn", _user(F.col("conv_id"), turn).alias("user_id"), F.when(turn % 4 != 3, F.repeat(F.concat(text, F.lit(" ")), 2)).alias("user_message"),
        F.concat(text, F.when(turn % 3 == 2, " ~").otherwise(" <em>a</em> & <p>")).alias("bot_response"),
        F.when(turn % 5 != 4, F.lit("2024-01-31").cast("timestamp_ntz")).alias("ts"), (F.char_length(text) * 8 - 400).cast("bigint").alias("token_count"),
        F.when(F.col("role") == "user", "high").when(F.col("role") == "system", "odd").alias("risk_level"))
    return _all(rows, D.CONVERSATION)


@query(f"""WITH e AS ({_E}), r AS (SELECT event_id, k * 60 AS max_message_length, v * 100 AS session_timeout, CASE WHEN k % 10 <> 0 THEN k * 11 ELSE 5 END AS rate_limit_per_hour FROM e)
 SELECT *, concat_ws('; ', CASE WHEN NOT max_message_length BETWEEN 100 AND 5000 THEN 'max_message_length: out_of_range' END,
  CASE WHEN NOT session_timeout BETWEEN 300 AND 86400 THEN 'session_timeout: out_of_range' END,
  CASE WHEN NOT rate_limit_per_hour BETWEEN 10 AND 1000 THEN 'rate_limit_per_hour: out_of_range' END) AS problems FROM r""")
def settings_records(spark, sf):
    k = F.col("k")
    rows = _events(spark, sf).select("event_id", (k * 60).alias("max_message_length"), (F.col("v") * 100).alias("session_timeout"),
                                     F.when(k % 10 != 0, k * 11).otherwise(5).alias("rate_limit_per_hour"))
    return _all(rows, D.SETTINGS)


@query(f"""WITH e AS ({_E}) SELECT event_id, coalesce(CASE k % 4 WHEN 0 THEN 'redis' WHEN 1 THEN t END, 'all') AS component,
 CASE WHEN k % 4 = 1 THEN 'component: not_allowed' ELSE '' END AS problems FROM e""")
def health_check_records(spark, sf):
    k = F.col("k")
    return _all(_events(spark, sf).select("event_id", F.when(k % 4 == 0, "redis").when(k % 4 == 1, F.col("t")).alias("component")), D.HEALTH_CHECK)
