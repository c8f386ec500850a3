"""Checked queries of T1-T13, D1-D9 and D17-D20."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.functions import screening as G
from chatlake.functions import text as T
from chatlake.operators import chunking as H
from chatlake.plans.registry import query
from chatlake.plans.risk_queries import tokens_sql
from chatlake.sources import adapters as S
from chatlake.sources.tables import scan

_WS = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8195) || chr(8232) || chr(12288)"


def _lines(t: str) -> str:
    return (rf"list_filter(list_transform(regexp_split_to_array({t}, '[\n\r\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]'), "
            f"lambda x: trim(x, {_TRIM})), lambda x: x <> '')")


_NOISE = "(?i)" + "|".join(f"(?:{p})" for p in T.NOISE_LINES)
_MD = r"""regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '&nbsp;?', ' ', 'gi'), '!\[[^\]]*\]\([^)]+\)', ' ', 'g'),
 '\[([^\]]+)\]\([^)]+\)', '\1', 'g')"""
_CLEAN = f"array_to_string(list_filter({_lines(_MD)}, lambda x: NOT regexp_matches(x, '{_NOISE}')), chr(10))"
_TOK = r"len(regexp_extract_all({t}, '[A-Za-z0-9_]+|[\x{{0E00}}-\x{{0E7F}}]'))"


def corpus(spark, sf):
    return S.corpus(spark, sf)


@query(f"SELECT doc_id, array_to_string({_lines('text')}, chr(10)) AS body FROM documents")
def normalised_text(spark, sf):
    return corpus(spark, sf).select("doc_id", T.normalise(F.col("text")).alias("body"))


@query(f"SELECT doc_id, {_CLEAN} AS body FROM documents")
def clean_text(spark, sf):
    return corpus(spark, sf).select("doc_id", T.sanitise(F.col("text")).alias("body"))


@query(rf"""WITH c AS (SELECT doc_id, {_CLEAN} AS body FROM documents) SELECT doc_id, body = '' OR regexp_matches(body, '{_NOISE}')
 OR ({_TOK.format(t='body')} < 6 AND len(regexp_extract_all(body, '[A-Za-z\x{{0E00}}-\x{{0E7F}}]')) < 24) AS low_signal FROM c""")
def low_signal_documents(spark, sf):
    cleaned = corpus(spark, sf).select("doc_id", T.sanitise(F.col("text")).alias("body"))
    return cleaned.select("doc_id", T.is_low_signal(F.col("body")).alias("low_signal"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{0E00}-\x{0E7F}]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed'
 WHEN regexp_matches(text, '[\x{0E00}-\x{0E7F}]') THEN 'th' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language FROM documents""")
def language(spark, sf):
    return scan(spark, sf, "documents").select("doc_id", T.language(F.col("text")).alias("language"))


@query(f"""SELECT doc_id, {tokens_sql('text')} AS estimated, CAST({_TOK.format(t='text')} AS INTEGER) AS tokens,
 least(500, CAST(floor({tokens_sql('text')} * 0.7::DOUBLE) AS BIGINT)) AS completion FROM documents""")
def token_counts(spark, sf):
    estimated = T.estimate_tokens(F.col("text"))
    return corpus(spark, sf).select(
        "doc_id", estimated.alias("estimated"), T.token_count(F.col("text")).alias("tokens"),
    ).withColumn("completion", T.estimate_completion(F.col("estimated")))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '<(/?)(b|i|u|strong|em)(?:[\s/][^>]*)?>', chr(57344) || '\1\2' || chr(57345), 'gi') AS h FROM pages),
 b AS (SELECT page_id, regexp_replace(regexp_replace(h, '<[^>]*>', '', 'g'), '&(#?[A-Za-z0-9]+;)', chr(57346) || '\1', 'g') AS h FROM a)
 SELECT page_id, translate(replace(replace(replace(h, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(57344) || chr(57345) || chr(57346), '<>&') AS body FROM b""")
def html_strip(spark, sf):
    return S.raw_html(spark, sf).select("page_id", T.sanitise_html(F.col("html")).alias("body"))


@query(r"""WITH p AS (SELECT conv_id, turn, 'Assistant: <|x|>' || text || chr(10) || chr(10) || chr(10) || chr(10) || '<|start_header_id|>y<|end_header_id|> end' AS t FROM conversations),
 a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(t, '<\|start_header_id\|>[^\n]*?<\|end_header_id\|>\s*', '', 'g'), '<\|[^\n]*?\|>', '', 'g') AS t FROM p)
 SELECT conv_id, turn, trim(regexp_replace(regexp_replace(t, '^assistant\s*:\s*', '', 'i'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS body FROM a""")
def clean_output(spark, sf):
    raw = F.concat(F.lit("Assistant: <|x|>"), F.col("text"), F.lit("\n\n\n\n<|start_header_id|>y<|end_header_id|> end"))
    return S.messages(spark, sf).select("conv_id", "turn", T.clean_output(raw).alias("body"))


@query("SELECT doc_id, substr(translate(text, ';<>&$()', ''), 1, 1000) AS body FROM documents")
def basic_sanitise(spark, sf):
    return scan(spark, sf, "documents").select("doc_id", T.sanitise_basic(F.col("text")).alias("body"))


@query("""SELECT event_id, event_type, substr(p, 1, 4) || repeat('*', length(p) - 8) || right(p, 4) AS api_key, '***' AS secret_part FROM (
 SELECT event_id, event_type, event_type || '-' || props AS p FROM events)""")
def masked_secrets(spark, sf):
    entries = F.create_map(F.lit("Api_Key"), F.concat("event_type", F.lit("-"), "props"), F.lit("kind"), F.col("event_type"), F.lit("my_secret"), F.lit("abc"))
    masked = T.mask_map(entries)
    return scan(spark, sf, "events").select("event_id", masked["kind"].alias("event_type"), masked["Api_Key"].alias("api_key"), masked["my_secret"].alias("secret_part"))


@query("""SELECT event_id, regexp_matches('U' || substr(sha256(CAST(user_id AS VARCHAR)), 1, CASE WHEN event_type = 'view' THEN 31 ELSE 32 END), '^U[a-f0-9]{32}$') AS valid,
 strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events""")
def id_and_time_formats(spark, sf):
    size = F.when(F.col("event_type") == "view", 31).otherwise(32)
    uid = F.concat(F.lit("U"), F.substring(F.sha2(F.col("user_id").cast("string"), 256), F.lit(1), size))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return scan(spark, sf, "events").select("event_id", T.is_user_id(uid).alias("valid"), T.epoch_text(seconds).alias("shown"))


@query(r"""
SELECT page_id, regexp_replace(list_extract(string_split(translate(url, 'aeiou?', 'ไทéß中\ '), '/'), -1), '[^\p{L}\p{N}._-]', '', 'g') AS file_name
FROM pages""")
def safe_file_names(spark, sf):
    """T13 over names with letters of several scripts and back slashes, made from the addresses."""
    names = F.translate("url", "aeiou?", "ไทéß中\\ ")
    return S.raw_html(spark, sf).select("page_id", T.safe_filename(names).alias("file_name"))


def _re2(pattern: str) -> str:
    return "(?im)" + pattern.replace(".{", r"[^\n]{").replace(".*?", r"[^\n]*?").replace(r"\s", f"[{_WS}]")


def _screen_sql(t: str) -> str:
    high = "\n".join(f"WHEN contains(lower({t}), '{p}') THEN 'high_risk_keyword: {p}'" for p in G.HIGH_PHRASES)
    pats = "\n".join(f"WHEN regexp_matches({t}, '{_re2(p)}') THEN 'pattern_match: {p[:50]}...'" for p in G.INJECTION_PATTERNS)
    med = "\n".join(f"WHEN contains(lower({t}), '{p}') THEN 'medium_risk_keyword: {p}'" for p in G.MEDIUM_PHRASES)
    leak = "\n".join(f"WHEN regexp_matches({t}, '{_re2(p)}') THEN 'prompt_leakage_attempt'" for p in G.LEAK_PATTERNS)
    special = rf"len(regexp_extract_all({t}, '[^\p{{L}}\p{{N}}\x{{0E00}}-\x{{0E7F}}{_WS}]')) / length({t})"
    breaks = rf"len(regexp_extract_all({t}, '\n'))"
    return f"""CASE WHEN trim({t}) = '' THEN '' {high} {pats} {med}
 WHEN length({t}) > 50 AND {special} > 0.3 THEN 'high_special_char_ratio: ' || printf('%.2f', {special})
 WHEN length({t}) > 50 AND {breaks} / length({t}) > 0.15 THEN 'excessive_newlines: ' || CAST({breaks} AS VARCHAR) {leak} ELSE '' END"""


_LEVEL = """CASE WHEN reason = '' THEN 'none' WHEN starts_with(reason, 'high_risk') OR starts_with(reason, 'pattern') THEN 'high' ELSE 'medium' END"""


@query(f"WITH r AS (SELECT conv_id, turn, {_screen_sql('text')} AS reason FROM conversations) SELECT conv_id, turn, reason <> '' AS flagged, {_LEVEL} AS level, reason FROM r")
def injection_flags(spark, sf):
    return S.messages(spark, sf).select("conv_id", "turn", G.screen(F.col("text")).alias("v")).select("conv_id", "turn", "v.*")


@query(f"WITH r AS (SELECT page_id, {_screen_sql('html')} AS reason FROM pages) SELECT page_id, {_LEVEL} AS level, reason FROM r")
def page_screening(spark, sf):
    return S.raw_html(spark, sf).select("page_id", G.screen(F.col("html")).alias("v")).select("page_id", "v.level", "v.reason")


@query(rf"""WITH a AS (SELECT page_id, regexp_replace(html, '---+|===+|###', ' ', 'g') AS t FROM pages),
 b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?s)```.*?```', '[code removed]', 'g'), '</?(?:system|user|assistant|human)>', '', 'gi'), '<\|[^\n]*?\|>', '', 'g') AS t FROM a)
 SELECT page_id, trim(regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '[{_WS}]{{3,}}', '  ', 'g'), {_TRIM}) AS body FROM b""")
def prompt_cleaning(spark, sf):
    return S.raw_html(spark, sf).select("page_id", G.clean_prompt(F.col("html")).alias("body"))


@query(rf"""WITH m AS (SELECT conv_id, turn, text, 'U' || substr(sha256(CAST(conv_id AS VARCHAR)), 1, CASE WHEN role = 'system' THEN 20 ELSE 32 END) AS u, {_screen_sql('text')} AS reason FROM conversations)
 SELECT conv_id, turn, concat_ws('; ', CASE WHEN NOT regexp_matches(u, '^U[0-9a-f]{{32}}$') THEN 'user_id: invalid_format' END,
 CASE WHEN NOT (length(text) BETWEEN 1 AND 2000) THEN 'message: length' END,
 CASE WHEN NOT regexp_matches(text, '^[\x{{0E00}}-\x{{0E7F}}{_WS}\p{{L}}\p{{N}}_.,!?()\[\]{{}}:;''"@#$%^&*+=<>/-]*$') THEN 'message: invalid_characters' END,
 CASE WHEN {_LEVEL} = 'high' THEN 'message: injection' END,
 CASE WHEN regexp_matches(text, '(?i)<script[^>]*>[^\n]*?</script>|javascript:|on[\p{{L}}\p{{N}}_]+\s*=|<iframe|<object|<embed') THEN 'message: script_injection' END) AS errors FROM m""")
def validation(spark, sf):
    size = F.when(F.col("role") == "system", 20).otherwise(32)
    uid = F.concat(F.lit("U"), F.substring(F.sha2(F.col("conv_id").cast("string"), 256), F.lit(1), size))
    rows = S.messages(spark, sf).withColumn("u", uid)
    return rows.select("conv_id", "turn", F.array_join(G.user_message_errors(F.col("u"), F.col("text")), "; ").alias("errors"))


@query("""SELECT page_id, concat_ws('; ', CASE WHEN lower(split_part(url, ':', 1)) NOT IN ('https') THEN 'url: disallowed_scheme' END,
 CASE WHEN regexp_matches(lower(url), 'javascript:|data:|vbscript:|file:|ftp:|<script|%3cscript') THEN 'url: dangerous_content' END) AS errors FROM pages""")
def url_validation(spark, sf):
    checks = G.errors(G.url_errors(F.col("url"), ("https",)))
    return S.raw_html(spark, sf).select("page_id", F.array_join(checks, "; ").alias("errors"))


@query(rf"""SELECT doc_id, trim(regexp_replace(text, '[{_WS}]+', ' ', 'g'), {_TRIM}) AS body FROM documents""")
def squeezed_text(spark, sf):
    return corpus(spark, sf).select("doc_id", T.squeeze(F.col("text")).alias("body"))


@query()
def nfkc_text(spark, sf):
    """SQL has no compatibility normalisation; tested against Python in the test suite."""
    return corpus(spark, sf).select("doc_id", T.sanitise_string(F.col("text")).alias("body"))


@query("""SELECT doc_id, CASE WHEN contains(s, 'relapse') THEN 'relapse' WHEN contains(s, 'crisis') THEN 'crisis' WHEN contains(s, 'cbt') THEN 'cbt_dbt' ELSE 'general' END AS topic,
 CASE WHEN contains(s, 'relapse') THEN 'relapse_reference' WHEN contains(s, 'manual') THEN 'broad_reference' ELSE 'general_reference' END AS kind,
 CASE WHEN contains(s, 'relapse') THEN 1.1 WHEN contains(s, 'manual') THEN 0.86 ELSE 1.0 END AS weight
 FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'Relapse_' WHEN 'de' THEN 'crisis_' WHEN 'fr' THEN 'CBT_' ELSE '' END || source AS s0, lower(s0) AS s FROM documents)""")
def source_labels(spark, sf):
    name = F.concat(F.when(F.col("lang") == "en", "Relapse_").when(F.col("lang") == "de", "crisis_").when(F.col("lang") == "fr", "CBT_").otherwise(""), F.col("source"))
    profile = H.source_profile(name)
    return scan(spark, sf, "documents").select("doc_id", H.topic(name).alias("topic"), profile["kind"].alias("kind"), profile["weight"].alias("weight"))


@query(f"""WITH c AS (SELECT doc_id, {_CLEAN} AS body FROM documents) SELECT doc_id, CASE WHEN body = '' OR regexp_matches(body, '{_NOISE}')
 OR ({_TOK.format(t='body')} < 6 AND len(regexp_extract_all(body, '[A-Za-z]')) < 24) THEN '' ELSE body END AS body FROM c""")
def document_text(spark, sf):
    return H.document_text(corpus(spark, sf)).select("doc_id", F.col("text").alias("body"))


@query()
def chunks(spark, sf):
    """Packing with overlap has no SQL form; tested against a brute-force restatement."""
    return H.chunks(corpus(spark, sf)).select("doc_id", "doc_name", "chunk_index", "content", "metadata.*")


@query()
def small_chunks(spark, sf):
    """Character mode, tested like `chunks`."""
    return H.chunks(corpus(spark, sf), size=200, overlap=20).select("doc_id", "chunk_index", "content")
