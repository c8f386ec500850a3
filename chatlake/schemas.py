"""Explicit schemas of the data model as DDL; nothing is inferred at read time."""

from __future__ import annotations

ACTIVITY = (
    "id BIGINT, user_id STRING, ts TIMESTAMP_NTZ, user_message STRING, bot_response STRING, "
    "token_count BIGINT, important_flag BOOLEAN"
)
MESSAGES = ("conv_id BIGINT, turn BIGINT, role STRING, text STRING")
FOLLOW_UPS = (
    "id BIGINT, user_id STRING, status STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, "
    "scheduled_date TIMESTAMP_NTZ"
)
USER_METRICS = ("id BIGINT, user_id STRING, metric_name STRING, metric_value DOUBLE, ts TIMESTAMP_NTZ")
REGISTRATION_CODES = (
    "code STRING, user_id STRING, created_at TIMESTAMP_NTZ, verified_at TIMESTAMP_NTZ, status STRING, "
    "form_data STRING"
)
MODEL_RUNS = (
    "id BIGINT, user_id STRING, ts TIMESTAMP_NTZ, best_provider STRING, best_score DOUBLE, all_scores STRING, "
    "providers_used INT, generation_time_ms DOUBLE, evaluation_time_ms DOUBLE, total_time_ms DOUBLE, "
    "token_usage STRING, provider_times STRING"
)
USER_CONSENT = (
    "user_id STRING, consent_given_at TIMESTAMP_NTZ, consent_revoked_at TIMESTAMP_NTZ, "
    "data_deleted_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)
PROGRESS = ("user_id STRING, ts TIMESTAMP_NTZ, risk_level STRING, keywords ARRAY<STRING>")
USAGE_EVENTS = (
    "event_id BIGINT, user_id STRING, ts TIMESTAMP_NTZ, model STRING, input_tokens BIGINT, output_tokens BIGINT, "
    "response_time_ms DOUBLE"
)
ALERTS = ("category STRING, severity STRING, ts TIMESTAMP_NTZ, text STRING, extra MAP<STRING, STRING>")
CHUNKS = (
    "doc_id STRING, doc_name STRING, chunk_index INT, content STRING, embedding ARRAY<FLOAT>, "
    "metadata STRUCT<source: STRING, source_path: STRING, chunk_in_segment: INT, segment_index: INT, "
    "segment_index_end: INT, section_title: STRING, page_start: INT, page_end: INT, language: STRING, "
    "char_count: INT, token_count: INT, topic: STRING, source_kind: STRING, source_weight: DOUBLE>"
)
EVENTS = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)

#: Shapes of the JSON columns of MODEL_RUNS.
SCORES_JSON = "MAP<STRING, DOUBLE>"
TOKENS_JSON = "MAP<STRING, STRUCT<prompt: BIGINT, completion: BIGINT, total: BIGINT>>"
TIMES_JSON = "MAP<STRING, STRUCT<gen_ms: DOUBLE, eval_ms: DOUBLE>>"
