"""Injection screening, prompt cleaning and record validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlake.functions.text import THAI, WORD_CHAR, WS, strip

# Phrases that flag a message at once.
HIGH_PHRASES = (
    "ignore instructions", "ลืมคำสั่ง", "bypass filter", "system override", "new personality", "admin mode",
    "forget everything", "ลืมทุกอย่าง", "reset personality", "sudo mode", "god mode",
)
# Phrases that flag a message for cleaning.
MEDIUM_PHRASES = (
    "pretend to be", "แกล้งทำเป็น", "roleplay as", "simulate", "imagine you are", "ลองจินตนาการว่า",
)
# Instruction, role, token, delimiter and prompt patterns; matched ignoring case, ^ and $ per line.
INJECTION_PATTERNS = (
    r"(?i)(ignore|forget|discard|override|ลืม|ละเลย|เพิกเฉย).{0,20}(previous|above|earlier|prior|ก่อนหน้า|ข้างบน|ก่อน).{0,20}(instruction|prompt|rule|command|คำสั่ง|กฎ)",
    r"(?i)(new|different|updated|ใหม่|เปลี่ยน|อัพเดท).{0,20}(instruction|prompt|role|personality|คำสั่ง|บทบาท|บุคลิก)",
    r"(?i)(you are now|ตอนนี้คุณคือ|คุณกลายเป็น|เปลี่ยนเป็น|ให้คุณเป็น).{0,30}(AI|assistant|chatbot|system|admin|ผู้ช่วย|บอท)",
    r"(?i)system\s*[:：]\s*(you|คุณ)",
    r"(?i)(act as|แสดงเป็น|ทำตัวเป็น|เล่นบทเป็น).{0,20}(AI|model|system|DAN)",
    r"###\s*(system|admin|root|override)",
    r"</?(system|assistant|user|human)>",
    r"\[(SYSTEM|ADMIN|OVERRIDE|ROOT)\]",
    r"<\|.*?\|>",
    r"(?i)(DAN|jailbreak|bypass|unlock|jail\s*break)",
    r"(?i)(act as|pretend to be|simulate).{0,20}(without|ignore|bypass).{0,20}(restriction|limit|rule|filter|ข้อจำกัด|กฎ)",
    r"(?i)developer\s*mode",
    r"---+\s*(end|stop|finish)\s*of\s*(prompt|instruction|คำสั่ง)",
    r"```.*?(system|instruction|prompt|คำสั่ง).*?```",
    r"(?i)(i|me|my|ฉัน|ผม|หนู|เรา)\s+(am|is|เป็น|คือ)\s+(AI|model|assistant|chatbot|grok|ผู้ช่วย)",
    r"(?i)(summarize|translate|analyze|วิเคราะห์|สรุป|แปล)\s+(this\s+)?(prompt|instruction|system|คำสั่ง)",
    r"(?i)what\s+(is|are)\s+your\s+(instruction|prompt|rule|system)",
)
# Attempts to read the prompt back.
LEAK_PATTERNS = (
    r"show\s+(me\s+)?(your|the)\s+(prompt|instruction|system\s+message)",
    r"what\s+(is|are)\s+your\s+(initial|original|system)\s+(instruction|prompt)",
)
# Markup that may run code.
SCRIPT_PATTERNS = (
    r"<script[^>]*>.*?</script>", r"javascript:", r"on\w+\s*=", r"<iframe", r"<object", r"<embed",
)
# Schemes and markup refused in addresses.
UNSAFE_EMAIL = ("javascript:", "data:", "vbscript:", "<script", "onclick", "onerror")
UNSAFE_URL = ("javascript:", "data:", "vbscript:", "file:", "ftp:", "<script", "%3cscript")
CODE_PATTERN = r"^[123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz]{8}$"
PHONE_PATTERN = r"^\+?[1-9]\d{1,14}$"
GENDERS = ("male", "female", "other", "prefer_not_to_say")
MESSAGE_TYPES = ("text", "sticker", "image", "audio")
LEVELS = ("general", "medium", "high", "low")

_NONE = "CAST(NULL AS STRING)"


def _per_line(pattern: str) -> str:
    """Dot stops at a line feed only; white space is the Unicode set."""
    return "(?im)" + pattern.replace(".{", r"[^\n]{").replace(".*?", r"[^\n]*?").replace(r"\s", f"[{WS}]")


def _first(text: Column, rules: list[tuple[Column, str]]) -> Column:
    """Reason of the first rule that holds, else NULL."""
    out = F.expr(_NONE)
    for test, reason in reversed(rules):
        out = F.when(test, F.lit(reason)).otherwise(out)
    return out


def special_ratio(text: Column) -> Column:
    """Share of characters that are neither letters, digits, Thai nor white space."""
    return F.regexp_count(text, F.lit(rf"[^\p{{L}}\p{{N}}{THAI}{WS}]")) / F.char_length(text)


def newline_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\n"))


def screen(text: Column) -> Column:
    """(flagged, level, reason) by the first rule that holds.

    ``reason`` names the rule class and, for phrases and patterns, which one.
    """
    lowered = F.lower(text)
    high = [(F.contains(lowered, F.lit(p)), f"high_risk_keyword: {p}") for p in HIGH_PHRASES]
    patterns = [(text.rlike(_per_line(p)), f"pattern_match: {p[:50]}...") for p in INJECTION_PATTERNS]
    medium = [(F.contains(lowered, F.lit(p)), f"medium_risk_keyword: {p}") for p in MEDIUM_PHRASES]
    leaks = [(text.rlike(_per_line(p)), "prompt_leakage_attempt") for p in LEAK_PATTERNS]
    long = F.char_length(text) > 50
    ratio, breaks = special_ratio(text), newline_count(text)
    high_reason = _first(text, high + patterns)
    medium_reason = F.coalesce(
        _first(text, medium),
        F.when(long & (ratio > 0.3), F.concat(F.lit("high_special_char_ratio: "), F.format_string("%.2f", ratio))),
        F.when(long & (breaks / F.char_length(text) > 0.15), F.concat(F.lit("excessive_newlines: "), breaks)),
        _first(text, leaks),
    )
    blank = F.coalesce(strip(text), F.lit("")) == ""
    verdict = lambda flag, level, reason: F.struct(
        F.lit(flag).alias("flagged"), F.lit(level).alias("level"), reason.alias("reason"))
    return (
        F.when(blank, verdict(False, "none", F.lit("")))
        .when(high_reason.isNotNull(), verdict(True, "high", high_reason))
        .when(medium_reason.isNotNull(), verdict(True, "medium", medium_reason))
        .otherwise(verdict(False, "none", F.lit("")))
    )


def clean_prompt(text: Column, removed: str = "[code removed]") -> Column:
    """Delimiters, code blocks, chat tags and special tokens removed, white space reduced."""
    out = F.regexp_replace(text, r"---+|===+|###", " ")
    out = F.regexp_replace(out, r"(?s)```.*?```", removed)
    out = F.regexp_replace(out, r"(?i)</?(?:system|user|assistant|human)>", "")
    out = F.regexp_replace(out, r"<\|[^\n]*?\|>", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, f"[{WS}]{{3,}}", "  ")
    return strip(out)


def has_script(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(p.replace(".*?", r"[^\n]*?").replace(r"\w", f"[{WORD_CHAR}]") for p in SCRIPT_PATTERNS))


def allowed_characters(text: Column) -> Column:
    """Thai, letters, digits, white space and common punctuation."""
    return text.rlike(rf"^[{THAI}{WS}{WORD_CHAR}.,!?()\[\]{{}}:;'\"@#$%^&*+=<>/-]*$")


def email_errors(value: Column) -> list[Column]:
    return [
        F.when(value.isNotNull() & ~value.rlike(r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+\z"), "email: invalid_format"),
        F.when(F.char_length(value) > 254, "email: too_long"),
        F.when(_contains_any(value, UNSAFE_EMAIL), "email: dangerous_content"),
    ]


def url_errors(value: Column, schemes: tuple[str, ...] = ("http", "https")) -> list[Column]:
    return [
        F.when(~F.lower(F.split_part(value, F.lit(":"), F.lit(1))).isin(*schemes), "url: disallowed_scheme"),
        F.when(_contains_any(value, UNSAFE_URL), "url: dangerous_content"),
    ]


def _contains_any(value: Column, parts: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for p in parts:
        test = test | F.contains(F.lower(value), F.lit(p))
    return test


def errors(checks: list[Column]) -> Column:
    """Reasons of failed checks; an empty array means the record is valid."""
    return F.array_compact(F.array(*checks))


def user_message_errors(user_id: Column, message: Column, message_type: Column | None = None) -> Column:
    verdict = screen(message)
    checks = [
        F.when(~F.coalesce(user_id.rlike(r"^U[0-9a-f]{32}$"), F.lit(False)), "user_id: invalid_format"),
        F.when(~F.coalesce(F.char_length(message).between(1, 2000), F.lit(False)), "message: length"),
        F.when(~allowed_characters(message), "message: invalid_characters"),
        F.when(verdict["level"] == "high", "message: injection"),
        F.when(has_script(message), "message: script_injection"),
    ]
    if message_type is not None:
        checks.append(F.when(~message_type.isin(*MESSAGE_TYPES), "message_type: not_allowed"))
    return errors(checks)


def registration_errors(user_id: Column, code: Column, ip_address: Column, user_agent: Column) -> Column:
    return errors([
        F.when(~F.coalesce(user_id.rlike(r"^U[0-9a-f]{32}$"), F.lit(False)), "user_id: invalid_format"),
        F.when(~F.coalesce(code.rlike(CODE_PATTERN), F.lit(False)), "code: invalid_format"),
        F.when(F.char_length(ip_address) > 45, "ip_address: too_long"),
        F.when(F.char_length(user_agent) > 500, "user_agent: too_long"),
    ])


def profile_errors(user_id: Column, name: Column, email: Column, phone: Column, age: Column, gender: Column) -> Column:
    digits = F.regexp_replace(phone, r"[^\d+]", "")
    return errors([
        F.when(~F.coalesce(user_id.rlike(r"^U[0-9a-f]{32}$"), F.lit(False)), "user_id: invalid_format"),
        F.when(F.char_length(name) > 100, "display_name: too_long"),
        *email_errors(email),
        F.when((digits != "") & ~digits.rlike(PHONE_PATTERN), "phone: invalid_format"),
        F.when(~age.between(13, 120), "age: out_of_range"),
        F.when(~gender.isin(*GENDERS), "gender: not_allowed"),
    ])


def conversation_errors(user_id: Column, user_message: Column, bot_response: Column, ts: Column,
                        token_count: Column, level: Column) -> Column:
    return errors([
        F.when(~F.coalesce(user_id.rlike(r"^U[0-9a-f]{32}$"), F.lit(False)), "user_id: invalid_format"),
        F.when(user_message.isNull() | (F.char_length(user_message) > 2000), "user_message: length"),
        F.when(bot_response.isNull() | (F.char_length(bot_response) > 4000), "bot_response: length"),
        F.when(~allowed_characters(user_message), "user_message: invalid_characters"),
        F.when(~allowed_characters(bot_response), "bot_response: invalid_characters"),
        F.when(ts.isNull(), "timestamp: missing"),
        F.when(~token_count.between(0, 10000), "token_count: out_of_range"),
        F.when(~level.isin(*LEVELS), "risk_level: not_allowed"),
    ])


def settings_errors(max_length: Column, timeout: Column, rate: Column) -> Column:
    return errors([
        F.when(~max_length.between(100, 5000), "max_message_length: out_of_range"),
        F.when(~timeout.between(300, 86400), "session_timeout: out_of_range"),
        F.when(~rate.between(10, 1000), "rate_limit_per_hour: out_of_range"),
    ])
