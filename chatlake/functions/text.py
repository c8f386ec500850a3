"""Text primitives: whitespace, token counts, cleaning, masking, formats."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Java's \s is ASCII; these are the members of Unicode white space, as a regex class body and as characters.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_CHARS = "".join(
    chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                     0x202F, 0x205F, 0x3000]
)
LINE_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
THAI = r"\x{0E00}-\x{0E7F}"
WORD_CHAR = r"\p{L}\p{N}_"

# Line patterns (matched on a stripped line, ignoring case) that mark boiler-plate.
NOISE_LINES = (
    rf"^source[{WS}]*:",
    r"^table of contents$",
    r"^contents$",
    r"^copyright(?:$|[^\p{L}\p{N}_])",
    r"^all rights reserved(?:$|[^\p{L}\p{N}_])",
    r"^library of congress(?:$|[^\p{L}\p{N}_])",
    r"^a cip record(?:$|[^\p{L}\p{N}_])",
    r"^isbn(?:$|[^\p{L}\p{N}_])",
    r"^printed in(?:$|[^\p{L}\p{N}_])",
    rf"^cover design[{WS}]*:",
    r"^(?:https?://|www\.)",
    r"^[ivxlcdm]+$",
    r"^\p{Nd}+$",
    r"^[^A-Za-z\x{0E00}-\x{0E7F}]{3,}$",
    rf"\.{{3,}}[{WS}]*[A-Za-z0-9]+$",
)
# Section titles that carry no content.
NOISE_TITLES = (
    "about the authors", "acknowledgements", "acknowledgments", "bibliography", "contents", "contributors",
    "copyright", "foreword", "index", "library of congress cataloging in publication data", "preface",
    "table of contents",
)
# Key fragments of secret-bearing fields.
SECRET_KEYS = ("api_key", "password", "secret", "token", "access_token")
# Tags a cleaned message may keep.
ALLOWED_TAGS = ("b", "i", "u", "strong", "em")

# One anchor for all line patterns: the matcher then gives up after the first position.
NOISE_PATTERN = "(?i)^(?:" + "|".join(p[1:] for p in NOISE_LINES[:-1]) + ")"
LEADER_PATTERN = NOISE_LINES[-1]
TOKEN_PATTERN = rf"[A-Za-z0-9_]+|[{THAI}]"


def strip(text: Column) -> Column:
    """Trim Unicode white space from both ends."""
    return F.btrim(text, F.lit(WS_CHARS))


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return strip(F.regexp_replace(text, f"[{WS}]+", " "))


def lines(text: Column) -> Column:
    """Stripped, non-empty lines."""
    return F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda x: x != "")


def normalise(text: Column) -> Column:
    """Trimmed lines without blanks."""
    return F.array_join(lines(text), "\n")


def strip_markdown(text: Column) -> Column:
    """Drop images and hard blanks, keep link labels."""
    out = F.replace(text, F.lit("\u00a0"), F.lit(" "))
    out = F.when(F.contains(out, F.lit("&")), F.regexp_replace(out, r"(?i)&nbsp;?", " ")).otherwise(out)
    plain = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]+\)", " ")
    plain = F.regexp_replace(plain, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.when(F.contains(out, F.lit("](")), plain).otherwise(out)


def is_noise(line: Column) -> Column:
    """D3: empty or boiler-plate; expects a stripped line (or a whole stripped chunk)."""
    return (line == "") | line.rlike(NOISE_PATTERN) | (F.contains(line, F.lit("...")) & line.rlike(LEADER_PATTERN))


def sanitise(text: Column) -> Column:
    """Markdown artefacts and noise lines removed, then normalised."""
    return F.array_join(F.filter(lines(strip_markdown(text)), lambda x: ~is_noise(x)), "\n")


def token_count(text: Column) -> Column:
    """ASCII words plus single Thai characters."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_PATTERN)), F.lit(0))


def has_tokens(text: Column, n: int) -> Column:
    """Whether a text has at least ``n`` tokens; stops reading at the n-th."""
    word = "A-Za-z0-9_"
    return text.rlike(rf"\A[^{word}{THAI}]*+(?:(?:[{word}]++|[{THAI}])[^{word}{THAI}]*+){{{n}}}")


def is_low_signal(text: Column) -> Column:
    """Empty, noise, or too short to say anything; expects a stripped text."""
    letters = text.rlike(rf"\A[^A-Za-z{THAI}]*+(?:[A-Za-z{THAI}][^A-Za-z{THAI}]*+){{24}}")
    return is_noise(text) | (~has_tokens(text, 6) & ~letters)


def normalise_title(title: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(strip(title)), rf"[^a-z0-9{WS}]", " "))


def is_noise_title(title: Column) -> Column:
    return normalise_title(title).isin(*NOISE_TITLES)


def language(text: Column) -> Column:
    """Th / en / mixed / unknown by script."""
    thai, latin = text.rlike(f"[{THAI}]"), text.rlike("[A-Za-z]")
    return (
        F.when(thai & latin, "mixed").when(thai, "th").when(latin, "en").otherwise("unknown")
    )


def estimate_tokens(text: Column) -> Column:
    """Weighted character classes; 0 for an empty text, at least 1 otherwise."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    weighted = (
        count(f"[{THAI}]") * F.lit(1.2) + count("[a-zA-Z]+") * F.lit(0.6)
        + count("[0-9]+") + count(rf"[^{WORD_CHAR}{WS}{THAI}]")
    )
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast("bigint"))
        .otherwise(F.greatest(F.lit(1).cast("bigint"), weighted.cast("bigint")))
    )


def estimate_completion(prompt_tokens: Column, max_output: int = 500) -> Column:
    """T2."""
    return F.least(F.lit(max_output).cast("bigint"), F.floor(prompt_tokens * F.lit(0.7)).cast("bigint"))


def clean_output(text: Column) -> Column:
    """T4: header tags, special tokens, a leading speaker name and spare blank lines removed."""
    out = F.coalesce(text, F.lit(""))
    for pattern in (
        rf"<\|start_header_id\|>[^\n]*?<\|end_header_id\|>[{WS}]*",
        r"<\|[^\n]*?\|>",
        rf"(?i)^assistant[{WS}]*\n+",
        rf"(?i)^assistant[{WS}]*:[{WS}]*",
        rf"(?i)^assistant[{WS}]+",
    ):
        out = F.regexp_replace(out, pattern, "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def sanitise_basic(text: Column, limit: int = 1000) -> Column:
    """T5: drop shell and SQL metacharacters, then cut."""
    return F.substring(F.translate(text, ";<>&$()", ""), 1, limit)


def mask_value(value: Column) -> Column:
    stars = lambda n: F.repeat(F.lit("*"), n)
    size = F.char_length(value)
    return (
        F.when(size > 8, F.concat(F.substring(value, 1, 4), stars(size - 8), F.right(value, F.lit(4))))
        .otherwise(stars(size))
    )


def is_secret_key(key: Column) -> Column:
    found = F.lit(False)
    for part in SECRET_KEYS:
        found = found | F.lower(key).contains(part)
    return found


def mask_map(entries: Column) -> Column:
    """MAP<STRING, STRING> with secret-bearing values starred out."""
    return F.transform_values(entries, lambda k, v: F.when(is_secret_key(k), mask_value(v)).otherwise(v))


def mask_nested(entries: Column) -> Column:
    """T6 one level down: MAP<STRING, MAP<STRING, STRING>>."""
    return F.transform_values(entries, lambda _, inner: mask_map(inner))


def is_user_id(value: Column) -> Column:
    """U followed by 32 lower-case hex digits."""
    return value.rlike(r"^U[a-f0-9]{32}$")


def epoch_text(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """T8."""
    return F.date_format(F.timestamp_seconds(seconds), pattern)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normalisation. Spark has no such expression, so this is an Arrow batch UDF."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def sanitise_html(text: Column, allowed: tuple[str, ...] = ALLOWED_TAGS) -> Column:
    """Keep allowed tags without attributes, drop the others, escape stray markup characters."""
    names = "|".join(allowed)
    out = F.regexp_replace(text, rf"(?i)<(/?)({names})(?:[{WS}/][^>]*)?>", "\ue000$1$2\ue001")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    out = F.regexp_replace(out, r"&(#?[A-Za-z0-9]+;)", "\ue002$1")
    out = escape_markup(out)
    return F.translate(out, "\ue000\ue001\ue002", "<>&")


def escape_markup(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def sanitise_string(text: Column, *, unicode: bool = True) -> Column:
    """Normal form (or ASCII only), squeezed, tags cleaned, escaped."""
    out = nfkc(text) if unicode else F.regexp_replace(text, r"[^\x00-\x7f]", "")
    return escape_markup(sanitise_html(squeeze(out)))


def safe_filename(name: Column) -> Column:
    """What follows the last slash, stripped and reduced to letters and numbers of any script, dot, underscore and hyphen."""
    return F.regexp_replace(strip(F.element_at(F.split(name, "/"), -1)), r"[^\p{L}\p{N}._-]", "")


def json_map(text: Column, schema: str = "MAP<STRING, STRING>") -> Column:
    """JSON object to map; broken or missing text gives an empty map."""
    return F.coalesce(F.from_json(text, schema), F.expr(f"cast(map() AS {schema})"))


def parse_timestamp(text: Column) -> Column:
    """ISO text to a zone-less timestamp; offsets are converted to UTC and dropped, bad text gives NULL."""
    zoned = text.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.try_to_timestamp(text).cast("timestamp_ntz")).otherwise(
        text.try_cast("timestamp_ntz")
    )


def lexical_tokens(text: Column) -> Column:
    """Q1: lower-cased words of two or more characters and Thai runs; long Thai runs add their 3-grams."""
    base = F.regexp_extract_all(F.lower(text), F.lit(rf"([A-Za-z0-9_]{{2,}}|[{THAI}]+)"), F.lit(1))

    def grams(token: Column) -> Column:
        size = F.char_length(token)
        return F.when(
            token.rlike(f"^[{THAI}]") & (size > 8),
            F.concat(F.array(token), F.transform(F.sequence(F.lit(1), size - 2), lambda i: F.substring(token, i, F.lit(3)))),
        ).otherwise(F.array(token))

    return F.when(
        F.exists(base, lambda t: t.rlike(f"^[{THAI}]") & (F.char_length(t) > 8)), F.flatten(F.transform(base, grams))
    ).otherwise(base)


def plain_tokens(text: Column) -> Column:
    """Query tokens without the 3-grams."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([A-Za-z0-9_]{{2,}}|[{THAI}]+)"), F.lit(1))
