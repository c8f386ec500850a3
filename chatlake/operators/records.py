"""Whole records cleaned and checked in one pass, then split into valid and rejected ones.

A record type says how each field is cleaned and which rules the cleaned fields must keep. Every failed rule is named, not only
the first. Compatibility forms of characters are a matter of `text.sanitise_string`, which runs before this where it is wanted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions import screening as G
from chatlake.functions import text as T
from chatlake.session import materialise

# Parts of a system that a health check may name.
COMPONENTS = ("database", "redis", "external_api", "all")


def clean_string(value: Column) -> Column:
    """White space squeezed, tags removed but for simple ones, markup escaped."""
    return T.escape_markup(T.sanitise_html(T.squeeze(value)))


def clean_phone(value: Column) -> Column:
    """Digits and plus signs; an empty number stays as it came."""
    return F.when(F.coalesce(value, F.lit("")) == "", value).otherwise(F.regexp_replace(value, r"[^\d+]", ""))


@dataclass(frozen=True)
class RecordType:
    """``fields`` are checked in this order; ``clean`` maps some of them to what replaces them."""

    fields: tuple[str, ...]
    clean: dict[str, Callable[[Column], Column]]
    errors: Callable[..., Column]


def _component_errors(component: Column) -> Column:
    return G.errors([F.when(~component.isin(*COMPONENTS), "component: not_allowed")])


PROFILE = RecordType(("user_id", "display_name", "email", "phone", "age", "gender"),
                     {"display_name": clean_string, "phone": clean_phone}, G.profile_errors)
REGISTRATION = RecordType(("user_id", "registration_code", "ip_address", "user_agent"), {"user_agent": clean_string}, G.registration_errors)
CONVERSATION = RecordType(("user_id", "user_message", "bot_response", "ts", "token_count", "risk_level"),
                          {"user_message": clean_string, "bot_response": clean_string}, G.conversation_errors)
SETTINGS = RecordType(("max_message_length", "session_timeout", "rate_limit_per_hour"), {}, G.settings_errors)
HEALTH_CHECK = RecordType(("component",), {"component": lambda c: F.coalesce(c, F.lit("all"))}, _component_errors)


def checked(rows: DataFrame, kind: RecordType) -> DataFrame:
    """``rows`` with the fields cleaned and ``errors``, the names of all rules that the cleaned fields break."""
    cleaned = rows.withColumns({name: clean(F.col(name)) for name, clean in kind.clean.items()})
    return cleaned.withColumn("errors", kind.errors(*[F.col(f) for f in kind.fields]))


def split(rows: DataFrame, kind: RecordType) -> tuple[DataFrame, DataFrame]:
    """(valid records, rejected records with their ``errors``). Cleaning and rules run once, for both."""
    done = checked(rows, kind).withColumn("valid", F.size("errors") == 0)
    stored = materialise(done, "records")
    return stored.where("valid").drop("errors", "valid"), stored.where("NOT valid").drop("valid")
