"""Term lists are parameters. The defaults below are small and meant to be replaced by the caller's lists."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


def _clean(terms: Iterable[str]) -> tuple[str, ...]:
    """Lower-case, one kind of apostrophe, first occurrence of each term in order."""
    return tuple(dict.fromkeys(t.lower().replace("’", "'") for t in terms))


def is_boundary_term(term: str) -> bool:
    """Very short ASCII words only count when they stand alone."""
    return term.isascii() and term.isalpha() and len(term) <= 3


@dataclass(frozen=True)
class Lexicon:
    """Risk terms by level, the sub-category sets and the negation prefixes."""

    high: tuple[str, ...]
    medium: tuple[str, ...]
    negations: tuple[str, ...] = ()
    suicide: tuple[str, ...] = ()
    overdose: tuple[str, ...] = ()
    substance_signals: tuple[str, ...] = ()
    negation_window: int = 12
    medium_to_high: int = 2

    def __post_init__(self):
        for name in ("high", "medium", "negations", "suicide", "overdose", "substance_signals"):
            object.__setattr__(self, name, _clean(getattr(self, name)))


DEFAULT = Lexicon(
    high=("suicide", "kill myself", "end my life", "want to die", "kms", "overdose", "can't breathe", "unconscious",
          "อยากตาย", "ฆ่าตัวตาย", "หมดสติ", "🔪"),
    medium=("stress", "stressed", "anxious", "anxiety", "lonely", "hopeless", "relapse", "craving", "withdrawal",
            "can't sleep", "lsd", "เครียด", "กังวล", "เสพติด", "สารเสพติด", "💊", "😭"),
    negations=("not ", "never ", "don't ", "stopped ", "ไม่ได้", "ไม่เคย", "เลิก"),
    suicide=("suicide", "kill myself", "end my life", "want to die", "kms", "อยากตาย", "ฆ่าตัวตาย", "🔪"),
    overdose=("overdose", "can't breathe", "unconscious", "หมดสติ"),
    substance_signals=("relapse", "craving", "withdrawal", "lsd", "เสพ", "ยา"),
)


@dataclass(frozen=True)
class PriorityWords:
    """Words that raise a message's priority."""

    high: tuple[str, ...] = ("overdose", "emergency", "suicide", "bleeding", "coma", "ฉุกเฉิน", "อยากตาย")
    medium: tuple[str, ...] = ("stress", "anxious", "cravings", "เครียด", "กังวล")


@dataclass(frozen=True)
class IntentTerms:
    """What makes a message a request for information. ``patterns`` are regular expressions."""

    patterns: tuple[str, ...] = (
        r"what is|what are|explain|tell me about|side effects?|symptoms?|how to|difference between|treatment|withdrawal",
        r"คืออะไร|อธิบาย|ข้อมูล|รายละเอียด|อาการ|วิธี",
    )
    domain: tuple[str, ...] = ("relapse", "overdose", "withdrawal", "craving", "treatment", "symptom", "side effect",
                               "ยา", "กัญชา", "บำบัด")
    disclosure: tuple[str, ...] = ("i feel", "stressed", "help me", "รู้สึก", "เครียด")
    follow_up: tuple[str, ...] = ("and then", "more", "again", "เพิ่มเติม", "แล้ว")
    direct: tuple[str, ...] = ("what is", "explain", "คืออะไร", "อธิบาย")
    question: tuple[str, ...] = ("?", "ไหม", "มั้ย")


@dataclass(frozen=True)
class FacilityTerms:
    """R8d: questions about where a facility is."""

    facility: tuple[str, ...] = ("hospital", "clinic", "โรงพยาบาล", "คลินิก")
    location: tuple[str, ...] = ("location", "address", "where", "nearest", "near me", "close to", "อยู่ที่ไหน", "ใกล้ฉัน")
    ask: tuple[str, ...] = ("find", "recommend", "suggest", "help", "need", "want", "แนะนำ", "ขอ")
    place: tuple[str, ...] = ("where", "ที่", "ไหน")
