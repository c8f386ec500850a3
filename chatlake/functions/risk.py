"""Risk scoring expressions (R2-R8d): native higher-order functions over a literal lexicon."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlake.functions.binding import let
from chatlake.functions.lexicon import FacilityTerms, IntentTerms, Lexicon, PriorityWords, is_boundary_term
from chatlake.functions.text import WORD_CHAR, squeeze

_HIT = "STRUCT<pos: INT, term: STRING, negated: BOOLEAN>"


def literal_array(terms: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(t) for t in terms]) if terms else F.expr("cast(array() AS ARRAY<STRING>)")


def any_term(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether any of a few terms occurs; one alternation scans the text once."""
    if not terms:
        return F.lit(False)
    return text.rlike("|".join(_quote(t) for t in terms))


def _quote(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", term)


def _alone(term: str) -> str:
    return rf"(?<![{WORD_CHAR}]){term}(?![{WORD_CHAR}])"


def _negated(prefix: Column, lexicon: Lexicon) -> Column:
    """A negation ends exactly where the term starts, within the window before it."""
    usable = tuple(n for n in lexicon.negations if len(n) <= lexicon.negation_window)
    if not usable:
        return F.lit(False)
    return F.exists(literal_array(usable), lambda n: F.endswith(prefix, n))


def _hits(text: Column, terms: tuple[str, ...], lexicon: Lexicon) -> Column:
    """R2: matched terms in lexicon order as (pos, term, negated)."""
    plain = [(i, t) for i, t in enumerate(terms) if not is_boundary_term(t)]
    alone = [(i, t) for i, t in enumerate(terms) if is_boundary_term(t)]
    window = lexicon.negation_window
    found = F.expr(f"cast(array() AS ARRAY<{_HIT}>)")
    if plain:
        candidates = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(t).alias("term")) for i, t in plain])

        def hit(c: Column) -> Column:
            at = F.position(c["term"], text)
            prefix = F.substring(text, F.greatest(F.lit(1), at - window), F.least(F.lit(window), at - 1))
            return F.struct(c["pos"].alias("pos"), c["term"].alias("term"), _negated(prefix, lexicon).alias("negated"))

        matched = F.filter(candidates, lambda c: F.contains(text, c["term"]))
        # One scan of the text settles the common case of no match at all.
        found = F.when(
            text.rlike("|".join(_quote(t) for _, t in plain)), F.transform(matched, hit)
        ).otherwise(found)
    if alone:
        pattern = _alone("(?:" + "|".join(t for _, t in alone) + ")")
        singles = F.array(*[
            F.when(text.rlike(_alone(t)), F.struct(
                F.lit(i).alias("pos"), F.lit(t).alias("term"),
                _negated(F.right(F.regexp_extract(text, rf"(?s)^(.*?){_alone(t)}", 1), F.lit(window)), lexicon)
                .alias("negated"),
            )) for i, t in alone
        ])
        single = F.when(text.rlike(pattern), F.array_compact(singles)).otherwise(F.expr(f"cast(array() AS ARRAY<{_HIT}>)"))
        found = F.array_sort(F.concat(found, single))
    return found


def _terms(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["term"])


def prepare(text: Column) -> Column:
    """Lower case, one kind of apostrophe."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("’"), F.lit("'"))


def high_hits(prepared: Column, lexicon: Lexicon) -> Column:
    return _hits(prepared, lexicon.high, lexicon)


def medium_hits(prepared: Column, lexicon: Lexicon) -> Column:
    return _hits(prepared, lexicon.medium, lexicon)


def assess(high: Column, medium: Column, lexicon: Lexicon) -> Column:
    """(level, keywords) from the two hit lists."""
    result = lambda level, words: F.struct(F.lit(level).alias("level"), words.alias("keywords"))

    def ordered(kept: Column) -> Column:
        # Parts of longer terms leave; the rest goes longest first, lexicon order among equals.
        whole = F.filter(kept, lambda h: ~F.exists(
            kept, lambda o: (o["term"] != h["term"]) & F.contains(o["term"], h["term"])))
        return _terms(F.array_sort(F.transform(whole, lambda h: F.struct(
            (-F.char_length(h["term"])).alias("len"), h["pos"].alias("pos"), h["term"].alias("term")))))

    def by_medium(words: Column) -> Column:
        return (
            F.when(F.size(words) >= lexicon.medium_to_high, result("high", words))
            .when(F.size(words) > 0, result("medium", words)).otherwise(result("general", words))
        )

    def by_high(hits: Column) -> Column:
        firm = F.filter(hits, lambda h: ~h["negated"])
        return (
            F.when(F.exists(hits, lambda h: ~h["negated"]), result("high", _terms(firm)))
            .when(F.size(hits) > 0, result("medium", _terms(hits)))
            .otherwise(let(let(F.filter(medium, lambda h: ~h["negated"]), ordered), by_medium))
        )

    return let(high, by_high)


def assess_text(text: Column, lexicon: Lexicon) -> Column:
    """R2-R4 in one expression; `operators.risk.score` shares the hit lists between its steps instead."""
    prepared = prepare(text)
    return assess(high_hits(prepared, lexicon), medium_hits(prepared, lexicon), lexicon)


def category(keywords: Column, lexicon: Lexicon) -> Column:
    """Suicide before overdose before substance before emotional."""
    signals = literal_array(lexicon.substance_signals)
    return let(
        F.transform(keywords, lambda k: F.replace(F.lower(k), F.lit("’"), F.lit("'"))),
        lambda words: F.when(F.arrays_overlap(words, literal_array(lexicon.suicide)), "suicide")
        .when(F.arrays_overlap(words, literal_array(lexicon.overdose)), "overdose")
        .when(F.exists(words, lambda w: F.exists(signals, lambda s: F.contains(w, s))), "substance")
        .otherwise("emotional"),
    )


def normalise_level(level: Column) -> Column:
    """R6."""
    lowered = F.lower(F.coalesce(level, F.lit("")))
    return F.when(lowered == "", "unknown").when(lowered.isin("general", "low"), "general").otherwise(lowered)


def is_important(user_text: Column, bot_text: Column, level: Column | None = None) -> Column:
    """R7."""
    long = (F.char_length(user_text) > 300) | (F.char_length(bot_text) > 500)
    long = F.coalesce(long, F.coalesce(F.char_length(user_text) > 300, F.lit(False)))
    return long if level is None else F.coalesce(level.isin("high", "medium"), F.lit(False)) | long


def score_band(substance: Column, score: Column, alcohol: tuple[str, ...] = ("alcohol", "เครื่องดื่มแอลกอฮอล์")) -> Column:
    """Low / medium / high band of an instrument score."""
    low = F.when(substance.isin(*alcohol), F.lit(10)).otherwise(F.lit(3))
    return F.when(score <= low, "low").when(score <= 26, "medium").otherwise("high")


def priority(text: Column, words: PriorityWords = PriorityWords()) -> Column:
    """5 plus 3 per high word plus 1 per medium word, at most 10."""
    lowered = F.lower(text)
    count = lambda terms: F.size(F.filter(literal_array(terms), lambda t: F.contains(lowered, t)))
    return F.least(F.lit(10), F.lit(5) + count(words.high) * 3 + count(words.medium))


def intent(message: Column, level: Column, recent: Column, terms: IntentTerms = IntentTerms()) -> Column:
    """Crisis / info / general. ``recent`` holds the last messages, squeezed and joined by blanks."""
    text = squeeze(F.lower(message))
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in terms.patterns)
    asks, domain = text.rlike(pattern), any_term(text, terms.domain)
    info = (asks & domain & ~any_term(text, terms.disclosure)) | any_term(text, terms.direct)
    related = (
        any_term(text, terms.follow_up) & (asks | domain | any_term(text, terms.question))
        & (any_term(recent, terms.domain) | recent.rlike(pattern))
    )
    return (
        F.when(level == "high", "crisis")
        .when((text != "") & (info | related), "info")
        .otherwise("general")
    )


def facility_inquiry(text: Column, terms: FacilityTerms = FacilityTerms()) -> Column:
    """R8d."""
    lowered = F.lower(text)
    return any_term(lowered, terms.facility) & (
        any_term(lowered, terms.location) | (any_term(lowered, terms.ask) & any_term(lowered, terms.place))
    )
