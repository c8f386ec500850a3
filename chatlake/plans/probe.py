"""Term lists for the checked queries: fragments and words that occur in the stored conversations."""

from chatlake.functions.lexicon import FacilityTerms, IntentTerms, Lexicon, PriorityWords

PROBE = Lexicon(
    high=("schung", "ezas", "ingthe", "une"),
    medium=("heit", "ungheit", "que de", "ciónra", "avec", "ist", "eauai"),
    negations=("die ", "la ", "de ", "of ", "ein"),
    suicide=("ezas", "une"),
    overdose=("schung",),
    substance_signals=("heit", "eau"),
)
PRIORITY = PriorityWords(high=("schung", "ezas", "tretion"), medium=("heit", "que", "ing", "the"))
INTENT = IntentTerms(patterns=("heit|tion le", "ciónra"), domain=("ung", "eau", "cion", "ing"), disclosure=("sich", "avec"),
                     follow_up=("the", "que", "der"), direct=("ezas", "erthing"), question=("?", "was"))
FACILITY = FacilityTerms(facility=("ung", "tion"), location=("wher", "sur "), ask=("for", "pour", "para"), place=("with", "dans"))
