"""All queries of this folder; importing a module registers its own."""

from chatlake.llm import (  # noqa: F401
    decontamination, jaccard, language, media, mixing, packing, periods, quality, repair, repeats, secrets, tokens, toxicity)
from chatlake.llm.registry import CHECKS, QUERIES  # noqa: F401
