"""Inbound messages as a batch: context restored, risk and intent scored, log and alerts written as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions import risk as R
from chatlake.functions.lexicon import DEFAULT, IntentTerms, Lexicon
from chatlake.operators import context as X
from chatlake.operators import risk as K


def process(messages: DataFrame, lexicon: Lexicon = DEFAULT, terms: IntentTerms = IntentTerms()) -> dict[str, DataFrame]:
    """Per user message its level and intent; per exchange a log row; per high-risk exchange an alert category."""
    scored = K.score(X.recent_text(messages), lexicon)
    routed = scored.where(F.col("role") == "user").withColumn(
        "intent", R.intent(F.col("text"), F.col("risk_level"), F.col("recent"), terms))
    log = K.score_exchanges(X.exchanges(messages), lexicon)
    return {
        "routed": routed.select("conv_id", "turn", "risk_level", "keywords", "category", "intent"),
        "log": log, "alerts": log.where(F.col("risk_level") == "high"),
        "context": X.restore(X.exchanges(messages)),
    }
