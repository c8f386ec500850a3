"""Dashboard insights: one frame per panel over the same look-back window."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from chatlake.functions.lexicon import DEFAULT, Lexicon
from chatlake.operators import analytics as N
from chatlake.operators import consensus as C
from chatlake.operators import risk as K


def insights(activity: DataFrame, progress: DataFrame, follow_ups: DataFrame, as_of: dt.datetime, *, days: int = 30,
             users: int = 20, keywords: int = 10, lexicon: Lexicon = DEFAULT, order: str = "event_id") -> dict[str, DataFrame]:
    """Panels stay separate lazy frames; the window predicate reaches every scan."""
    days = N.clamp("lookback", days)
    window = N.since(activity, as_of=as_of, days=days)
    events = N.since(progress, as_of=as_of, days=days)
    summaries = N.user_summaries(window)
    return {
        "overview": N.overview(window), "active_follow_ups": N.active_follow_ups(follow_ups),
        "users": N.with_events(N.newest_users(summaries, N.clamp("users", users)), K.recent_events(events, order=order)),
        "engagement": N.engagement(window), "daily_totals": N.daily_totals(window),
        "retention": N.retention_buckets(window), "depth": N.depth_trend(window),
        "risk_summary": K.risk_summary(events), "risk_trend": K.risk_trend(events),
        "top_keywords": K.top_keywords(events, lexicon, N.clamp("keywords", keywords), order=("ts", order)),
    }


def consensus_stats(runs: DataFrame, as_of: dt.datetime, days: int = 30) -> dict[str, DataFrame]:
    """Panels of the consensus log."""
    window = N.since(runs, as_of=as_of, days=N.clamp("lookback", days))
    return {
        "summary": C.summary(window), "provider_wins": C.provider_wins(window), "provider_scores": C.provider_scores(window),
        "provider_tokens": C.provider_tokens(window), "provider_times": C.provider_times(window),
        "phase_times": C.phase_times(window), "daily_trend": C.daily_trend(window), "recent_timings": C.recent_timings(window),
    }
