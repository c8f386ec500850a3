"""All named queries; importing a module registers its own."""

from chatlake.plans import (  # noqa: F401
    activity_queries,
    consensus_queries,
    context_queries,
    lifecycle_queries,
    record_queries,
    retrieval_queries,
    risk_queries,
    sink_queries,
    text_queries,
    usage_queries,
    stream_queries,
)
from chatlake.plans.registry import CHECKS, QUERIES  # noqa: F401
