"""Q13: hybrid retrieval for a whole table of questions as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators import retrieval as Q
from chatlake.operators.sizing import broadcast_if_small

VECTOR_SIZE = 64


def dense_leg(prepared: DataFrame, query_vectors: DataFrame, vectors: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """Dense candidates; vectors whose chunk is gone never match."""
    asked = query_vectors.join(broadcast_if_small(prepared.select("query_id", "fetch_k")), "query_id")
    live = vectors.join(chunks.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_semi")
    return Q.dense_topk(asked, live, size=size)


def ranked(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None, query_vectors: DataFrame | None, *,
           top_k: int = 3, size: int = VECTOR_SIZE, topic_hint: str | None = None, expansions=Q.EXPANSIONS) -> DataFrame:
    """Selected chunks per question before formatting. Either leg may be absent.

    ``chunks`` is read several times (postings, statistics, candidate texts): pass a stored table or the
    result of `session.materialise`.
    """
    prepared = Q.prepare_queries(queries, top_k, expansions)
    lexical = Q.lexical_search(prepared, chunks)
    if vectors is None or query_vectors is None:
        dense = lexical.select("query_id", "doc_id", "chunk_index", F.lit(None).cast("double").alias("cosine")).limit(0)
    else:
        dense = dense_leg(prepared, query_vectors, vectors, chunks, size)
    candidates = Q.merge_candidates(dense, lexical)
    return Q.diverse(Q.fuse(candidates, prepared, chunks, topic_hint=topic_hint), top_k)


def search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None, query_vectors: DataFrame | None, *,
           max_chars: int = Q.MAX_CONTEXT_CHARS, **options) -> DataFrame:
    """Formatted source rows per question within the context budget; `retrieval.contexts` joins them to one text."""
    return Q.format_results(ranked(queries, chunks, vectors, query_vectors, **options), max_chars=max_chars)
