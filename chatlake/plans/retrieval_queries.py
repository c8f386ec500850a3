"""Checked queries of Q1-Q15, W4, W5 and A30."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.operators import chunking as H
from chatlake.operators import lexical_index as X
from chatlake.operators import retrieval as Q
from chatlake.plans import hybrid
from chatlake.plans.registry import query
from chatlake.session import materialise
from chatlake.sources import adapters as S

#: Expansions that occur in the stored questions.
PROBE_EXPANSIONS = ((("heit", "ung"), "und der die verlich"), (("ción", "rr"), "que las con"), (("tion", "ing"), "the that with"),
                    (("ou", "eau"), "les des pour"), (("zzz",), "never used"))
_W = "[A-Za-z0-9_]{2,}|[\\x{0E00}-\\x{0E7F}]+"


def _tokens(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '{_W}')"


_INDEX = f"""d AS MATERIALIZED (SELECT doc_id, source, text, lower(text) AS low, {_tokens('text')} AS toks, len(list_distinct(toks)) AS uniq FROM documents),
 st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
 post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d) GROUP BY doc_id, dl, term),
 df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


@query(f"WITH {_INDEX} SELECT doc_id, CAST(0 AS INTEGER) AS chunk_index, term, tf, CAST(dl AS INTEGER) AS doc_length FROM post")
def postings(spark, sf):
    return Q.postings(Q.tokenised(S.document_chunks(spark, sf)))


@query(f"WITH {_INDEX} SELECT term, df, round(ln(1 + ((SELECT n FROM st) - df + 0.5) / (df + 0.5)), 9) AS idf FROM df")
def inverse_document_frequency(spark, sf):
    tokens = Q.tokenised(S.document_chunks(spark, sf))
    n = Q.corpus_stats(tokens).select("n_chunks").scalar()
    return Q.document_frequency(Q.postings(tokens)).withColumn("idf", F.round(Q.idf(n, F.col("df")), 9))


@query(f"WITH {_INDEX} SELECT (SELECT n FROM st) AS total_chunks, (SELECT n FROM st) AS total_documents, (SELECT count(*) FROM df) AS vocabulary")
def index_stats(spark, sf):
    chunks = S.document_chunks(spark, sf)
    return Q.index_stats(chunks, Q.postings(Q.tokenised(chunks)))


def _hits(keywords) -> str:
    return "(" + " OR ".join(f"contains(lower(c), '{k}')" for k in keywords) + ")"


_EXTRA = ", ".join(f"CASE WHEN {_hits(k)} THEN '{e}' END" for k, e in PROBE_EXPANSIONS)
_PREP = rf"""pq0 AS (SELECT item_id AS query_id, text, regexp_replace(trim(text), '(?i)\b(please|pls|kindly|help)\b', ' ', 'g') AS base_text,
  trim(regexp_replace(base_text, '\s+', ' ', 'g')) AS c FROM benchmark),
 pq AS (SELECT query_id, base_text, text, CASE WHEN len({_tokens('c')}) <= 12 AND len(list_filter([{_EXTRA}], lambda x: x IS NOT NULL)) > 0
  THEN c || ' ' || array_to_string(list_filter([{_EXTRA}], lambda x: x IS NOT NULL)[1:4], ' ') ELSE c END AS search_text FROM pq0),
 prep AS (SELECT *, list_distinct({_tokens('base_text')}) AS bt, CAST(greatest(36, 12, least(60, 8 + 2 * len({_tokens('search_text')}))) AS INTEGER) AS fetch_k FROM pq)"""


@query(f"WITH {_PREP} SELECT query_id, base_text, search_text, fetch_k FROM prep")
def prepared_queries(spark, sf):
    return Q.prepare_queries(S.search_queries(spark, sf), 3, PROBE_EXPANSIONS).drop("question")


_BM25 = f"""qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({_tokens('search_text')}) AS term FROM prep) GROUP BY 1, 2),
 bs AS (SELECT query_id, doc_id, sum(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * (1 + ln(1 + qf)) * (tf * 2.5) /
  (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS lexical FROM qt JOIN post USING (term) JOIN df USING (term), st GROUP BY 1, 2),
 lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 9) DESC, doc_id) AS lexical_rank
  FROM bs WHERE lexical > 0) JOIN (SELECT query_id, fetch_k FROM prep) USING (query_id) WHERE lexical_rank <= fetch_k)"""


@query(f"WITH {_INDEX}, {_PREP}, {_BM25} SELECT query_id, doc_id, CAST(lexical_rank AS INTEGER) AS lexical_rank, round(lexical, 6) AS lexical FROM lex")
def bm25_topk(spark, sf):
    """From the stored index, which the first query over a table's present files builds."""
    index = X.stored(spark, f"{sf}/documents.parquet", S.document_chunks(spark, sf))
    prepared = Q.prepare_queries(S.search_queries(spark, sf), 3, PROBE_EXPANSIONS)
    rows = X.bm25(prepared, index)
    return rows.select("query_id", "doc_id", "lexical_rank", F.round("lexical", 6).alias("lexical"))


_DENSE = """dn AS (SELECT p.query_id, d.doc_id, p.fetch_k, list_cosine_similarity(CAST(qv.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS cosine
  FROM prep p JOIN embeddings qv ON qv.vec_id = p.query_id, embeddings v JOIN documents d ON d.doc_id = v.vec_id),
 den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, doc_id) AS cosine_rank FROM dn) WHERE cosine_rank <= fetch_k)"""


@query(f"WITH {_PREP}, {_DENSE} SELECT query_id, doc_id, CAST(cosine_rank AS INTEGER) AS cosine_rank, round(cosine, 6) AS cosine FROM den")
def dense_topk(spark, sf):
    prepared = Q.prepare_queries(S.search_queries(spark, sf), 3, PROBE_EXPANSIONS)
    rows = hybrid.dense_leg(prepared, S.query_vectors(spark, sf), S.chunk_vectors(spark, sf), S.document_chunks(spark, sf), 64)
    return rows.select("query_id", "doc_id", "cosine_rank", F.round("cosine", 6).alias("cosine"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, lead(CAST(embedding AS DOUBLE[])) OVER (ORDER BY vec_id) AS f FROM embeddings)
 SELECT vec_id, CAST(len(e) AS INTEGER) AS size, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm,
 round(list_cosine_similarity(e[1:48] || list_transform(range(16), lambda x: 0.0::DOUBLE), e), 6) AS cut_cosine FROM v""")
def vector_coercion(spark, sf):
    whole = F.col("embedding")
    cut = Q.coerce_vector(Q.coerce_vector(whole, 48), 64)
    return S.vectors(spark, sf).select(
        "vec_id", F.size(Q.strict_vector(whole, 64)).alias("size"), F.round(Q.norm(whole), 6).alias("norm"),
        F.round(Q.cosine(cut, whole), 6).alias("cut_cosine"))


_OVERLAP = "len(list_filter(bt, lambda t: contains(content, t))) / len(bt)"


@query(f"""WITH {_INDEX}, {_PREP}, {_BM25} SELECT query_id, doc_id, round({_OVERLAP.replace('content', 'd.low')}, 6) AS overlap
 FROM lex JOIN prep USING (query_id) JOIN d USING (doc_id)""")
def keyword_overlap(spark, sf):
    chunks = S.document_chunks(spark, sf)
    prepared = Q.prepare_queries(S.search_queries(spark, sf), 3, PROBE_EXPANSIONS)
    hits = Q.lexical_search(prepared, chunks).select("query_id", "doc_id")
    rows = Q.with_chunks(hits.join(prepared.select("query_id", "base_text"), "query_id"), chunks.select("doc_id", "content"))
    return rows.select("query_id", "doc_id", F.round(Q.keyword_overlap(F.col("base_text"), F.col("content")), 6).alias("overlap"))


_FUSED = f"""cd AS (SELECT query_id, doc_id, cosine, lexical FROM (SELECT query_id, doc_id, cosine FROM den) a FULL JOIN (SELECT query_id, doc_id, lexical FROM lex) b USING (query_id, doc_id)),
 nm AS (SELECT *, greatest(0, least(1, (coalesce(cosine, -1) + 1) / 2)) AS dense_norm,
  coalesce(lexical / max(lexical) OVER (PARTITION BY query_id), 0) AS lexical_norm FROM cd),
 ov AS (SELECT nm.*, d.source, d.text AS content, {_OVERLAP.replace('content', 'd.low')} AS overlap,
  CASE WHEN len(regexp_extract_all(d.text, '[A-Za-z0-9_]+')) BETWEEN 1 AND 11 THEN 0.04 ELSE 0 END +
  CASE WHEN d.uniq < 6 THEN 0.03 ELSE 0 END AS pen
  FROM nm JOIN prep USING (query_id) JOIN d USING (doc_id)),
 fu AS (SELECT *, greatest(0, 0.52::DOUBLE * dense_norm + 0.30::DOUBLE * lexical_norm + 0.18::DOUBLE * overlap - pen) AS score FROM ov
  WHERE NOT (dense_norm < 0.42 AND lexical_norm < 0.12 AND overlap < 0.40))"""
_ALL = f"WITH {_INDEX}, {_PREP}, {_BM25}, {_DENSE}, {_FUSED}"


@query(_ALL + """ SELECT query_id, doc_id, round(dense_norm, 6) AS dense_norm, round(lexical_norm, 6) AS lexical_norm, round(overlap, 6) AS overlap,
 round(score, 6) AS score FROM fu""")
def fused_candidates(spark, sf):
    chunks = S.document_chunks(spark, sf)
    prepared = Q.prepare_queries(S.search_queries(spark, sf), 3, PROBE_EXPANSIONS)
    lexical = Q.lexical_search(prepared, chunks)
    dense = hybrid.dense_leg(prepared, S.query_vectors(spark, sf), S.chunk_vectors(spark, sf), chunks, 64)
    rows = Q.fuse(Q.merge_candidates(dense, lexical), prepared, chunks)
    return rows.select("query_id", "doc_id", *[F.round(c, 6).alias(c) for c in ("dense_norm", "lexical_norm", "overlap", "score")])


# Documents are one chunk each, so the per-document discount is checked with the source as the document.
@query(_ALL + """, d1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, doc_id) AS r FROM fu),
 d2 AS (SELECT *, score - 0.08::DOUBLE * (r - 1) AS adjusted FROM d1 WHERE r <= 2),
 d3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(adjusted, 9) DESC, round(score, 9) DESC, doc_id) AS position FROM d2)
 SELECT query_id, doc_id, source AS doc_name, CAST(position AS INTEGER) AS position, round(adjusted, 6) AS adjusted FROM d3 WHERE position <= 8""")
def diverse_topk(spark, sf):
    chunks = S.document_chunks(spark, sf)
    prepared = Q.prepare_queries(S.search_queries(spark, sf), 3, PROBE_EXPANSIONS)
    lexical = Q.lexical_search(prepared, chunks)
    dense = hybrid.dense_leg(prepared, S.query_vectors(spark, sf), S.chunk_vectors(spark, sf), chunks, 64)
    rows = Q.diverse(Q.fuse(Q.merge_candidates(dense, lexical), prepared, chunks), 8, document="doc_name", tie=("doc_id",))
    return rows.select("query_id", "doc_id", "doc_name", "position", F.round("adjusted", 6).alias("adjusted"))


@query(_ALL + """, ps AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS position FROM fu),
 ln AS (SELECT *, trim(content, ' ' || chr(10) || chr(13) || chr(9)) AS tc,
  printf('[%d] source: %s (score=%.3f, dense=%.3f, lexical=%.3f, kind=general_reference, lang=%s)', position, source, round(score, 9), round(dense_norm, 9), round(lexical_norm, 9),
  CASE WHEN regexp_matches(content, '[A-Za-z]') THEN 'en' ELSE 'unknown' END) || chr(10) ||
  CASE WHEN length(tc) > 1800 THEN rtrim(substr(tc, 1, 1800), ' ' || chr(10) || chr(13) || chr(9)) || ' ...' ELSE tc END AS line FROM ps WHERE position <= 3),
 us AS (SELECT *, sum(length(line)) OVER (PARTITION BY query_id ORDER BY position) + 2 * (position - 1) AS used FROM ln)
 SELECT query_id, doc_id, CAST(position AS INTEGER) AS position, line, round(round(score, 9), 4) AS score, round(round(dense_norm, 9), 4) AS dense_score,
 round(round(lexical_norm, 9), 4) AS lexical_score FROM us WHERE position = 1 OR used <= 4000""")
def hybrid_documents(spark, sf):
    """Whole documents, each its only chunk. Documents without a stored vector have the lexical leg alone."""
    rows = hybrid.search(S.search_queries(spark, sf), S.document_chunks(spark, sf), S.chunk_vectors(spark, sf),
                         S.query_vectors(spark, sf), max_chars=4000, expansions=PROBE_EXPANSIONS)
    return rows.select("query_id", "doc_id", "position", "line", "score", "dense_score", "lexical_score")


@query()
def hybrid_search(spark, sf):
    """Flagship: the whole path from cleaned documents over chunks and both indexes to formatted sources.

    There is one stored vector to a document: it stands for the first chunk, and later chunks have the lexical leg alone.
    """
    chunks = materialise(H.chunks(S.corpus(spark, sf)), "chunks")
    return hybrid.search(S.search_queries(spark, sf), chunks, S.chunk_vectors(spark, sf), S.query_vectors(spark, sf),
                         expansions=PROBE_EXPANSIONS)


@query("""WITH t AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS i, sha256('64|RETRIEVAL_DOCUMENT|' || i) AS k FROM documents)
 SELECT k AS cache_key, min(length(i)) AS size FROM t WHERE i <> '' AND NOT EXISTS (SELECT 1 FROM t c JOIN embeddings e ON e.vec_id = c.doc_id AND e.label < 5 WHERE c.k = t.k) GROUP BY 1""")
def missing_embeddings(spark, sf):
    inputs = Q.embedding_inputs(S.corpus(spark, sf), "text", size=64)
    known = S.vectors(spark, sf).where("label < 5").select(F.col("vec_id").alias("doc_id"))
    rows = Q.missing_embeddings(inputs, inputs.join(known, "doc_id", "left_semi"))
    return rows.select("cache_key", F.char_length("input").cast("bigint").alias("size"))
