"""Lexical, dense and hybrid retrieval for a table of queries.

``chunks`` rows are (doc_id, chunk_index, content[, metadata]), ``queries`` rows (query_id, question).

* Lexical: a task counts the query terms of its chunks, scores them for all queries and sends on the best rows. Too many query terms to
  travel, and chunks are exchanged once by their key; frequencies, scores and sums stay inside that partitioning.
* Dense: tiles of vectors meet tiles of a bounded block of queries as matrix products. A task keeps one list of the best
  rows per query for all its batches, so it sends on k rows of a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions import text as T
from chatlake.operators.segments import top_n
from chatlake.operators.sizing import BROADCAST_ROWS, broadcast_if_small, fits
from chatlake.session import materialise

# Ranking constants.
BM25_K1, BM25_B = 1.5, 0.75
DENSE_WEIGHT, LEXICAL_WEIGHT, KEYWORD_WEIGHT = 0.52, 0.30, 0.18
TOPIC_BOOST, REUSE_PENALTY, PER_DOCUMENT = 0.08, 0.08, 2
MIN_DENSE, MIN_LEXICAL, MIN_OVERLAP = 0.42, 0.12, 0.40
BASE_FETCH, MAX_CONTEXT_CHARS, MAX_CHUNK_CHARS = 36, 5200, 1800
# Filler words dropped from a question.
FILLERS = ("please", "pls", "kindly", "help", "ครับ", "ค่ะ", "คะ", "นะ", "หน่อย")
# Section titles that point elsewhere.
WEAK_SECTIONS = ("related resources", "resources", "references")

#: Most queries turned into one matrix; beyond it vectors and queries meet in blocks.
QUERY_BLOCK = 4096
#: Vectors and queries of one matrix product: the product holds so many scores at once.
TILE_ROWS, TILE_QUERIES = 2048, 512
#: Scores (chunks times queries) and weighted counts that lexical search holds at once.
TILE_CELLS = 2_000_000

#: Q7: keyword lists and the text they add to a short question; a parameter of every query function.
EXPANSIONS: tuple[tuple[tuple[str, ...], str], ...] = (
    (("crisis", "emergency", "urgent", "suicide", "ฉุกเฉิน"), "emergency hotline safety plan urgent referral"),
    (("overdose", "naloxone", "fentanyl", "หมดสติ"), "overdose naloxone rescue breathing emergency"),
    (("relapse", "craving", "urge", "trigger", "ความอยาก"), "relapse craving coping plan prevention"),
    (("withdrawal", "detox", "ถอนยา"), "withdrawal symptoms monitoring medical support"),
    (("family", "caregiver", "ครอบครัว"), "family communication boundaries support plan"),
)


# ---------------------------------------------------------------- lexical


def tokenised(chunks: DataFrame) -> DataFrame:
    """Q1: (doc_id, chunk_index, tokens), exchanged by the chunk's key.

    Postings, frequencies and statistics all start here, so a plan using several of them reads this one exchange.
    """
    keyed = chunks.select("doc_id", "chunk_index", T.lexical_tokens(F.col("content")).alias("tokens"))
    return keyed.repartition("doc_id", "chunk_index")


def postings(tokens: DataFrame) -> DataFrame:
    """Q2: (doc_id, chunk_index, term, tf, doc_length); keeps the partitioning of `tokenised`."""
    sized = tokens.withColumn("doc_length", F.size("tokens"))
    # The outer form keeps the optimizer from tokenising once more for an inferred "not empty" filter.
    words = sized.select("doc_id", "chunk_index", "doc_length", F.explode_outer("tokens").alias("term"))
    return words.where(F.col("term").isNotNull()).groupBy("doc_id", "chunk_index", "doc_length", "term").agg(
        F.count(F.lit(1)).alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    """Q2: chunks per term; combined map-side, so a term in every chunk costs one row per task."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """Q2: chunk count and mean length over all chunks, empty ones included."""
    mean = F.avg(F.size("tokens"))
    return tokens.agg(F.count(F.lit(1)).alias("n_chunks"), F.when(mean > 0, mean).otherwise(F.lit(1.0)).alias("avg_length"))


def idf(n_chunks: Column, df: Column) -> Column:
    """Q3."""
    return F.log1p((n_chunks - df + F.lit(0.5)) / (df + F.lit(0.5)))


def index_stats(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks, documents and vocabulary."""
    docs = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("doc_id").isNotNull() & (F.col("doc_id").cast("string") != "")
    terms = index.select("term").distinct().agg(F.count(F.lit(1)).alias("v")).select("v").scalar()
    return docs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"), F.count_if(named).alias("total_documents"),
    ).withColumn("vocabulary", terms)


def query_terms(queries: DataFrame, text: str = "search_text") -> DataFrame:
    """Distinct terms of each query with their count."""
    words = queries.select("query_id", F.explode_outer(T.lexical_tokens(F.col(text))).alias("term"))
    return words.where(F.col("term").isNotNull()).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))


def bm25(queries: DataFrame, index: DataFrame, stats: DataFrame, *, fetch: str = "fetch_k",
         text: str = "search_text") -> DataFrame:
    """Q4: the best ``fetch`` chunks per query with a positive score, ranked.

    ``index`` comes from `postings`, or from a table holding its rows bucketed by (doc_id, chunk_index).
    ``stats`` is the one row of `corpus_stats`, read as scalar subqueries.
    """
    n, mean = stats.select("n_chunks").scalar(), stats.select("avg_length").scalar()
    terms = query_terms(queries, text)
    # Frequencies and weights have no more rows than the query terms, so one check covers all three joins.
    near = F.broadcast if fits(terms) else lambda frame: frame
    frequency = document_frequency(index.join(near(terms.select("term").distinct()), "term", "left_semi"))
    weight = idf(n, F.col("df")) * (F.lit(1.0) + F.log1p(F.col("qf").cast("double")))
    weighted = terms.join(near(frequency), "term").select("query_id", "term", weight.alias("weight"))
    joined = index.join(near(weighted), "term")
    norm = F.col("tf") + F.lit(BM25_K1) * (F.lit(1.0 - BM25_B) + F.lit(BM25_B) * (F.col("doc_length") / F.greatest(mean, F.lit(1e-6))))
    part = F.col("weight") * (F.col("tf") * F.lit(BM25_K1 + 1.0)) / norm
    scored = joined.groupBy("query_id", "doc_id", "chunk_index").agg(F.sum(part).alias("lexical")).where("lexical > 0")
    return _best(scored, queries, "lexical", fetch)


def _best(scored: DataFrame, queries: DataFrame, score: str, fetch: str) -> DataFrame:
    """Ranked best rows per query; the group limit needs one bound for all, the query's own follows."""
    asked, bound = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(fetch), F.lit(1))).first()
    # Scores are compared at nine places: sums of floats differ in the last bits between runs.
    order = [F.round(score, 9).desc(), F.col("doc_id"), F.col("chunk_index")]
    ranked = top_n(scored, ["query_id"], order, int(bound), rank=f"{score}_rank")
    limits = queries.select("query_id", F.col(fetch).alias("__fetch"))
    limits = F.broadcast(limits) if asked <= BROADCAST_ROWS else limits
    return ranked.join(limits, "query_id").where(F.col(f"{score}_rank") <= F.col("__fetch")).drop("__fetch")


# ---------------------------------------------------------------- dense


def coerce_vector(vector: Column, size: int) -> Column:
    """Q5: cut or zero-padded to ``size``."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    return F.slice(F.concat(F.coalesce(vector, F.expr("cast(array() AS ARRAY<FLOAT>)")), zeros), 1, size)


def strict_vector(vector: Column, size: int) -> Column:
    """Q5: fails the job on another dimension."""
    return F.when(F.size(vector) == size, vector).otherwise(
        F.raise_error(F.concat(F.lit("unexpected vector size "), F.size(vector))).cast("array<float>"))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(left: Column, right: Column) -> Column:
    """Q6 for aligned columns: NULL for a zero left side, the right norm floored."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    size = norm(right)
    return F.when(norm(left) > 0, dot / (norm(left) * F.when(size == 0, F.lit(1e-12)).otherwise(size)))


def dense_topk(queries: DataFrame, vectors: DataFrame, *, size: int, fetch: str = "fetch_k",
               block: int = QUERY_BLOCK) -> DataFrame:
    """The best ``fetch`` chunks per query by cosine.

    ``queries`` rows are (query_id, vector, fetch_k), ``vectors`` rows (doc_id, chunk_index, vector). Up to
    ``block`` queries travel to the vectors as one matrix. More queries and the vectors are dealt into
    blocks that meet pairwise by an equi-join, each meeting again one matrix product.
    """
    q = queries.select("query_id", coerce_vector(F.col("vector"), size).alias("vector"), F.col(fetch).alias("k"))
    v = vectors.select("doc_id", "chunk_index", coerce_vector(F.col("vector"), size).alias("vector"))
    types = {f.name: f.dataType.simpleString() for f in [*q.schema.fields, *v.schema.fields]}
    schema = (f"query_id {types['query_id']}, doc_id {types['doc_id']}, chunk_index {types['chunk_index']}, cosine double")
    if fits(q, block):
        best = _dense_by_matrix(q, v, schema)
    else:
        best = _dense_by_blocks(q, v, schema, block)
    return _best(best, queries, "cosine", fetch)


@dataclass(frozen=True)
class _Matrix:
    """A block of queries as one unit-length matrix; zero vectors are left out, they match nothing."""

    ids: np.ndarray
    rows: np.ndarray
    keep: int

    @staticmethod
    def of(pdf: pd.DataFrame) -> _Matrix | None:
        if not len(pdf):
            return None
        rows = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        length = np.sqrt((rows * rows).sum(axis=1))
        ok = np.isfinite(length) & (length > 0)
        if not ok.any():
            return None
        return _Matrix(pdf["query_id"].to_numpy()[ok], rows[ok] / length[ok, None], int(pdf["k"].max()))


class _Top:
    """The best rows of each query among all tiles of a task, in the order of the final ranking; never more than k for a query."""

    def __init__(self, ids: np.ndarray, keep: int, score: str) -> None:
        self.ids, self.keep, self.score = ids, keep, score
        self.rows = pd.DataFrame({"q": np.zeros(0, np.int64), "at_nine": np.zeros(0), score: np.zeros(0), "doc_id": np.zeros(0, object),
                                  "chunk_index": np.zeros(0, object)})
        # The score that a row must reach to be among the best of a query, once it has k.
        self.least = np.full(len(ids), -np.inf)

    def offer(self, part: pd.DataFrame, scores: np.ndarray, first: int = 0) -> None:
        """``scores`` holds a row for each of ``part`` and a column for each query from the number ``first``."""
        keep = self.keep
        # Scores are compared at nine places, as in the final ranking, and sent on in full.
        compared = np.where(np.isfinite(scores), np.round(scores, 9), -np.inf)
        cut = self.least[first:first + scores.shape[1]]
        if len(scores) > keep:
            cut = np.maximum(cut, np.partition(compared, len(scores) - keep, axis=0)[len(scores) - keep])
        at, of = np.nonzero((compared >= cut) & np.isfinite(compared))
        if not len(at):
            return
        new = pd.DataFrame({"q": of + first, "at_nine": compared[at, of], self.score: scores[at, of], "doc_id": part["doc_id"].to_numpy()[at],
                            "chunk_index": part["chunk_index"].to_numpy()[at]})
        both = pd.concat((self.rows, new)) if len(self.rows) else new
        both = both.sort_values(["q", "at_nine", "doc_id", "chunk_index"], ascending=[True, False, True, True])
        place = both.groupby("q").cumcount()
        self.rows = both[place < keep]
        full = both[place == keep - 1]
        self.least[full["q"].to_numpy(np.int64)] = full["at_nine"].to_numpy()

    def result(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.ids[self.rows["q"].to_numpy(np.int64)], "doc_id": self.rows["doc_id"].to_numpy(),
                             "chunk_index": self.rows["chunk_index"].to_numpy(), self.score: self.rows[self.score].to_numpy()})


class _Best(_Top):
    """The best rows by cosine."""

    def __init__(self, queries: _Matrix) -> None:
        super().__init__(queries.ids, queries.keep, "cosine")
        self.queries = queries

    def add(self, batch: pd.DataFrame) -> None:
        for at in range(0, len(batch), TILE_ROWS):
            part = batch.iloc[at:at + TILE_ROWS]
            rows = np.stack(part["vector"].to_numpy()).astype(np.float64)
            length = np.sqrt((rows * rows).sum(axis=1))
            rows = rows / np.where(length == 0, 1e-12, length)[:, None]
            for q in range(0, len(self.queries.ids), TILE_QUERIES):
                self._tile(part, rows, q)

    def _tile(self, part: pd.DataFrame, rows: np.ndarray, first: int) -> None:
        # Twelve places: what lies beyond differs between products of different sizes.
        self.offer(part, np.round(rows @ self.queries.rows[first:first + TILE_QUERIES].T, 12), first)


def _dense_by_matrix(q: DataFrame, v: DataFrame, schema: str) -> DataFrame:
    block = _Matrix.of(q.toPandas())
    # Plain arrays travel: a broadcast is unpickled where the package may not be importable.
    parts = (block.ids, block.rows, block.keep) if block is not None else None
    sent = v.sparkSession.sparkContext.broadcast(parts)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if sent.value is None:
            return
        best = _Best(_Matrix(*sent.value))
        for batch in batches:
            best.add(batch)
        yield best.result()

    return v.mapInPandas(score, schema)


def _dense_by_blocks(q: DataFrame, v: DataFrame, schema: str, block: int) -> DataFrame:
    q_blocks = -(-q.count() // block)
    v_blocks = max(1, -(-v.count() // (block * 16)))
    slot = lambda key, n: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("qb", slot(["query_id"], q_blocks)).withColumn("vb", every(v_blocks))
    right = v.withColumn("vb", slot(["doc_id", "chunk_index"], v_blocks)).withColumn("qb", every(q_blocks))
    columns = [part.split(" ")[0] for part in schema.split(", ")]

    def meet(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        matrix = _Matrix.of(qs)
        if matrix is None or not len(vs):
            return pd.DataFrame(columns=columns)
        best = _Best(matrix)
        best.add(vs)
        return best.result()

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(meet, schema)


# ---------------------------------------------------------------- queries


def _alone(words: tuple[str, ...]) -> str:
    return rf"(?i)(?<![{T.WORD_CHAR}])(?:{'|'.join(words)})(?![{T.WORD_CHAR}])"


def strip_fillers(question: Column) -> Column:
    """Q7: filler words replaced by blanks."""
    return F.regexp_replace(T.strip(question), _alone(FILLERS), " ")


def prepare_queries(queries: DataFrame, top_k: int, expansions=EXPANSIONS) -> DataFrame:
    """Q7 and Q8: add base_text, search_text and fetch_k; blank questions leave."""
    asked = queries.where(F.coalesce(T.strip(F.col("question")), F.lit("")) != "")
    base = strip_fillers(F.col("question"))
    cleaned = T.squeeze(base)
    cleaned = F.when(cleaned == "", T.strip(F.col("question"))).otherwise(cleaned)
    rows = asked.withColumn("base_text", base).withColumn("__clean", cleaned)
    lowered = F.lower("__clean")
    added = F.array(*[
        F.when(_any(lowered, keywords), F.lit(extra)) for keywords, extra in expansions
    ]) if expansions else F.expr("cast(array() AS ARRAY<STRING>)")
    extra = F.array_join(F.slice(F.array_distinct(F.array_compact(added)), 1, 4), " ")
    short = F.size(T.plain_tokens(F.col("__clean"))) <= 12
    rows = rows.withColumn("search_text", F.when(short & (extra != ""), F.concat("__clean", F.lit(" "), extra)).otherwise(F.col("__clean")))
    return rows.withColumn("fetch_k", fetch_size(F.size(T.plain_tokens(F.col("search_text"))), top_k)).drop("__clean")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def fetch_size(tokens: Column, top_k: int) -> Column:
    """Q8."""
    return F.greatest(F.lit(BASE_FETCH), F.lit(top_k * 4), F.least(F.lit(60), F.lit(8) + tokens * 2))


def keyword_overlap(query: Column, content: Column) -> Column:
    """Q9: share of the query's distinct tokens that occur in the content."""
    tokens, lowered = F.array_distinct(T.plain_tokens(query)), F.lower(F.coalesce(content, F.lit("")))
    return F.coalesce(F.try_divide(F.size(F.filter(tokens, lambda t: F.contains(lowered, t))), F.size(tokens)), F.lit(0.0))


# ---------------------------------------------------------------- fusion


def merge_candidates(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Both legs by (query, chunk), the best score on repeats; an absent leg stays NULL."""
    keys = ["query_id", "doc_id", "chunk_index"]
    d = dense.groupBy(*keys).agg(F.max("cosine").alias("cosine"))
    x = lexical.groupBy(*keys).agg(F.max("lexical").alias("lexical"))
    return d.join(x, keys, "full_outer")


def penalty(section: Column, tokens: Column, content: Column) -> Column:
    """Q12."""
    unique = F.size(F.array_distinct(T.plain_tokens(content)))
    hit = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0.0))
    return (
        hit(F.lower(T.strip(F.coalesce(section, F.lit("")))).isin(*WEAK_SECTIONS), 0.06)
        + hit((F.coalesce(tokens, F.lit(0)) > 0) & (tokens < 12), 0.04) + hit(unique < 6, 0.03)
    )


def fuse(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, *, topic_hint: str | None = None) -> DataFrame:
    """Q10-Q12: combined score of merged candidates; irrelevant ones are dropped."""
    per_query = Window.partitionBy("query_id")
    top = F.max("lexical").over(per_query)
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    rows = candidates.withColumn("dense_norm", unit((F.coalesce("cosine", F.lit(-1.0)) + 1.0) / 2.0))
    rows = rows.withColumn("lexical_norm", unit(F.coalesce(F.when(top > 0, F.col("lexical") / top), F.lit(0.0))))
    rows = rows.join(queries.select("query_id", "question", "base_text"), "query_id")
    rows = with_chunks(rows, chunks.select("doc_id", "chunk_index", "doc_name", "content", "metadata"))
    asked = F.when(F.col("base_text") == "", F.col("question")).otherwise(F.col("base_text"))
    rows = rows.withColumn("overlap", keyword_overlap(asked, F.col("content")))
    boost = F.when(F.col("metadata.topic") == topic_hint, F.lit(TOPIC_BOOST)).otherwise(F.lit(0.0)) if topic_hint else F.lit(0.0)
    mixed = (
        F.lit(DENSE_WEIGHT) * F.col("dense_norm") + F.lit(LEXICAL_WEIGHT) * F.col("lexical_norm")
        + F.lit(KEYWORD_WEIGHT) * F.col("overlap") + boost
    )
    weight = F.coalesce(F.nullif(F.col("metadata.source_weight"), F.lit(0.0)), F.lit(1.0))
    less = penalty(F.col("metadata.section_title"), F.col("metadata.token_count"), F.col("content"))
    scored = rows.withColumn("score", F.greatest(F.lit(0.0), mixed * weight - less))
    return scored.where(~(
        (F.col("dense_norm") < MIN_DENSE) & (F.col("lexical_norm") < MIN_LEXICAL) & (F.col("overlap") < MIN_OVERLAP)))


def diverse(scored: DataFrame, k: int, *, score: str = "score", key: str = "query_id", document: str = "doc_id",
            tie: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
    """At most two chunks per document, the second at a discount.

    Taking the best adjusted chunk again and again equals ranking by score minus the discount for the
    chunk's position within its document.
    """
    base = F.round(score, 9)
    ties = [F.col(c) for c in tie]
    w = Window.partitionBy(key, document).orderBy(base.desc(), *ties)
    two = scored.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= PER_DOCUMENT)
    two = two.withColumn("adjusted", F.col(score) - F.lit(REUSE_PENALTY) * (F.col("__r") - 1)).drop("__r")
    return top_n(two, [key], [F.round("adjusted", 9).desc(), base.desc(), *ties], k, rank="position")


def location(metadata: str = "metadata") -> Column:
    """Q14: page and section label."""
    start, end = F.nullif(F.col(f"{metadata}.page_start"), F.lit(0)), F.nullif(F.col(f"{metadata}.page_end"), F.lit(0))
    section = T.strip(F.coalesce(F.col(f"{metadata}.section_title"), F.lit("")))
    page = (
        F.when(start == end, F.concat(F.lit("page "), start)).when(
            start.isNotNull() & end.isNotNull(), F.concat(F.lit("pages "), start, F.lit("-"), end))
        .when(start.isNotNull(), F.concat(F.lit("page "), start))
    )
    return F.concat_ws(", ", page, F.when(section != "", F.concat(F.lit("section "), section)))


def format_results(selected: DataFrame, *, max_chars: int = MAX_CONTEXT_CHARS, max_chunk: int = MAX_CHUNK_CHARS) -> DataFrame:
    """Result lines while the context stays within its budget; the first line always stays.

    ``selected`` holds at most k rows per query, which bounds the window.
    """
    content = T.strip(F.col("content"))
    shown = lambda name: F.round(F.round(name, 9), 4)
    cut = F.when(F.char_length(content) > max_chunk, F.concat(
        F.rtrim(F.substring(content, 1, max_chunk), F.lit(T.WS_CHARS)), F.lit(" ..."))).otherwise(content)
    place = location()
    head = F.format_string(
        "[%d] source: %s (score=%.3f, dense=%.3f, lexical=%.3f, kind=%s%s, lang=%s)\n",
        "position", "doc_name", F.round("adjusted", 9), F.round("dense_norm", 9), F.round("lexical_norm", 9),
        F.coalesce("metadata.source_kind", F.lit("unknown")),
        F.when(place != "", F.concat(F.lit(", "), place)).otherwise(F.lit("")),
        F.coalesce("metadata.language", F.lit("unknown")))
    lines = selected.withColumn("line", F.concat(head, cut))
    kept = context_budget(lines, "line", max_chars)
    return kept.select(
        "query_id", "position", "doc_id", "doc_name", "chunk_index", "line",
        shown("adjusted").alias("score"), shown("dense_norm").alias("dense_score"), shown("lexical_norm").alias("lexical_score"),
        F.col("metadata.source_path").alias("source_path"),
        F.col("metadata.page_start").alias("page_start"), F.col("metadata.page_end").alias("page_end"),
        F.col("metadata.section_title").alias("section_title"), F.col("metadata.language").alias("language"),
        F.col("metadata.source_kind").alias("source_kind"))


def context_budget(lines: DataFrame, text: str, max_chars: int, *, key: str = "query_id", order: str = "position",
                   separator: int = 2) -> DataFrame:
    """Lines while their running length (separators included) fits; lengths are positive, so a prefix is a filter."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    rows = lines.withColumn("__n", first).withColumn(
        "__used", F.sum(F.char_length(text)).over(w) + F.lit(separator) * (F.col("__n") - 1))
    return rows.where((F.col("__n") == 1) | (F.col("__used") <= max_chars)).drop("__n", "__used")


def contexts(formatted: DataFrame) -> DataFrame:
    """Q13: one context text per query from its at most k lines."""
    return formatted.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "line"))), lambda s: s["line"]), "\n\n").alias("context"))


def lexical_search(prepared: DataFrame, chunks: DataFrame, *, fetch: str = "fetch_k", text: str = "search_text",
                   bound: int = BROADCAST_ROWS) -> DataFrame:
    """Q4 straight from chunks, for queries that went through `prepare_queries`.

    Up to ``bound`` query terms travel to the chunks. A text is tokenised once, where it is read; only the counts of query terms are kept.
    Frequencies are summed from them, and a task scores its chunks for all queries and sends on the best rows. More terms and the
    chunks' words are exchanged (`bm25`).
    """
    terms = query_terms(prepared, text)
    if not fits(terms, bound):
        tokens = tokenised(chunks)
        return bm25(prepared, postings(tokens), corpus_stats(tokens), fetch=fetch, text=text)
    asked = terms.toPandas()
    known = np.array(sorted(asked["term"].unique()), dtype=object)
    counts = materialise(counted(chunks, known), "lexical-counts")
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_length").alias("mean")).first()
    entries = entries_of(counts)
    found = entries.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toPandas()
    df = np.zeros(len(known))
    df[found["t"].to_numpy(np.int64)] = found["df"]
    at = np.searchsorted(known, asked["term"].to_numpy())
    weight = np.log1p((stats["n"] - df[at] + 0.5) / (df[at] + 0.5)) * (1.0 + np.log1p(asked["qf"].to_numpy(np.float64)))
    ids, of = np.unique(asked["query_id"].to_numpy(), return_inverse=True)
    keep = prepared.agg(F.coalesce(F.max(fetch), F.lit(1))).first()[0]
    mean = max(stats["mean"], 1e-6) if (stats["mean"] or 0) > 0 else 1.0
    types = dict(counts.dtypes)
    schema = f"query_id {dict(prepared.dtypes)['query_id']}, doc_id {types['doc_id']}, chunk_index {types['chunk_index']}, lexical double"
    order = np.argsort(at, kind="stable")
    sent = counts.sparkSession.sparkContext.broadcast((ids, np.searchsorted(at[order], np.arange(len(known) + 1)), of[order], weight[order]))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, ends, of, weight = sent.value
        top = _Top(ids, int(keep), "lexical")
        tile = max(1, min(TILE_ROWS, TILE_CELLS // max(1, len(ids))))
        for batch in batches:
            for first in range(0, len(batch), tile):
                part = batch.iloc[first:first + tile]
                sizes = part["terms"].map(len).to_numpy()
                if not sizes.sum():
                    continue
                tf = np.concatenate(part["tfs"].to_numpy()).astype(np.float64)
                length = np.concatenate(part["lengths"].to_numpy()).astype(np.float64)
                value = tf * (BM25_K1 + 1.0) / (tf + BM25_K1 * (1.0 - BM25_B + BM25_B * (length / mean)))
                scores = weighted_sums(np.repeat(np.arange(len(part)), sizes), np.concatenate(part["terms"].to_numpy()), value,
                                       len(part), len(ids), ends, of, weight)
                top.offer(part, np.where(scores > 0, scores, -np.inf))
        yield top.result()

    return _best(entries.mapInPandas(score, schema), prepared, "lexical", fetch)


def weighted_sums(rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n_rows: int, n_queries: int, ends: np.ndarray, of: np.ndarray,
                  weight: np.ndarray) -> np.ndarray:
    """For each row and query the sum of value times weight over the terms they share. A term's queries are ``of[ends[t]:ends[t + 1]]``."""
    out = np.zeros(n_rows * n_queries)
    times = ends[terms + 1] - ends[terms]
    upto = np.cumsum(times)
    first = 0
    while first < len(rows):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + TILE_CELLS, "right")))
        n = times[first:last]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = np.repeat(ends[terms[first:last]], n) + within
        out += np.bincount(np.repeat(rows[first:last], n) * n_queries + of[pair], np.repeat(values[first:last], n) * weight[pair], len(out))
        first = last
    return out.reshape(n_rows, n_queries)


def counted(chunks: DataFrame, known: np.ndarray) -> DataFrame:
    """(doc_id, chunk_index, doc_length, terms, tfs): how often each of ``known``, by its number, occurs in a chunk. No row leaves its task."""
    sent = chunks.sparkSession.sparkContext.broadcast(known.tolist())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(sent.value, pa.string())
        for batch in batches:
            tokens = batch.column("tokens")
            number = pc.index_in(tokens.flatten().cast(pa.string()), words)
            hit = pc.is_valid(number).to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(tokens).to_numpy()[hit].astype(np.int64)
            pair, tf = np.unique(row * max(1, len(words)) + number.drop_null().to_numpy(), return_counts=True)
            row, term = np.divmod(pair, max(1, len(words)))
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("chunk_index"), batch.column("doc_length"),
                 pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))],
                names=["doc_id", "chunk_index", "doc_length", "terms", "tfs"])

    # An absent text has the length that `tokenised` gives it.
    rows = chunks.select("doc_id", "chunk_index", T.lexical_tokens(F.col("content")).alias("tokens")).withColumn("doc_length", F.size("tokens"))
    types = dict(rows.dtypes)
    return rows.mapInArrow(count, f"doc_id {types['doc_id']}, chunk_index {types['chunk_index']}, doc_length int, terms array<int>, tfs array<int>")


def entries_of(counts: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, terms, tfs, lengths), a row for each key. As in `postings`, counts of rows of one key and length are added;
    rows of one key and several lengths keep an entry for each. Only the rows of keys that occur again are exchanged."""
    key = ["doc_id", "chunk_index"]
    entries = counts.select(*key, "terms", "tfs", F.array_repeat("doc_length", F.size("terms")).alias("lengths"))
    again = counts.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__d"), F.col("chunk_index").alias("__c"))
    if again.isEmpty():
        return entries
    near = broadcast_if_small(again)
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("chunk_index").eqNullSafe(F.col("__c"))
    more = counts.join(near, same, "left_semi").select(*key, "doc_length", F.explode(F.arrays_zip("terms", "tfs")).alias("e"))
    more = more.groupBy(*key, "doc_length", F.col("e.terms").alias("term")).agg(F.sum("e.tfs").cast("int").alias("tf"))
    more = more.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("term", "doc_length", "tf"))).alias("e"))
    return entries.join(near, same, "left_anti").unionByName(
        more.select(*key, F.col("e.term").alias("terms"), F.col("e.tf").alias("tfs"), F.col("e.doc_length").alias("lengths")))


def with_chunks(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunks`` columns for candidates. Within the bound the candidates travel to the chunks, so no text is exchanged."""
    rows = materialise(rows, "candidates")
    return chunks.join(broadcast_if_small(rows), [c for c in ("doc_id", "chunk_index") if c in chunks.columns])


# ---------------------------------------------------------------- embedding inputs


def embedding_inputs(texts: DataFrame, text: str, *, size: int, task: str = "RETRIEVAL_DOCUMENT") -> DataFrame:
    """Q15: trimmed text, its cache key, and whether it is blank (a blank text embeds as zeros)."""
    trimmed = T.strip(F.coalesce(F.col(text), F.lit("")))
    key = F.sha2(F.concat_ws("|", F.lit(str(size)), F.lit(task), trimmed), 256)
    return texts.withColumn("input", trimmed).withColumn("cache_key", key).withColumn("blank", trimmed == "")


def missing_embeddings(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """Q15: distinct non-blank inputs without a cached vector; copies of a text are reduced first."""
    return (
        inputs.where(~F.col("blank")).groupBy("cache_key").agg(F.first("input").alias("input"))
        .join(cache.select("cache_key"), "cache_key", "left_anti")
    )


def with_embeddings(inputs: DataFrame, cache: DataFrame, *, size: int) -> DataFrame:
    """Q15: attach cached vectors; blank texts get zeros, texts without a vector NULL."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    return inputs.join(cache.select("cache_key", "vector"), "cache_key", "left").withColumn(
        "vector", F.when(F.col("blank"), zeros).when(F.col("vector").isNotNull(), coerce_vector(F.col("vector"), size)))
