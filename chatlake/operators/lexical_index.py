"""Q2, Q4, J7 from a stored index: postings in buckets of terms, with the best score of each block of chunks.

Chunks are put in order of their leading term and length and cut into blocks, so a block holds chunks with alike words. Each (term,
block) has the best part of the BM25 score (all of it but the query's weight) among its postings. For a query, the sum
of the weighted best parts bounds every chunk of a block. A few blocks with the highest bounds are scored first; the
score of the query's last wanted chunk among them is a threshold, and blocks whose bound lies below it are never read in
full. Results are those of `retrieval.bm25`, but that chunks without a doc_id or chunk_index are counted and not found.

Layout below a path: ``postings`` holds one row for each (bucket, block): the terms of that bucket, a hash of the term, in the chunks of that
block, with their best parts, and the postings of all of them one after the other. The bucket ``CHUNKS`` holds a row for each block instead,
with its chunks. ``terms`` has the document frequencies, by ``bucket`` too, and ``stats`` is one row that is written last. A query reads the
buckets of its own terms only. A posting is never a row of its own, neither in a file nor in an exchange.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.functions import text as T
from chatlake.operators import retrieval as Q
# What runs in tasks travels by value: through the name of a module it would take the whole module along.
from chatlake.operators.retrieval import BM25_B, BM25_K1, TILE_CELLS, TILE_ROWS, _Top, weighted_sums
from chatlake.operators.segments import top_n
from chatlake.operators.sizing import BROADCAST_ROWS, fits
from chatlake.session import discard, exists, materialise, shared_folder

BUCKETS = 32
#: The bucket of the rows that hold the chunks of a block.
CHUNKS = -1
#: Chunks of one block, a power of two.
BLOCK = 64
#: Tasks that write one bucket at most: a term of every chunk is dealt out over them by block.
SPREAD = 4
#: Blocks that are scored before the threshold is known, beyond those that the wanted chunks fill.
FIRST_BLOCKS = 3
#: Scores are compared at nine places, so a bound must lie below the threshold by more than this to skip a block.
SLACK = 1e-8


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def part_of(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """The score of a posting but for the query's weight."""
    return tf * (BM25_K1 + 1.0) / (tf + BM25_K1 * (1.0 - BM25_B + BM25_B * (length / max(mean, 1e-6))))


@dataclass(frozen=True)
class LexicalIndex:
    spark: SparkSession
    path: str

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as it is stored, or ``blocks``: (bucket, term, block, best, n) of the postings, of which no other column is read."""
        rows = self.spark.read.parquet(f"{self.path}/{'postings' if name == 'blocks' else name}")
        rows = rows.where(F.col("bucket") != CHUNKS if buckets is None else F.col("bucket").isin(buckets)) if name != "stats" else rows
        if name != "blocks":
            return rows
        return rows.select("bucket", "block", F.explode(F.arrays_zip("terms", "best", "n")).alias("e")).select(
            "bucket", F.col("e.terms").alias("term"), "block", F.col("e.best").alias("best"), F.col("e.n").alias("n"))


def build(chunks: DataFrame, path: str, *, buckets: int = BUCKETS, block: int = BLOCK) -> LexicalIndex:
    """Write the index of ``chunks`` (doc_id, chunk_index, content) below ``path``."""
    counts = materialise(word_counts(chunks), "index-counts")
    mean = F.avg("doc_length")
    stats = counts.agg(F.count(F.lit(1)).alias("n_chunks"), F.when(mean > 0, mean).otherwise(F.lit(1.0)).alias("avg_length"))
    stats = materialise(stats.withColumn("buckets", F.lit(buckets)), "index-stats")
    held = Q.entries_of(counts).where(F.col("doc_id").isNotNull() & F.col("chunk_index").isNotNull() & (F.size("terms") > 0))
    lead = held.select("*", F.array_max(F.arrays_zip("tfs", "terms"))["terms"].alias("lead"), F.array_max("lengths").alias("size"))
    order = ["lead", "size", "doc_id", "chunk_index"]
    # The range partitioner samples, the numbering follows the partitions: both are used in this one write only.
    numbered = lead.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.shiftright(F.monotonically_increasing_id(), block.bit_length() - 1).alias("block"), "doc_id", "chunk_index", "terms", "tfs", "lengths")
    store = lambda rows, name, *by: rows.repartition(*by).sortWithinPartitions(*rows.columns[:2]).write.mode(
        "overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    store(posted(numbered, stats.first()["avg_length"], buckets), "postings", "bucket", F.pmod("block", F.lit(SPREAD)))
    index = LexicalIndex(chunks.sparkSession, path)
    store(index.table("blocks").groupBy("bucket", "term").agg(F.sum("n").alias("df")), "terms", "bucket")
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    discard(counts, stats)
    return index


def word_counts(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, doc_length, terms, tfs): the distinct words of each chunk with their counts. No row leaves its task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            coded = tokens.flatten().cast(pa.string()).dictionary_encode()
            n = max(1, len(coded.dictionary))
            pair, tf = np.unique(pc.list_parent_indices(tokens).to_numpy().astype(np.int64) * n + coded.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(pair, n)
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("chunk_index"), batch.column("doc_length"),
                 pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(code))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))],
                names=["doc_id", "chunk_index", "doc_length", "terms", "tfs"])

    # An absent text has the length that `retrieval.tokenised` gives it.
    rows = chunks.select("doc_id", "chunk_index", T.lexical_tokens(F.col("content")).alias("tokens")).withColumn("doc_length", F.size("tokens"))
    types = dict(rows.dtypes)
    return rows.mapInArrow(count, f"doc_id {types['doc_id']}, chunk_index {types['chunk_index']}, doc_length int, terms array<string>, tfs array<int>")


def posted(numbered: DataFrame, mean: float, buckets: int) -> DataFrame:
    """The rows of ``postings``. ``numbered`` has the chunks of a block one after the other in one task.

    A chunk is one slot, or one for each length where rows of one key have several; ``owners`` are the chunks of the slots."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            number = held.column("block").to_numpy()
            starts = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else []
            # The last block may go on in the next batch.
            for first, end in zip(starts[:-1], starts[1:]):
                yield of_block(held.slice(first, end - first))
            held = held.slice(starts[-1]) if len(starts) else None
        if held is not None:
            yield of_block(held)

    def of_block(chunks: pa.Table) -> pa.RecordBatch:
        chunks = chunks.combine_chunks()
        column = lambda name: chunks.column(name).chunk(0)
        coded = column("terms").flatten().cast(pa.string()).dictionary_encode()
        code, tf = coded.indices.to_numpy(), column("tfs").flatten().to_numpy()
        chunk, length = pc.list_parent_indices(column("terms")).to_numpy().astype(np.int64), column("lengths").flatten().to_numpy()
        slots, slot = np.unique((chunk << 32) + length, return_inverse=True)
        bucket = np.array([zlib.crc32(w.encode()) for w in coded.dictionary.to_pylist()], np.int64) % buckets
        order = np.lexsort((slot, code, bucket[code]))
        by_code = code[order]
        term_at = np.flatnonzero(np.append(True, by_code[1:] != by_code[:-1]))
        best = np.maximum.reduceat(part_of(tf.astype(np.float64), length, mean)[order], term_at)
        of = bucket[by_code[term_at]]
        row_at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        # Behind the rows of the buckets comes the one with the block's chunks; each leaves the other's lists empty.
        lists = lambda at, values: pa.ListArray.from_arrays(pa.array(np.concatenate((at, [len(values)] * 2)).astype(np.int32)), values)
        last = lambda values: pa.ListArray.from_arrays(pa.array([0] * (len(row_at) + 1) + [len(values)], pa.int32()), values)
        ints = lambda values: pa.array(values.astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [ints(np.append(of[row_at], CHUNKS)), pa.array([chunks.column("block")[0].as_py()] * (len(row_at) + 1), pa.int64()),
             lists(row_at, coded.dictionary.take(pa.array(by_code[term_at]))), lists(row_at, pa.array(best)),
             lists(row_at, ints(np.diff(np.append(term_at, len(by_code))))), lists(term_at[row_at], ints(slot[order])),
             lists(term_at[row_at], ints(tf[order])), last(column("doc_id")), last(column("chunk_index")), last(ints(slots & 0xFFFFFFFF)),
             last(ints(slots >> 32))],
            names=["bucket", "block", "terms", "best", "n", "slots", "tfs", "doc_ids", "chunk_indexes", "lengths", "owners"])

    types = dict(numbered.dtypes)
    return numbered.mapInArrow(post, (
        "bucket int, block bigint, terms array<string>, best array<double>, n array<int>, slots array<int>, tfs array<int>, "
        f"doc_ids array<{types['doc_id']}>, chunk_indexes array<{types['chunk_index']}>, lengths array<int>, owners array<int>"))


def stored(spark: SparkSession, source: str, chunks: DataFrame, name: str = "lexical-blocks") -> LexicalIndex:
    """The index of ``chunks`` in the shared folder, built where there is none for the present files of ``source``.

    Files are told apart by path, length and time of change; their bytes are not read for that.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    state = files.agg(F.sum(F.pmod(F.xxhash64("path", "length", "modificationTime"), F.lit(1 << 40))).alias("s"), F.count(F.lit(1)).alias("n")).first()
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{state['s'] or 0:x}-{state['n']}"
    return LexicalIndex(spark, path) if exists(spark, f"{path}/stats/_SUCCESS") else build(chunks, path)


def weighted_terms(queries: DataFrame, index: LexicalIndex, text: str) -> tuple[DataFrame, list[int]]:
    """(query_id, bucket, term, weight) of the queries' terms that occur, and the buckets they lie in."""
    stats = index.table("stats").first()
    terms = Q.query_terms(queries, text).withColumn("bucket", bucket_of(F.col("term"), stats["buckets"]))
    # At most as many rows as there are buckets.
    wanted = sorted(r["bucket"] for r in terms.select("bucket").distinct().collect())
    weight = Q.idf(F.lit(stats["n_chunks"]), F.col("df")) * (F.lit(1.0) + F.log1p(F.col("qf").cast("double")))
    known = index.table("terms", wanted)
    joined = known.join(F.broadcast(terms) if fits(terms) else terms, ["bucket", "term"])
    return joined.select("query_id", "bucket", "term", weight.alias("weight")), wanted


def bm25(queries: DataFrame, index: LexicalIndex, *, fetch: str = "fetch_k", text: str = "search_text",
         block: int = BLOCK, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Q4: the best ``fetch`` chunks per query with a positive score, ranked; the rows of `retrieval.bm25`.

    About ``bound`` terms of ``retrieval.QUERY_BLOCK`` queries travel to the blocks at once; more are searched in as many parts as it takes,
    each with whole queries."""
    weighted, wanted = weighted_terms(queries, index, text)
    weighted = materialise(weighted.where(F.col("query_id").isNotNull()), "query-terms")
    # One bound for a query, also where its row is repeated.
    limits = queries.groupBy("query_id").agg(F.max(fetch).alias(fetch))
    n_terms, n_queries = weighted.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    parts = max(1, -(-n_terms // bound), -(-n_queries // Q.QUERY_BLOCK))
    of = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    scored = [_candidates(weighted.where(of == i) if parts > 1 else weighted, limits, wanted, index, fetch, block) for i in range(parts)]
    return Q._best(reduce(DataFrame.unionByName, scored), queries, "lexical", fetch)


def _candidates(weighted: DataFrame, limits: DataFrame, wanted: list[int], index: LexicalIndex, fetch: str, block: int) -> DataFrame:
    """(query_id, doc_id, chunk_index, lexical) among which each query's best chunks are."""
    most = int(limits.agg(F.coalesce(F.max(fetch), F.lit(1))).first()[0])
    bounds = materialise(block_bounds(weighted, wanted, index), "query-bounds")
    first = materialise(top_n(bounds, ["query_id"], [F.col("bound").desc(), F.col("block")], FIRST_BLOCKS + most // block).select(
        "query_id", "block"), "query-first")
    scored = materialise(exact(first, weighted, wanted, index, most), "query-scored")
    full = Q._best(scored, limits, "lexical", fetch).join(limits.select("query_id", F.col(fetch).alias("__k")), "query_id").groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= F.max("__k"), F.min("lexical")).alias("threshold"))
    open_ = bounds.join(full, "query_id", "left").where(F.col("bound") >= F.coalesce("threshold", F.lit(0.0)) - F.lit(SLACK))
    rest = materialise(open_.join(first, ["query_id", "block"], "left_anti").select("query_id", "block"), "query-rest")
    return scored.unionByName(exact(rest, weighted, wanted, index, most))


@dataclass(frozen=True)
class _Weights:
    """Weights of query terms as arrays: the queries of term ``t`` are ``of[ends[t]:ends[t + 1]]``."""

    terms: np.ndarray
    ids: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    weight: np.ndarray

    @staticmethod
    def taken(weighted: DataFrame) -> _Weights:
        rows = weighted.select("query_id", "term", "weight").toPandas()
        terms, at = np.unique(rows["term"].to_numpy(object), return_inverse=True)
        ids, of = np.unique(rows["query_id"].to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        return _Weights(terms, ids, np.searchsorted(at[order], np.arange(len(terms) + 1)), of[order], rows["weight"].to_numpy(np.float64)[order])


def asked_postings(rows: DataFrame, terms: np.ndarray, keep: list[str]) -> DataFrame:
    """Rows of ``postings`` with the postings of ``terms`` only, as their numbers ``ts``, and of the columns ``keep`` what belongs to them."""
    sent = rows.sparkSession.sparkContext.broadcast(terms.tolist())
    per_term, per_posting = [c for c in keep if c in ("best", "n")], [c for c in keep if c in ("slots", "tfs")]
    other = [c for c in keep if c not in (*per_term, *per_posting)]

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            number = pc.index_in(batch.column("terms").flatten().cast(pa.string()), known)
            hit = pc.is_valid(number).to_numpy(zero_copy_only=False)
            places = np.arange(batch.num_rows + 1)
            row = pc.list_parent_indices(batch.column("terms")).to_numpy()[hit]
            ends = pa.array(np.searchsorted(row, places).astype(np.int32))
            out = {"block": batch.column("block"), "ts": pa.ListArray.from_arrays(ends, number.drop_null().cast(pa.int32()))}
            for c in per_term:
                out[c] = pa.ListArray.from_arrays(ends, batch.column(c).flatten().filter(pa.array(hit)))
            if per_posting:
                held = np.repeat(hit, batch.column("n").flatten().to_numpy())
                row = pc.list_parent_indices(batch.column("slots")).to_numpy()[held]
                upto = pa.array(np.searchsorted(row, places).astype(np.int32))
                for c in per_posting:
                    out[c] = pa.ListArray.from_arrays(upto, batch.column(c).flatten().filter(pa.array(held)))
            out |= {c: batch.column(c) for c in other}
            # A row without any of the terms stays only if it holds the block's chunks.
            use = np.diff(ends.to_numpy()) > 0
            if "doc_ids" in out:
                use |= pc.list_value_length(out["doc_ids"]).fill_null(0).to_numpy(zero_copy_only=False) > 0
            yield pa.RecordBatch.from_pydict(out).filter(pa.array(use))

    columns = ["block", "terms", *keep]
    types = dict(rows.dtypes)
    schema = ", ".join(["block bigint", "ts array<int>", *[f"{c} {types[c]}" for c in [*per_term, *per_posting, *other]]])
    return rows.select(*columns).mapInArrow(select, schema)


def _whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of each block, which come one after the other."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat((held, batch))
        last = held["block"].iloc[-1] if len(held) else None
        for number, rows in held[held["block"] != last].groupby("block", sort=False):
            yield number, rows
        held = held[held["block"] == last] if len(held) else None
    if held is not None:
        yield held["block"].iloc[0], held


def _joined(lists: pd.Series, kind: type) -> np.ndarray:
    parts = [x for x in lists if x is not None and len(x)]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def block_bounds(weighted: DataFrame, wanted: list[int], index: LexicalIndex) -> DataFrame:
    """(query_id, block, bound) of the blocks that hold a term of the query. Best parts travel once, by block."""
    asked = _Weights.taken(weighted)
    sent = index.spark.sparkContext.broadcast((asked.ids, asked.ends, asked.of, asked.weight))
    rows = asked_postings(index.table("postings", wanted), asked.terms, ["best"]).repartition("block").sortWithinPartitions("block")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, ends, of, weight = sent.value
        for number, part in _whole_blocks(batches):
            ts, best = _joined(part["ts"], np.int64), _joined(part["best"], np.float64)
            bound = weighted_sums(np.zeros(len(ts), np.int64), ts, best, 1, len(ids), ends, of, weight)[0]
            at = np.flatnonzero(bound)
            yield pd.DataFrame({"query_id": ids[at], "block": number, "bound": bound[at]})

    return rows.mapInPandas(add, f"query_id {dict(weighted.dtypes)['query_id']}, block bigint, bound double")


def exact(pairs: DataFrame, weighted: DataFrame, wanted: list[int], index: LexicalIndex, keep: int) -> DataFrame:
    """Positive scores of chunks in the given blocks of each query, of which a task sends on the best ``keep`` for a query. A chunk's
    postings lie in one block, so its score is whole. Postings of asked blocks and terms travel once, by block, a row for each bucket."""
    asked = _Weights.taken(weighted)
    mean = index.table("stats").first()["avg_length"]
    sent = index.spark.sparkContext.broadcast((asked.ids, asked.ends, asked.of, asked.weight))
    by_block = pairs.groupBy("block").agg(F.collect_list("query_id").alias("asked"))
    stored_rows = index.table("postings", [*wanted, CHUNKS])
    blocks = by_block.select("block")
    if fits(blocks):
        stored_rows = stored_rows.join(F.broadcast(blocks), "block", "left_semi")
    columns = ["n", "slots", "tfs", "doc_ids", "chunk_indexes", "lengths", "owners"]
    rows = asked_postings(stored_rows, asked.terms, columns).unionByName(by_block, allowMissingColumns=True)
    rows = rows.repartition("block").sortWithinPartitions("block")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, ends, of, weight = sent.value
        term_of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        top = _Top(ids, keep, "lexical")
        tile = max(1, min(TILE_ROWS, TILE_CELLS // max(1, len(ids))))
        chunks, scores, held = [], [], 0
        for _, part in _whole_blocks(batches):
            ts, queries = _joined(part["ts"], np.int64), _joined(part["asked"], object)
            if not len(ts) or not len(queries):
                continue
            # Only the queries that ask for this block are scored.
            mine = np.zeros(len(ids), bool)
            mine[np.searchsorted(ids, queries)] = True
            use = mine[of]
            slot, n = _joined(part["slots"], np.int64), _joined(part["n"], np.int64)
            found = pd.DataFrame({"doc_id": _joined(part["doc_ids"], object), "chunk_index": _joined(part["chunk_indexes"], object)})
            value = part_of(_joined(part["tfs"], np.int64).astype(np.float64), _joined(part["lengths"], np.int64)[slot], mean)
            chunks.append(found)
            scores.append(weighted_sums(_joined(part["owners"], np.int64)[slot], np.repeat(ts, n), value, len(found), len(ids),
                                        np.searchsorted(term_of[use], np.arange(len(ends))), of[use], weight[use]))
            held += len(found)
            if held >= tile:
                offer(top, chunks, scores)
                chunks, scores, held = [], [], 0
        if held:
            offer(top, chunks, scores)
        yield top.result()

    def offer(top: _Top, chunks: list[pd.DataFrame], scores: list[np.ndarray]) -> None:
        every = np.concatenate(scores)
        top.offer(pd.concat(chunks, ignore_index=True), np.where(every > 0, every, -np.inf))

    types = dict(stored_rows.dtypes)
    kind = lambda c: types[c].removeprefix("array<").removesuffix(">")
    return rows.mapInPandas(score, f"query_id {dict(weighted.dtypes)['query_id']}, doc_id {kind('doc_ids')}, chunk_index {kind('chunk_indexes')}, "
                                   "lexical double")
