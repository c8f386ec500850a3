"""Removal of word sequences that repeat an earlier one, found by fixed-block anchors.

Every text is indexed by its non-overlapping blocks of ten words. Every rolling run of ten words probes that index. A window of
20 words holds a whole block wherever it lies, so two equal windows give hits at both places. Around hits, windows are compared
in full (by a 64-bit hash of 20 words); of equal windows all but the first lose their words, which covers maximal repeats.

The first is the one of the smallest id, then of the smallest start. Windows are judged on the input. Null and empty texts have no
words. Repeated rows of one id are the same document: equal windows at the same start do not remove each other; windows at
different starts do. A null id comes before all others. An empty table gives no rows. Columns other than the id and the text are not
read. A task keeps one run per hash of what it has collected, so a passage that a third of all documents share meets in a bucket once per
two million words, not once per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm import blobs
from chatlake.llm.common import gram_hashes, gram_starts, mixed, read, steps, utf8, word_hashes, word_spans
from chatlake.llm.registry import query
from chatlake.session import materialise

WINDOW = 20
BLOCK = 10
#: Ids up to this number are broadcast (16 bytes each); beyond it, the join deals the texts out by id.
BROADCAST_IDS = 2_000_000
_NO_ID = -(1 << 63)


def _first_of_equal(keys: np.ndarray, owners: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, owner, place), and for that order whether an entry has the key and not the place of the first with its key."""
    order = np.lexsort((places, owners, keys))
    k, o, p = keys[order], owners[order], places[order]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0)) if len(k) else np.zeros(0, np.int64)
    return order, ~new & ((o != o[head]) | (p != p[head]))


class Collected:
    """Entries of several steps."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, owners: np.ndarray, places: np.ndarray) -> bool:
        self.parts.append((keys, owners, places))
        self.size += len(keys)
        return self.size >= blobs.FLUSH

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        return out


def _passed_on(owners: np.ndarray, places: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Finished entries as rows of the same form: no keys, and the buckets below zero."""
    rows = returned(owners, places, buckets).to_batches()[0]
    return rows.set_column(0, "bucket", pa.array(-1 - rows["bucket"].to_numpy(), pa.int32()))


def anchors(docs: DataFrame, buckets: int, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Rolling runs by bucket of their hash; the lowest bit of a stored key marks a reference block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Collected()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, owners, places = own.take()
            order = np.argsort(keys, kind="stable")
            k = keys[order]
            new = np.append(True, k[1:] != k[:-1])
            single = new & np.append(new[1:], True)
            again = order[~single]
            if len(again):  # it repeats here: a hit whatever the index holds; one of each goes on to meet other tasks' runs
                yield _passed_on(owners[again], places[again], buckets)
            kept = order[new]
            aligned = np.bitwise_or.reduceat((places[order] % block == 0).astype(np.uint32), np.flatnonzero(new))
            stored = (keys[kept] & np.uint64(0xFFFFFFFE)).astype(np.uint32) | aligned
            by_place = np.argsort(kept)
            kept, stored = kept[by_place], stored[by_place]
            yield blobs.packed(keys[kept], stored, owners[kept], places[kept], buckets)

        for step in steps(batches):
            raw, offsets = utf8(step["text"])
            starts, ends, first = word_spans(raw, offsets)
            at = gram_starts(first, block)
            doc = np.searchsorted(first, at, side="right") - 1
            if len(at) and own.add(gram_hashes(word_hashes(raw, starts, ends), block)[at], step["id"].to_numpy(zero_copy_only=False)[doc],
                                   (at - first[doc]).astype(np.uint32)):
                yield from flush()
        if own.size:
            yield from flush()

    return docs.mapInArrow(run, blobs.SCHEMA)


def by_owners(table: pa.Table) -> pa.Table:
    """One row per owner of a bucket, with all its places."""
    _, owners, places = blobs.unpacked(table, np.uint8)
    return pa.Table.from_batches([blobs.by_owner(owners, places, ("id", "places"))])


def returned(owners: np.ndarray, places: np.ndarray, buckets: int) -> pa.Table:
    """Entries on their way back to their owners, by bucket of the owner: fewer and larger rows than on the way here."""
    buckets = max(1, buckets // blobs.PER_PARTITION ** 2)
    key = mixed(owners.view(np.uint64))
    return pa.Table.from_batches([blobs.packed(key, np.zeros(len(key), np.uint8), owners, places, buckets)])


def hits(docs: DataFrame, buckets: int, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``id`` and ``places``: runs that also occur elsewhere, at least one of the places being a reference block."""
    def meet(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            _, owners, places = blobs.unpacked(table, np.uint8)
        else:
            keys, owners, places = blobs.unpacked(table, np.uint32)
            order = np.argsort(keys >> np.uint32(1), kind="stable")
            k = keys[order] >> np.uint32(1)
            cuts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            counts = np.diff(np.append(cuts, len(k)))
            block_in = np.bitwise_or.reduceat(keys[order] & np.uint32(1), cuts) > 0
            chosen = order[np.repeat((counts > 1) & block_in, counts)]
            owners, places = owners[chosen], places[chosen]
        return returned(owners, places, buckets)

    met = anchors(docs, buckets, window, block).groupBy("bucket").applyInArrow(meet, blobs.SCHEMA)
    return met.groupBy("bucket").applyInArrow(by_owners, "id long, places binary")


def with_lists(docs: DataFrame, lists: DataFrame, bound: int = BROADCAST_IDS) -> tuple[DataFrame, DataFrame | None]:
    """(rows with ``places``, one list for each id, and rows without). Up to ``bound`` ids, the ids are broadcast to leave out the other texts before the
    join; beyond that the texts are dealt out by id, and the second frame is None as the first has all rows."""
    ids = lists.select("id")
    if ids.limit(bound + 1).count() > bound:
        return docs.join(lists, "id", "left"), None
    few = F.broadcast(ids)
    return docs.join(few, "id", "left_semi").join(lists, "id"), docs.join(few, "id", "left_anti").withColumn(
        "places", F.lit(None).cast("binary"))


def _places(listed: bytes | None) -> np.ndarray:
    return np.frombuffer(listed or b"", "<u4").astype(np.int64)


def windows(rows: DataFrame, buckets: int, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The windows around hits, by bucket of their full hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Collected()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, owners, places = own.take()
            order, later = _first_of_equal(keys, owners, places)
            if later.any():
                yield _passed_on(owners[order[later]], places[order[later]], buckets)
            kept = np.sort(order[~later])
            yield blobs.packed(keys[kept], keys[kept], owners[kept], places[kept], buckets)

        for step in steps(batches):
            raw, offsets = utf8(step["text"])
            starts, ends, first = word_spans(raw, offsets)
            hashes = gram_hashes(word_hashes(raw, starts, ends), window)
            candidate = np.zeros(len(starts) + 1, bool)
            for i, listed in enumerate(step["places"].to_pylist()):
                places, size = _places(listed), int(first[i + 1] - first[i])
                if size >= window and len(places):
                    edges = np.zeros(size + window, np.int32)
                    np.add.at(edges, np.maximum(places - (window - block), 0), 1)
                    np.add.at(edges, places + 1, -1)
                    candidate[first[i]:first[i] + size - window + 1] = np.cumsum(edges)[:size - window + 1] > 0
            at = np.flatnonzero(candidate)
            doc = np.searchsorted(first, at, side="right") - 1
            if len(at) and own.add(hashes[at], step["id"].to_numpy(zero_copy_only=False)[doc], (at - first[doc]).astype(np.uint32)):
                yield from flush()
        if own.size:
            yield from flush()

    return rows.select("id", "text", "places").mapInArrow(run, blobs.SCHEMA)


def later_windows(rows: DataFrame, buckets: int, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``id`` and ``places``: starts of the windows that are not the first of their sequence."""
    def meet(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            _, owners, places = blobs.unpacked(table, np.uint8)
        else:
            keys, owners, places = blobs.unpacked(table, np.uint64)
            order, later = _first_of_equal(keys, owners, places)
            owners, places = owners[order[later]], places[order[later]]
        return returned(owners, places, buckets)

    met = windows(rows, buckets, window, block).groupBy("bucket").applyInArrow(meet, blobs.SCHEMA)
    return met.groupBy("bucket").applyInArrow(by_owners, "id long, places binary")


KEPT = "id long, n_words long, n_removed long, kept_sha256 string"


def kept_words(rows: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Per row, the words in no later window: counts, digest and, if asked for, the text itself."""
    schema = KEPT + (", kept_text string" if texts else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            totals, removed, digests, bodies = [], [], [], []
            for text, listed in zip(step["text"].to_pylist(), step["places"].to_pylist(), strict=True):
                found = (text or "").encode().split()
                places = _places(listed)
                totals.append(len(found))
                if len(places):
                    edges = np.zeros(len(found) + window + 1, np.int32)
                    np.add.at(edges, places, 1)
                    np.add.at(edges, places + window, -1)
                    keep = np.cumsum(edges)[:len(found)] == 0
                    found = list(compress(found, keep.tolist()))
                removed.append(totals[-1] - len(found))
                body = b" ".join(found)
                digests.append(hashlib.sha256(body).hexdigest())
                if texts:
                    bodies.append(body.decode())
            columns = [step["id"], pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(bodies, pa.string())] if texts else []), names)

    return rows.select("id", "text", "places").mapInArrow(run, schema)


def deduplicated(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, texts: bool = False) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for, ``kept_text`` of every row."""
    if window < 2 * block - 1:
        raise ValueError("a window must be able to hold a whole block wherever it starts")
    rows = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "text")
    buckets = blobs.bucket_count(docs.sparkSession)
    found = materialise(hits(rows, buckets, window, block), "repeat-hits")
    near, _ = with_lists(rows, found)
    later = materialise(later_windows(near, buckets, window, block), "repeat-windows")
    cut, rest = with_lists(rows, later)
    out = kept_words(cut, window, texts)
    if rest is not None:
        out = out.unionByName(kept_words(rest, window, texts))
    return out.withColumn("doc_id", F.when(F.col("id") != _NO_ID, F.col("id"))).select("doc_id", *[c for c in out.columns if c != "id"])


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
spots AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
seqs AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM spots),
later AS (SELECT doc_id, i FROM seqs QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later)),
gone_list AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ')
  ELSE coalesce(array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN gone_list USING (doc_id)
""")
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicated(read(spark, folder, "documents"))
