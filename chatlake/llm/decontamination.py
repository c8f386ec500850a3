"""Words of documents that lie in a window of a benchmark item, by a prefix-filtered join of shingle sets.

An item's windows are its runs of ten consecutive words; an item of fewer words is one window. A window is a set of shingles (runs of
five words; shorter windows are one shingle) with their places in it. A document holds a window only if it holds all of its shingles, so of
the shingles in order of rarity a prefix of one is enough to find it: the rarest, by the number of times that each shingle of the
benchmark occurs in all documents.

The documents are read twice, once to count those shingles and once to find the places of the prefix shingles; in both, a bitmap of fixed size
leaves out nearly all shingles that no window has. A place goes on with the few words around it, so that the join knows whether
the window fits between the document's ends there (length and position) and compares the words themselves.

Words are runs of letters a-z, digits and characters beyond ASCII after A-Z are lower-cased. Null and empty texts have no words; an item
without words has no window. Items that repeat an id are one item with several texts; items without an id mark words but are in no
list of items. Every row is judged on its own, so repeated rows and rows without an id each have a result. Without benchmark rows nothing is
hit. Columns other than the ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import gram_hashes, gram_starts, mixed, read, steps, utf8, word_hashes, word_spans
from chatlake.llm.registry import query
from chatlake.session import materialise

WINDOW = 10
SHINGLE = 5
#: Bits of the bitmap of shingles, as a power of two; it has this size whatever the tables.
FILTER_BITS = 24
#: Distinct counts that a counting task holds before it passes them on.
FLUSH = 1 << 20
#: Prefix entries (about 150 bytes each) up to which they are broadcast; beyond it both sides are dealt out by shingle and ``SALTS``.
BROADCAST_ENTRIES = 200_000
SALTS = 16

#: Lower case of every byte of a word; 32 for the others.
_WORD_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The normal bytes of all texts, the hashes of one to ``size`` words from each place, and the words' starts, ends and texts."""
    raw, offsets = utf8(texts)
    low = _WORD_BYTES[raw]
    starts, ends, first = word_spans(low, offsets)
    hashes = word_hashes(low, starts, ends)
    return low, [gram_hashes(hashes, n) for n in range(1, size + 1)], starts, ends, first


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``text`` (words joined by one space), ``length`` and ``items`` (ids of the items that have it)."""
    items = benchmark.select("item_id", F.regexp_extract_all(lowered(F.col("text")), F.lit(_WORD), 0).alias("ws")).filter(F.size("ws") > 0)
    last = F.greatest(F.size("ws") - window + 1, F.lit(1))
    spots = items.select("item_id", "ws", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    cut = spots.select("item_id", F.slice("ws", F.col("at"), window).alias("part"))
    return cut.groupBy(F.array_join("part", " ").alias("text"), F.size("part").alias("length")).agg(
        F.array_sort(F.collect_set("item_id")).alias("items"))


def window_shingles(found: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``shingle`` (a hash), its number of words and its ``place`` in the window, for all shingles of all windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            _, grams, _, _, first = shingle_hashes(step["text"], size)
            rows, hashes, sizes, places = [], [], [], []
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                n = min(size, b - a)
                count = b - a - n + 1
                rows.append(np.full(count, i))
                hashes.append(grams[n - 1][a:a + count])
                sizes.append(np.full(count, n, np.int32))
                places.append(np.arange(count, dtype=np.int32))
            at = pa.array(np.concatenate(rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [step[c].take(at) for c in ("text", "length", "items")] + [
                    pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))],
                ["text", "length", "items", "shingle", "words", "place"])

    kind = found.schema["items"].dataType.simpleString()
    return found.mapInArrow(run, f"text string, length int, items {kind}, shingle long, words int, place int")


def bitmap(shingles: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Two bits for each shingle, from both ends of its hash: at most 2^bits / 64 rows reach the driver."""
    slots = F.array(F.shiftrightunsigned("shingle", 64 - bits), F.col("shingle").bitwiseAND((1 << bits) - 1))
    words = shingles.select(F.explode(slots).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))).alias("mask"))
    out = np.zeros(max(1, (1 << bits) // 64), np.int64)
    for row in words.toLocalIterator():
        out[row["word"]] = row["mask"]
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def possible(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of the hashes whose bits are set."""
    bits = int(len(known)).bit_length() - 1
    near = np.flatnonzero(known[hashes >> np.uint64(64 - bits)])
    return near[known[hashes[near] & np.uint64((1 << bits) - 1)] > 0]


def occurrences(docs: DataFrame, shingles: DataFrame, sizes: list[int], size: int = SHINGLE, bits: int = FILTER_BITS) -> DataFrame:
    """``shingle`` and how many times it occurs in all documents. Other shingles that share its bits are counted too, under their own hash."""
    known = docs.sparkSession.sparkContext.broadcast(bitmap(shingles, bits))

    def passed(total: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for step in steps(batches):
            _, grams, _, _, first = shingle_hashes(step["text"], size)
            for n in sizes:
                at = gram_starts(first, n)
                hashes = grams[n - 1][at]
                found, counts = np.unique(hashes[possible(hashes, known.value)], return_counts=True)
                for h, c in zip(found.view(np.int64).tolist(), counts.tolist(), strict=True):
                    total[h] = total.get(h, 0) + c
            if len(total) >= FLUSH:
                yield passed(total)
                total = {}
        yield passed(total)

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def prefixes(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """Of each window's shingles the rarest, ties by hash and place."""
    known = shingles.join(counts, "shingle", "left")
    rarest = F.min_by(F.struct("shingle", "words", "place"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place")).alias("rarest")
    return known.groupBy("text", "length").agg(rarest, F.first("items").alias("items")).select("rarest.*", F.col("text").alias("wanted"), "length", "items")


PLACES = "array<struct<shingle: long, words: int, at: int, before: int, around: string>>"


def places(docs: DataFrame, entries: DataFrame, sizes: list[int], window: int = WINDOW, size: int = SHINGLE, bits: int = FILTER_BITS) -> DataFrame:
    """Per row ``doc_id``, ``n_words`` and the places of prefix shingles: where (``at``), how many words of ``around`` come ``before`` it."""
    known = docs.sparkSession.sparkContext.broadcast(bitmap(entries, bits))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            low, grams, starts, ends, first = shingle_hashes(step["text"], size)
            owners, columns = [np.zeros(0, np.int64)], [[np.zeros(0, t)] for t in (np.int64, np.int32, np.int64)]
            for n in sizes:
                spots = gram_starts(first, n)
                spots = spots[possible(grams[n - 1][spots], known.value)]
                owners.append(np.searchsorted(first, spots, side="right") - 1)
                for column, values in zip(columns, (grams[n - 1][spots].view(np.int64), np.full(len(spots), n, np.int32), spots), strict=True):
                    column.append(values)
            owner = np.concatenate(owners)
            order = np.argsort(owner, kind="stable")
            owner = owner[order]
            hashes, words, spots = (np.concatenate(c)[order] for c in columns)
            # A window has its shingle at place 0 to window - size, so that many words before and after it can belong to it.
            reach = np.where(words == size, window - size, 0)
            lo, hi = np.maximum(spots - reach, first[owner]), np.minimum(spots + words + reach, first[owner + 1])
            text = low.tobytes()
            around = [b" ".join(text[a:b].split()) for a, b in zip(starts[lo].tolist(), ends[hi - 1].tolist(), strict=True)]
            parts = pa.StructArray.from_arrays([pa.array(hashes), pa.array(words), pa.array((spots - first[owner]).astype(np.int32)),
                                                pa.array((spots - lo).astype(np.int32)), pa.array(around, pa.binary()).cast(pa.string())],
                                               ["shingle", "words", "at", "before", "around"])
            cuts = np.searchsorted(owner, np.arange(step.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([step["doc_id"], pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(cuts), parts)],
                                             ["doc_id", "n_words", "places"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, places {PLACES}")


def hits(rows: DataFrame, entries: DataFrame, bound: int = BROADCAST_ENTRIES) -> DataFrame:
    """``row``, ``first``, ``stop`` and ``items`` of the windows that occur: the entry's words stand around its shingle's place."""
    spots = rows.select("row", F.inline("places"))
    if entries.limit(bound + 1).count() <= bound:
        met = spots.join(F.broadcast(entries), ["shingle", "words"])
    else:
        salted = spots.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int"))
        copies = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = salted.join(copies, ["shingle", "words", "salt"])
    around = F.split("around", " ")
    fits = (F.col("before") >= F.col("place")) & (F.size(around) - F.col("before") >= F.col("length") - F.col("place"))
    start = F.col("at") - F.col("place")
    return met.filter(fits).filter(F.array_join(F.slice(around, F.col("before") - F.col("place") + 1, F.col("length")), " ") == F.col("wanted")).select(
        "row", start.alias("first"), (start + F.col("length")).alias("stop"), "items")


def marked(docs: DataFrame, benchmark: DataFrame, bound: int = BROADCAST_ENTRIES, bits: int = FILTER_BITS) -> DataFrame:
    """``doc_id``, ``n_words``, ``spans`` (first and stop of every window that occurs, in order) and ``items`` of every row."""
    found = materialise(windows(benchmark), "leak-windows")
    sizes = sorted(r[0] for r in found.select(F.least("length", F.lit(SHINGLE))).distinct().collect())
    shingles = materialise(window_shingles(found), "leak-shingles")
    entries = materialise(prefixes(shingles, occurrences(docs, shingles, sizes, bits=bits)), "leak-prefixes")
    rows = materialise(places(docs, entries, sizes, bits=bits).withColumn("row", F.monotonically_increasing_id()), "leak-places")
    spans = F.array_sort(F.collect_set(F.struct("first", "stop"))).alias("spans")
    lists = hits(rows.filter(F.size("places") > 0), entries, bound).groupBy("row").agg(
        spans, F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("spans", "array<struct<first: int, stop: int>>"), ("items", found.schema["items"].dataType))]
    plain = rows.filter(F.size("places") == 0).select("doc_id", "n_words", *none)
    return rows.filter(F.size("places") > 0).select("row", "doc_id", "n_words").join(lists, "row", "left").drop("row").unionByName(plain)


@query(r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(ws), 10) AS l, array_to_string(ws[i:i + 9], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
spots AS (SELECT doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') AS g
  FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM wins) WHERE len(ws) >= l)),
hits AS (SELECT doc_id, i, l, item_id FROM spots JOIN wins USING (l, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit_words.n, 0)::BIGINT AS n_hit, coalesce(hit_items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, hit_words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
""")
def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = marked(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["first"], acc["reach"]))).alias("n"), F.greatest(acc["reach"], s["stop"]).alias("reach"))
    n_hit = F.coalesce(F.aggregate("spans", start, step, lambda acc: acc["n"]), F.lit(0)).cast("long")
    items = F.coalesce(F.col("items"), F.array().cast(found.schema["items"].dataType))
    listed = F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
                        F.coalesce(F.size("spans") > 0, F.lit(False)).alias("contaminated"))
