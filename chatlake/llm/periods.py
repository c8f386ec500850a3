"""Periodic runs of words, found in tiles for each octave of periods, and texts without the repeats.

A run is a stretch with a smallest period q, at least ``max(MIN_LENGTH, 2 * q)`` words long, that no neighbouring word extends. Of a
stretch, the *matches* are the places i whose word equals the word at i + q; a run of period q has q matches in a row at least.

Documents are cut into overlapping tiles. Periods up to a quarter of ``TILE`` share tiles; each octave above has tiles of eight
times its period. Two neighbouring tiles overlap by two periods or more, so whatever part of a run lies in a tile is found there. In a
tile, boundaries lie at every half of the octave's least period: q matches in a row cover the half after one of them. Where the hash
of that many words at a boundary meets an equal one a period further, prefix comparisons from the boundary to both sides (its
Z-functions, by hashes of 2^k words) give the fragment. Fragments are shuffled by document and period and stitched; a stretch that has several
periods keeps the least. A document of one tile is solved where it is read, tiles of longer ones are dealt to all tasks.

Null and empty texts have no words and no runs. A null id is not damaged. Rows that repeat an id and a text have the same runs
and are solved once or more, with the same outcome. An empty table gives no rows. Columns other than the id and the text are not read.
Words are equal by their bytes; runs of words by 64-bit hashes of their numbers within one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.llm.common import mixed, read, steps
from chatlake.llm.registry import query
from chatlake.session import materialise

MIN_LENGTH = 12
#: Words from the start of one tile to the next for short periods, a power of two.
TILE = 1 << 14
#: Periods below this are compared word by word.
SHORT = 8
#: Comparisons held at once while the boundaries of an octave are searched.
COMPARED = 1 << 22
#: Documents with runs, up to which their ids are broadcast (24 bytes each); beyond it, all texts are dealt out by id.
BROADCAST_ROWS = 1_000_000

KEY = ["id", "k1", "k2"]
_PIECES = "id long, k1 long, k2 int, least int, most int, start int, words int, codes binary"
_FRAGMENTS = "id long, k1 long, k2 int, period int, first int, stop int"


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def damage(n: int, h: int | None) -> np.ndarray:
    """Which of ``n`` original words stands at each place: a part of one document in ten is made to repeat itself."""
    at = np.arange(n)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def plan(n: int, tile: int = TILE) -> Iterator[tuple[int, int, int, int]]:
    """(least period, bound of periods, start, stop) of each tile of a text of ``n`` words."""
    least, most = 1, max(2 * SHORT, tile // 4)
    while n >= max(MIN_LENGTH, 2 * least):
        stride, halo = max(tile, 4 * most), 2 * most
        for start in range(0, max(1, n - halo), stride):
            yield least, most, start, min(n, start + stride + halo)
        least, most = most, 2 * most


class Levels:
    """Hashes of 1, 2, 4, ... consecutive words from each place."""

    def __init__(self, codes: np.ndarray) -> None:
        self.found = {1: mixed(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))}

    def of(self, words: int) -> np.ndarray:
        if words not in self.found:
            half = self.of(words // 2)
            size = max(0, len(half) - words // 2)
            self.found[words] = mixed(half[:size] * np.uint64(0x9FB21C651E98DF25) + half[len(half) - size:])
        return self.found[words]


def _direct(codes: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of all rows of matches of a short period."""
    same = np.zeros(len(codes) - q + 2, np.int8)
    same[1:-1] = codes[:-q] == codes[q:]
    edges = np.flatnonzero(np.diff(same))
    return edges[::2], edges[1::2]


def _octave(levels: Levels, size: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, start, stop) of rows of matches that cover the half octave after a boundary, for periods in [least, 2 * least)."""
    half = least // 2
    hashes = levels.of(half)
    bounds = max(0, (size - least - half) // half + 1)
    ahead = sliding_window_view(np.concatenate((hashes[least:], np.zeros(2 * least, np.uint64))), least)[::half]
    at, periods = [], []
    for i in range(0, bounds, max(1, COMPARED // least)):
        j = min(bounds, i + max(1, COMPARED // least))
        row, column = np.nonzero(ahead[i:j] == hashes[i * half:(j - 1) * half + 1:half, None])
        at.append((row + i) * half)
        periods.append(column + least)
    b = np.concatenate(at) if at else np.zeros(0, np.int64)
    q = np.concatenate(periods) if periods else np.zeros(0, np.int64)
    inside = b + q + half <= size
    b, q = b[inside], q[inside]
    order = np.lexsort((b, q))
    b, q = b[order], q[order]
    fresh = np.append(True, (q[1:] != q[:-1]) | (b[1:] != b[:-1] + half))[:len(b)]
    start, q = b[fresh], q[fresh]
    stop = b[np.append(fresh[1:], True)[:len(b)]] + half
    words = half // 2
    while words and len(q):
        known = levels.of(words)
        back = np.maximum(start - words, 0)
        start = np.where((start >= words) & (known[back] == known[back + q]), back, start)
        there = np.minimum(stop, size - words - q)
        stop = np.where((stop == there) & (known[there] == known[there + q]), stop + words, stop)
        words //= 2
    return q, start, stop


def fragments(codes: np.ndarray, least: int, most: int, cut_left: bool, cut_right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, first, stop) of the matches of runs, and of rows of matches that a cut end of the tile may shorten."""
    size, found = len(codes), []
    for q in range(least, min(SHORT, most, size)):
        first, stop = _direct(codes, q)
        found.append((np.full(len(first), q), first, stop))
    levels, octave = Levels(codes), max(least, SHORT)
    while octave < min(most, size):
        found.append(_octave(levels, size, octave))
        octave *= 2
    q, first, stop = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    whole = stop - first >= np.maximum(q, MIN_LENGTH - q)
    kept = whole | (cut_left & (first == 0)) | (cut_right & (stop + q == size))
    q, first, stop, whole = q[kept], first[kept], stop[kept], whole[kept]
    # The least period of equal stretches stays: a multiple of it says nothing new, here as in the document.
    order = np.lexsort((q, stop + q, first))
    q, first, stop, whole = q[order], first[order], stop[order], whole[order]
    again = np.append(False, (first[1:] == first[:-1]) & ((stop + q)[1:] == (stop + q)[:-1]))[:len(q)]
    fresh = ~(again & whole)
    return q[fresh], first[fresh], stop[fresh]


def numbered(docs: DataFrame) -> DataFrame:
    """``id``, ``text``, the damage's number ``h`` and a key of 96 bits that tells apart texts of one id."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"),
                       F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"))


def _pieces(columns: list[list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])


def tiles(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """The tiles of documents that have several, ``codes`` being the words' numbers within the document as 32-bit integers. For a
    document of one tile its fragments, as rows without codes: period, first and stop stand in ``least``, ``start`` and ``words``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            out: list[list] = [[] for _ in range(8)]
            for *key, h, text in zip(*(step[c].to_pylist() for c in (*KEY, "h", "text")), strict=True):
                found = word_list(text)
                cuts = list(plan(len(found), tile))
                if not cuts:
                    continue
                codes = pa.array(found, pa.binary()).dictionary_encode().indices.to_numpy()[damage(len(found), h)]
                if len(cuts) == 1:
                    made = [(q, None, a, b, None) for q, a, b in zip(*(x.tolist() for x in fragments(codes, *cuts[0][:2], False, False)), strict=True)]
                else:
                    made = [(least, most, start, len(found), codes[start:stop].astype("<u4").tobytes()) for least, most, start, stop in cuts]
                for values in made:
                    for column, value in zip(out, (*key, *values), strict=True):
                        column.append(value)
            yield _pieces(out)

    return rows.mapInArrow(run, _PIECES)


def solved(tiled: DataFrame) -> DataFrame:
    """The fragments of all tiles, in places of the document, and those found before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "codes"):
            keys, found = [], []
            for at, (least, most, start, words, raw) in enumerate(zip(*(step[c].to_pylist() for c in (
                    "least", "most", "start", "words", "codes")), strict=True)):
                if raw is None:
                    q, first, stop = (np.array([x]) for x in (least, start, words))
                else:
                    codes = np.frombuffer(raw, "<u4")
                    q, first, stop = fragments(codes, least, most, start > 0, start + len(codes) < words)
                    first, stop = first + start, stop + start
                keys.append(np.full(len(q), at))
                found.append((q, first, stop))
            rows = pa.array(np.concatenate(keys).astype(np.int64))
            numbers = [pa.array(np.concatenate(x).astype(np.int32)) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([step[c].take(rows) for c in KEY] + numbers, [*KEY, "period", "first", "stop"])

    return tiled.mapInArrow(run, _FRAGMENTS)


def stitched(found: DataFrame) -> DataFrame:
    """Runs: fragments of one document and period that overlap or touch are one, and a stretch keeps its least period."""
    by = [*KEY, "period"]
    before = Window.partitionBy(*by).orderBy("first", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("first", "stop").rowsBetween(Window.unboundedPreceding, 0)
    marked = found.distinct().withColumn("fresh", F.coalesce(F.col("first") > F.max("stop").over(before), F.lit(True)).cast("int"))
    joined = marked.withColumn("part", F.sum("fresh").over(upto)).groupBy(*by, "part").agg(
        F.min("first").alias("start"), (F.max("stop") - F.min("first") + F.col("period")).alias("length"))
    long_enough = joined.filter(F.col("length") >= F.greatest(F.lit(MIN_LENGTH), 2 * F.col("period")))
    return long_enough.groupBy(*KEY, "start", "length").agg(F.min("period").alias("period"))


def run_lists(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """``runs`` (start, length, period; by start, then period) of every document that has one, by its key."""
    runs = stitched(solved(tiles(rows, tile).repartition(*KEY, "least", "start")))
    return runs.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def with_runs(rows: DataFrame, lists: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with their ``runs``, null where there are none. Up to ``bound`` lists, texts without a run are left where they are."""
    lists = lists.select(*[F.col(c).alias(f"_{c}") for c in KEY], "runs")
    same = lambda right: (F.col("id").eqNullSafe(right["_id"])) & (F.col("k1") == right["_k1"]) & (F.col("k2") == right["_k2"])
    plain = [*rows.columns, "runs"]
    if lists.limit(bound + 1).count() > bound:
        return rows.join(lists, same(lists), "left").select(*plain)
    few = F.broadcast(lists.drop("runs"))
    return rows.join(few, same(few), "left_semi").join(lists, same(lists)).select(*plain).unionByName(
        rows.join(few, same(few), "left_anti").withColumn("runs", F.lit(None).cast(lists.schema["runs"].dataType)))


_COLLAPSED = "id long, runs array<struct<start: int, period: int, length: int>>, collapsed_sha256 string"


def collapsed(rows: DataFrame, texts: bool = False) -> DataFrame:
    """Each row's runs, the digest of the words that stay and, if asked for, those words as ``collapsed_text``."""
    schema = _COLLAPSED + (", collapsed_text string" if texts else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            bodies = []
            at = step["runs"].offsets.to_numpy()
            start, period, length = (step["runs"].values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            for i, (text, h) in enumerate(zip(step["text"].to_pylist(), step["h"].to_pylist(), strict=True)):
                found = word_list(text)
                if h is not None and h % 10 == 0:
                    found = [found[j] for j in damage(len(found), h).tolist()]
                a, b = int(at[i]), int(at[i + 1])
                if b > a:
                    edges = np.zeros(len(found) + 1, np.int64)
                    np.add.at(edges, start[a:b] + period[a:b], 1)
                    np.add.at(edges, start[a:b] + length[a:b], -1)
                    found = list(compress(found, (np.cumsum(edges)[:-1] == 0).tolist()))
                bodies.append(b" ".join(found))
            columns = [step["id"], step["runs"], pa.array([hashlib.sha256(x).hexdigest() for x in bodies], pa.string())]
            names = ["id", "runs", "collapsed_sha256"]
            if texts:
                columns.append(pa.array([x.decode() for x in bodies], pa.string()))
                names.append("collapsed_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("id", "text", "h", "runs").mapInArrow(run, schema)


def described(docs: DataFrame, tile: int = TILE, texts: bool = False) -> DataFrame:
    """``doc_id``, ``runs``, ``collapsed_sha256`` and, if asked for, ``collapsed_text`` of every row."""
    rows = numbered(docs)
    lists = materialise(run_lists(rows, tile), "period-runs")
    out = collapsed(with_runs(rows, lists), texts)
    return out.withColumn("doc_id", F.col("id").cast(docs.schema["doc_id"].dataType)).select("doc_id", *[c for c in out.columns if c != "id"])


@query()
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = described(read(spark, folder, "documents"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    listed = F.array_join(F.transform(F.coalesce("runs", F.array()), lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    period = -F.col("longest.less").cast("long")
    return found.withColumn("longest", longest).select(
        "doc_id", F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"), (-F.col("longest.back")).cast("long").alias("start"),
        F.col("longest.length").cast("long").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("longest.length").cast("long") / period).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), "collapsed_sha256")
