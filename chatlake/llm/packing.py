"""Packing of documents into sequences of a fixed number of tokens, by best fit and a local search.

A document's tokens are its ids and one closing id 0. Only a longer one than a sequence is cut, into full pieces behind a first
piece with the rest. Pieces are dealt by a hash of their document and row into shards of about ``SHARD`` pieces; a shard is packed in one task:
best fit in falling order of length, then a search that moves one document, swaps one for one, or two for one, between underfull
sequences whenever that makes the sum of squared fills larger. All underfull sequences are candidates, found by their gap and the
lengths in them; the search ends when the tokens need as many sequences as there are, or no such move is left.

Null texts are empty and have the closing id alone. Repeated rows are packed one by one. Which sequence a piece is in depends on the
order of the stored rows. An empty table gives no rows. Columns other
than ``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import read, steps
from chatlake.llm.encoding import STEP, encoder
from chatlake.llm.registry import query
from chatlake.session import materialise

LENGTH = 2048
SHARD = 16_384
_END = bytes(4)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """The pieces of every document with the checksum of their ids."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for step in steps(batches, limit=STEP):
            ids, first = own.ids(step["text"])
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            rows: list[list] = [[], [], [], [], []]
            for doc_id, at, stop in zip(step["doc_id"].to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                size, start, number = stop - at + 1, 0, 0
                while start < size:
                    part = (size - start) % length or length
                    crc = zlib.crc32(data[4 * (at + start):4 * min(at + start + part, stop)])
                    if start + part == size:
                        crc = zlib.crc32(_END, crc)
                    for column, value in zip(rows, (doc_id, number, start, part, crc), strict=True):
                        column.append(value)
                    start, number = start + part, number + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, room: int = LENGTH) -> list[list[int]]:
    """Bins of item numbers: each item, in falling order, goes to the fullest bin that has room for it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(room + 1)]
    gaps = 0  # bit g is set where a bin has a gap of g
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fits = gaps >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
        else:
            gap, b = room, len(bins)
            bins.append([])
        bins[b].append(item)
        by_gap[gap - size].append(b)
        gaps |= 1 << gap - size
    return bins


class Index:
    """Sets of sizes, one for each bin, by the bin's fill: finds a bin in a range of fills whose set meets another, looking at all.

    Sets are bits of integers; a tree over fills holds the union of each range.
    """

    def __init__(self, room: int) -> None:
        self.width = 1 << room.bit_length()
        self.union = [0] * (2 * self.width)
        self.at: list[dict[int, int]] = [{} for _ in range(self.width)]

    def put(self, fill: int, b: int, sizes: int) -> None:
        self.at[fill][b] = sizes
        node = self.width + fill
        while node and self.union[node] | sizes != self.union[node]:
            self.union[node] |= sizes
            node >>= 1

    def drop(self, fill: int, b: int) -> None:
        del self.at[fill][b]
        node, left = self.width + fill, 0
        for sizes in self.at[fill].values():
            left |= sizes
        while node and self.union[node] != left:
            self.union[node] = left
            node >>= 1
            left = self.union[2 * node] | self.union[2 * node + 1]

    def find(self, sizes: int, low: int, high: int, but: int, fullest: bool) -> int | None:
        """The fullest (or emptiest) bin but ``but`` whose set has one of ``sizes``."""
        waiting = [(1, 0, self.width - 1)]
        while waiting:
            node, first, last = waiting.pop()
            if last < low or first > high or not self.union[node] & sizes:
                continue
            if first == last:
                found = next((b for b, own in self.at[first].items() if own & sizes and b != but), None)
                if found is not None:
                    return found
                continue
            middle = (first + last) // 2
            halves = [(2 * node, first, middle), (2 * node + 1, middle + 1, last)]
            waiting += halves if fullest else halves[::-1]
        return None


class Search:
    """Local search over the underfull bins. A bin gives one or two items to a bin at least as full, which may hand back a smaller one.

    Each open bin has the set of sizes it can give and the set it can take. When no bin that changed can give or take, no move is left.
    """

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], room: int) -> None:
        self.lengths, self.bins, self.room = lengths.tolist(), bins, room
        self.fill = [sum(self.lengths[i] for i in b) for b in bins]
        self.giving, self.taking = Index(room), Index(room)
        self.gives, self.takes = [0] * len(bins), [0] * len(bins)
        self.givers = [(f, b) for b, f in enumerate(self.fill) if 0 < f < room]
        self.takers: dict[int, None] = {}
        heapq.heapify(self.givers)
        for _, b in self.givers:
            self.enter(b)

    def enter(self, b: int) -> None:
        gap, one, two, takes = self.room - self.fill[b], 0, 0, 0
        span = (1 << gap) - 1 << 1
        for size in map(self.lengths.__getitem__, self.bins[b]):
            two |= one << size
            one |= 1 << size
            takes |= span << size
        self.gives[b] = (one | two) & (1 << self.room + 1) - 1
        self.takes[b] = takes | span
        self.giving.put(self.fill[b], b, self.gives[b])
        self.taking.put(self.fill[b], b, self.takes[b])

    def leave(self, b: int) -> None:
        self.giving.drop(self.fill[b], b)
        self.taking.drop(self.fill[b], b)

    def move(self, source: int, target: int) -> None:
        """The move between two bins that shifts most."""
        gap, best = self.room - self.fill[target], (0, 0, -1)
        for back in (-1, *self.bins[target]):
            less = self.lengths[back] if back >= 0 else 0
            fitting = self.gives[source] & ((1 << gap) - 1 << less + 1)
            if fitting and fitting.bit_length() - 1 - less > best[0]:
                best = (fitting.bit_length() - 1 - less, fitting.bit_length() - 1, back)
        shifted, size, back = best
        self.leave(source)
        self.leave(target)
        seen: dict[int, int] = {}
        given = [x for x in self.bins[source] if self.lengths[x] == size][:1]
        for x in () if given else self.bins[source]:
            if (other := seen.get(size - self.lengths[x])) is not None:
                given = [x, other]
                break
            seen[self.lengths[x]] = x
        for x in given:
            self.bins[source].remove(x)
            self.bins[target].append(x)
        if back >= 0:
            self.bins[target].remove(back)
            self.bins[source].append(back)
        self.fill[source] -= shifted
        self.fill[target] += shifted
        for b in (source, target):
            self.takers.pop(b, None)
            if 0 < self.fill[b] < self.room:
                self.enter(b)
                self.takers[b] = None
                heapq.heappush(self.givers, (self.fill[b], b))

    def improve(self) -> int | None:
        """One move that makes the squared fills larger, of the emptiest bin that can give; the bin that gave, None if no move is left."""
        while self.givers:
            fill, b = self.givers[0]
            if fill == self.fill[b]:
                target = self.taking.find(self.gives[b], fill, self.room, b, True)
                if target is not None:
                    self.move(b, target)
                    return b
            heapq.heappop(self.givers)
        while self.takers:
            b = next(iter(self.takers))
            source = self.giving.find(self.takes[b], 0, self.fill[b], b, False)
            if source is not None:
                self.move(source, b)
                return source
            del self.takers[b]
        return None

    def run(self) -> list[list[int]]:
        least = -(-sum(self.lengths) // self.room)
        used = sum(1 for f in self.fill if f)
        while used > least and (source := self.improve()) is not None:
            used -= self.fill[source] == 0
        return [b for b in self.bins if b]


def packed(rows: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """``sequence_id`` and ``offset`` for stored rows with ``doc_id``, ``piece`` and ``length``; other columns are kept."""
    shards = max(1, -(-rows.count() // shard))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], kind="stable", na_position="first").reset_index(drop=True)
        lengths = frame["length"].to_numpy(np.int64)
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        base = int(frame["_shard"].iloc[0]) << 32
        for number, items in enumerate(Search(lengths, best_fit(lengths, length), length).run()):
            at = 0
            for item in items:
                sequence[item], offset[item] = base + number, at
                at += int(lengths[item])
        return frame.drop(columns="_shard").assign(sequence_id=sequence, offset=offset)

    # The row's own number spreads rows of no id or a repeated one; stored rows keep theirs when a task runs again.
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.groupBy("_shard").applyInPandas(place, f"{fields}, sequence_id long, offset long")


def sequences(docs: DataFrame, path: str, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """All pieces of all documents with their places."""
    return packed(materialise(pieces(docs, path, length), "pack-pieces"), length, shard)


@query()
def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return sequences(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
