"""Words, byte-level hashing and prefix sums shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words, as a Java and DuckDB character class.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step of a task works on; a longer text is a step of its own.
STEP_BYTES = 2 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each evaluated once per row: a generator is not merged with what uses its columns, nor does a
    filter on them move below it and evaluate them again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def id_share(doc_id: Column, parts: int) -> Column:
    """CRC-32 of the id as text modulo ``parts``; a null id counts as null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def running_totals(df: DataFrame, key: str, order: list[Column], value: str, into: str, bits: int = 10) -> DataFrame:
    """Exclusive running sum of ``value`` per ``key`` by (hash, ``order``), with no key sorted in one task.

    ``order[0]`` must be a hash over all 64 bits: its leading bits cut a key into 2^bits slices, whose sums are added up first.
    """
    slices = df.withColumn("_slice", F.shiftright(order[0], 64 - bits))
    sums = slices.groupBy(key, "_slice").agg(F.sum(value).alias("_sum"))
    before = sums.select(key, "_slice", (F.sum("_sum").over(
        Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (slices.withColumn("_inside", F.sum(value).over(inside) - F.col(value))
            .join(before, [key, "_slice"]).withColumn(into, F.col("_before") + F.col("_inside"))
            .drop("_slice", "_inside", "_before"))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more entry than texts); null is empty."""
    texts = pc.fill_null(texts, "")
    large = pa.concat_arrays([texts.cast(pa.large_binary())])
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset:large.offset + len(large) + 1]
    data = large.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
            steps_ = np.full(size, _PRIME, np.uint64), np.full(size, inverse, np.uint64)
            for s in steps_:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps_)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of words before each text."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = space[:-1]
    if len(raw):
        edge[offsets[:-1][offsets[:-1] < len(raw)]] = True
    inside = ~space
    starts = np.flatnonzero(inside & edge[:-1])
    stop = np.ones(len(raw), bool)
    stop[:-1] = space[1:]
    if len(raw):
        last = offsets[1:] - 1
        stop[last[last >= 0]] = True
    ends = np.flatnonzero(inside & stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes, from prefix sums over the whole buffer."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words, whatever text they belong to."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[k:k + count]
    return mixed(out)


def gram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Positions at which a run of ``n`` words lies within one text; ``first`` is from ``word_spans``."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    return np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
