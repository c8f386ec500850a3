"""Many small (key, owner, place) entries dealt to buckets as a few compact rows, instead of a row for each entry.

Entries of about two million words are collected in a task, sorted by bucket, and written as one row per bucket. A bucket's
number is the leading part of the key, so equal keys meet. Within a row only the rest of the key is stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Entries collected before rows are written; bounds a task's memory.
FLUSH = 1 << 21
PER_PARTITION = 4
SCHEMA = "bucket int, keys binary, owners binary, places binary, n int"
NAMES = ["bucket", "keys", "owners", "places", "n"]


def bucket_count(spark: SparkSession) -> int:
    """A few buckets for each shuffle partition, of which the cluster has as many as its input needs."""
    return PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _squeezed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _widened(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def packed(keys: np.ndarray, stored: np.ndarray, owners: np.ndarray, places: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows for entries; ``stored`` is what is kept of each key (unsigned), owners are int64, places uint32."""
    bucket = buckets_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, stored, owners, places = bucket[order], stored[order], owners[order], places[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(bucket))[:len(cuts)]
    rows: list[list] = [[], [], [], [], []]
    for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
        deltas = np.diff(owners[a:b], prepend=np.int64(0))
        for column, value in zip(rows, (int(bucket[a]), stored[a:b].tobytes(), _squeezed(deltas), _squeezed(places[a:b]), b - a), strict=True):
            column.append(value)
    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], NAMES)


def unpacked(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stored keys, owners and places of all rows."""
    keys, owners, places = [], [], []
    for k, o, p, n in zip(*(table[c].to_pylist() for c in NAMES[1:]), strict=True):
        keys.append(np.frombuffer(k, kind))
        owners.append(np.cumsum(_widened(o, np.int64, n)))
        places.append(_widened(p, np.uint32, n))
    return (np.concatenate(keys or [np.zeros(0, kind)]), np.concatenate(owners or [np.zeros(0, np.int64)]),
            np.concatenate(places or [np.zeros(0, np.uint32)]))


def by_owner(owners: np.ndarray, places: np.ndarray, names: tuple[str, str]) -> pa.RecordBatch:
    """One row per owner with its places as little-endian 32-bit numbers, ascending."""
    order = np.lexsort((places, owners))
    owners, places = owners[order], places[order].astype("<u4")
    cuts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1])) if len(owners) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(owners))[:len(cuts)]
    lists = [places[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(owners[cuts]), pa.array(lists, pa.binary())], list(names))
