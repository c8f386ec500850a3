"""IO8-IO10, ST6: a chunk index kept in buckets of document names, of which a refresh rewrites only those that changed.

Below the index's path lie ``chunks/version=n/bucket=b`` (chunk rows), ``files/version=n`` (path, length, time of change and name of every
indexed file) and ``buckets/version=n``, written last, which says for each bucket the version that holds it. A reader
takes the newest of these, so a refresh that fails leaves the index as it was. Files are compared by path, length and time before
any byte is read; what two older versions alone refer to is deleted.

Of several files of one name the last by path decides what is indexed, as in `ingest.classify`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.operators.chunking import CHUNK_SIZE, OVERLAP, chunks
from chatlake.session import discard, exists, materialise, remove
from chatlake.sources.files import listing, read_listed

#: Buckets of one index; a number of the index, set when it is first written.
BUCKETS = 32
_FILES = "path STRING, length BIGINT, modificationTime TIMESTAMP, doc_name STRING"


def bucket_of(name: Column) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


def version(spark: SparkSession, path: str) -> int:
    """The newest complete version, -1 if there is none."""
    if not exists(spark, f"{path}/buckets"):
        return -1
    # One row of at most BUCKETS for each of the last versions.
    found = spark.read.parquet(f"{path}/buckets").agg(F.max("version")).first()[0]
    return -1 if found is None else int(found)


def _holders(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """Bucket -> version that holds it; at most ``BUCKETS`` rows."""
    if number < 0:
        return {}
    rows = spark.read.schema("bucket INT, held_in INT").parquet(f"{path}/buckets/version={number}").collect()
    return {r["bucket"]: r["held_in"] for r in rows if r["bucket"] is not None}


def read_index(spark: SparkSession, path: str, buckets: set[int] | None = None) -> DataFrame | None:
    """The chunk rows of the newest version, or of some of its buckets; None where there are none."""
    held = _holders(spark, path, version(spark, path))
    paths = [f"{path}/chunks/version={v}/bucket={b}" for b, v in sorted(held.items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def refresh(spark: SparkSession, path: str, folder: str, *, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> dict[str, int]:
    """Bring the index up to the files below ``folder``; returns how many names were indexed, purged and left alone.

    Names of new, changed and vanished files are looked at again; if there are none, no file is opened and nothing is written.
    """
    number = version(spark, path)
    now = materialise(listing(spark, folder), "refresh-listing")
    known = spark.read.schema(_FILES).parquet(f"{path}/files/version={number}") if number >= 0 else spark.createDataFrame([], _FILES)
    same = ["path", "length", "modificationTime"]
    touched = now.join(known.select(*same), same, "left_anti").select("doc_name").unionByName(
        known.join(now.select("path"), "path", "left_anti").select("doc_name")).distinct()
    touched = materialise(touched, "refresh-names")
    names = now.select("doc_name").distinct()
    left = names.join(touched, "doc_name", "left_anti").count()
    if not touched.limit(1).count():
        discard(now, touched)
        return {"indexed": 0, "purged": 0, "skipped": left}
    last = now.join(touched, "doc_name", "left_semi").groupBy("doc_name").agg(F.max("path").alias("path"))
    wanted = materialise(now.join(last.select("path"), "path", "left_semi"), "refresh-files")
    files = read_listed(spark, folder, wanted).withColumnRenamed("path", "source_path")
    fresh = materialise(chunks(files, size=size, overlap=overlap).withColumn("bucket", bucket_of(F.col("doc_name"))), "refresh-chunks")
    # At most BUCKETS numbers.
    again = {r["b"] for r in touched.select(bucket_of(F.col("doc_name")).alias("b")).distinct().collect()}
    old = read_index(spark, path, again)
    rows = fresh
    if old is not None:
        kept = old.join(touched, "doc_name", "left_anti").withColumn("bucket", bucket_of(F.col("doc_name")))
        rows = kept.unionByName(fresh)
    number += 1
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/chunks/version={number}")
    now.select("path", "length", "modificationTime", "doc_name").write.mode("overwrite").parquet(f"{path}/files/version={number}")
    filled = {b for b in again if exists(spark, f"{path}/chunks/version={number}/bucket={b}")}
    held = {b: v for b, v in _holders(spark, path, number - 1).items() if b not in again} | dict.fromkeys(filled, number)
    spark.createDataFrame(sorted(held.items()) or [(None, None)], "bucket INT, held_in INT").coalesce(1).write.mode("overwrite").parquet(f"{path}/buckets/version={number}")
    _clean(spark, path, number)
    counts = {"indexed": fresh.select("doc_name").distinct().count(), "purged": touched.join(names, "doc_name", "left_anti").count(), "skipped": left}
    discard(now, touched, wanted, fresh)
    return counts


def _clean(spark: SparkSession, path: str, number: int) -> None:
    """Delete versions that neither this one nor the one before it refers to."""
    used = set(_holders(spark, path, number).values()) | set(_holders(spark, path, number - 1).values()) | {number, number - 1}
    for old in range(max(0, number - 2), -1, -1):
        if not exists(spark, f"{path}/files/version={old}") and old not in used and not exists(spark, f"{path}/chunks/version={old}"):
            break
        for name in ("files", "buckets"):
            if old < number - 1:
                remove(spark, f"{path}/{name}/version={old}")
        if old not in used:
            remove(spark, f"{path}/chunks/version={old}")
