"""IO8-IO11: incremental maintenance of a chunk index held as a table.

Plans are computed as frames of changes; the index is rewritten by anti join and union into a new version
of the table, because plain Parquet has no MERGE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators.chunking import CHUNK_SIZE, OVERLAP, chunks
from chatlake.session import materialise


def index_documents(index: DataFrame) -> DataFrame:
    """Documents in an index: one row per (doc_id, doc_name, source_path) with its chunk count."""
    return index.groupBy("doc_id", "doc_name", F.col("metadata.source_path").alias("source_path")).agg(
        F.count(F.lit(1)).alias("chunks"))


def classify(files: DataFrame, index: DataFrame, *, force: bool = False) -> DataFrame:
    """IO8: per file the action - index, replace or skip.

    Same name and same id is skipped, same name with another id is replaced, a known id under a new name is
    skipped. Of several files sharing a name the last by path decides what the index holds, as each replaces
    the one before.
    """
    known = index.select("doc_id", "doc_name").distinct()
    by_name = known.groupBy("doc_name").agg(F.lit(True).alias("__name_known"))
    same = known.withColumn("__same", F.lit(True))
    ids = known.select("doc_id").distinct().withColumn("__id_known", F.lit(True))
    rows = files.join(by_name, "doc_name", "left").join(same, ["doc_id", "doc_name"], "left").join(ids, "doc_id", "left")
    action = (
        F.when(F.col("__name_known") & F.col("__same") & F.lit(not force), "skip")
        .when(F.col("__name_known"), "replace").when(F.col("__id_known") & F.lit(not force), "skip")
        .otherwise("index")
    )
    return rows.withColumn("action", action).drop("__name_known", "__same", "__id_known")


def stale(index: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """IO9 / J5: names of indexed documents below ``folder`` whose file is gone."""
    prefix = folder.rstrip("/") + "/"
    inside = index_documents(index).where(
        (F.coalesce("source_path", F.lit("")) != "") & (F.coalesce("doc_name", F.lit("")) != "")
        & F.col("source_path").startswith(prefix))
    return inside.join(files.select(F.col("path").alias("source_path")), "source_path", "left_anti").select("doc_name").distinct()


def refresh(index: DataFrame, files: DataFrame, folder: str, *, force: bool = False, size: int = CHUNK_SIZE,
            overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """IO8-IO10: (new index, one row per outcome with its number of documents).

    ``files`` comes from `sources.files.text_files`, ``index`` rows are those of `chunking.chunks`.
    """
    current = index.limit(0) if force else index.join(stale(index, files, folder), "doc_name", "left_anti")
    planned = classify(files, current, force=force)
    latest = planned.where("action <> 'skip'").groupBy("doc_name").agg(F.max_by(F.struct("doc_id", "path", "text", "suffix"), "path").alias("f"))
    todo = latest.select("doc_name", "f.doc_id", F.col("f.path").alias("source_path"), "f.text", "f.suffix")
    # Chunking is the costly step and both results read it, so it is written once.
    fresh = materialise(chunks(todo, size=size, overlap=overlap), "fresh-chunks")
    replaced = planned.where("action = 'replace'").select("doc_name").distinct()
    result = current.join(replaced, "doc_name", "left_anti").unionByName(fresh)
    filled = fresh.select("doc_id", "doc_name").distinct().withColumn("__filled", F.lit(True))
    outcome = planned.join(filled, ["doc_id", "doc_name"], "left").select(
        F.when(F.col("action") == "skip", "skipped").when(F.col("__filled").isNull(), "empty").otherwise("indexed").alias("status"))
    purged = index_documents(index).join(stale(index, files, folder), "doc_name", "left_semi")
    gone = purged.select(F.lit("purged").alias("status"))
    report = outcome if force else outcome.unionByName(gone)
    return result, report.groupBy("status").agg(F.count(F.lit(1)).alias("documents"))


def delete_rows(table: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """IO11: (the table without rows of the given keys, how many rows left)."""
    wanted = keys.select(column).distinct()
    removed = table.join(wanted, column, "left_semi").agg(F.count(F.lit(1)).alias("removed"))
    return table.join(wanted, column, "left_anti"), removed


def write_version(index: DataFrame, path: str, version: str, buckets: int | None = None) -> str:
    """Write an index as a new version folder; readers switch by name, so a failed write leaves the old one intact."""
    target = f"{path.rstrip('/')}/{version}"
    rows = index.repartition(buckets, "doc_id", "chunk_index") if buckets else index
    rows.write.mode("errorifexists").parquet(target)
    return target
