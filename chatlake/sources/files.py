"""IO3: text and Markdown file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _decoded(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    # Bytes that are not UTF-8 become a replacement character, which is then dropped.
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return files.select(
        "path", name.alias("doc_name"), "modificationTime", "length",
        F.sha2(F.concat(F.encode("path", "UTF-8"), F.col("content")), 256).alias("doc_id"),
        text.alias("text"),
        F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("suffix"),
    )


def text_files(spark: SparkSession, folder: str, glob: str = "*.{md,txt}") -> DataFrame:
    """Recursive listing with path, name, content id (path + bytes) and decoded text."""
    return _decoded(
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).load(folder)
    )


def _binary(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)


def listing(spark: SparkSession, folder: str, glob: str = "*.{md,txt}") -> DataFrame:
    """Path, length, time of change and name of every file; no byte is read."""
    return _binary(spark, folder, glob).select("path", "length", "modificationTime", F.element_at(F.split("path", "/"), -1).alias("doc_name"))


def read_listed(spark: SparkSession, folder: str, wanted: DataFrame, glob: str = "*.{md,txt}") -> DataFrame:
    """The decoded text of the listed files. Lengths and times bound which files are opened; the source checks both before it reads."""
    low, high, least, most = wanted.agg(F.min("modificationTime"), F.max("modificationTime"), F.min("length"), F.max("length")).first()
    files = _binary(spark, folder, glob)
    files = files.where(F.lit(False)) if low is None else files.where(
        F.col("modificationTime").between(F.lit(low), F.lit(high)) & F.col("length").between(least, most))
    return _decoded(files).join(wanted.select("path"), "path", "left_semi")


def text_file_stream(spark: SparkSession, folder: str, glob: str = "*.{md,txt}") -> DataFrame:
    """The same listing as a stream of new files; a changed file counts as new under another path."""
    return _decoded(
        spark.readStream.format("binaryFile")
        .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    )
