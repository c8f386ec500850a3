"""IO1, IO2, IO7: table scans and appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Session setting: into how many partitions rows of ``SPREAD_TABLES`` are dealt after the scan; unset, scans stay as they are.
SPREAD = "chatlake.scan.partitions"
#: Tables with long texts, which are slow to work on where a file has one row group and so one task.
SPREAD_TABLES = ("documents", "pages", "conversations")


def scan(spark: SparkSession, folder: str, table: str, where: Column | None = None,
         columns: list[str] | None = None) -> DataFrame:
    """IO1 / IO7: Parquet scan; predicate and column list both reach the reader.

    A table written as one row group is read by one task. Where ``chatlake.scan.partitions`` is set, as the benchmark does, its rows
    are dealt out before they are worked on; a cluster's tables have many row groups and need no such exchange.
    """
    df = spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")
    if where is not None:
        df = df.where(where)
    df = df.select(*columns) if columns else df
    spread = spark.conf.get(SPREAD, None)
    return df.repartition(int(spread)) if spread and table in SPREAD_TABLES else df


def scan_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str, lower: int, upper: int,
              partitions: int, options: dict[str, str] | None = None) -> DataFrame:
    """IO1 on a relational store: a partitioned read, filters pushed into the store's SQL."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=partition_column, lowerBound=str(lower),
                 upperBound=str(upper), numPartitions=str(partitions), **(options or {}))
        .load()
    )


def append_by_day(df: DataFrame, path: str, ts: str = "ts") -> None:
    """IO2: append rows under a day partition, the predicate every dashboard query filters on."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def append_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """IO2: append to a bucketed catalogue table, so later joins on ``key`` need no exchange."""
    df.write.mode("append").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
