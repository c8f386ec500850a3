"""Checked queries of IO2, IO5 and IO6: rows written below the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chatlake.plans.registry import query
from chatlake.session import materialise, scratch_path
from chatlake.sources import adapters as S
from chatlake.sources import sinks, tables

_ROWS = "SELECT event_id AS id, user_id, ts, CAST(floor(value) AS BIGINT) AS token_count, event_type IN ('error', 'purchase') AS important_flag FROM events"
_TYPES = "id BIGINT, user_id BIGINT, ts TIMESTAMP_NTZ, token_count BIGINT, important_flag BOOLEAN"


@query(f"""WITH r AS ({_ROWS}) SELECT r.*, 'activity' AS kind, (SELECT count(*) FROM r) AS total, (SELECT min(ts) FROM r) AS first_ts, (SELECT max(ts) FROM r) AS last_ts FROM r""")
def json_export(spark, sf):
    """IO5: the export's rows beside the header that was written with them."""
    path = scratch_path(spark, "json-export")
    sinks.export_json(S.activity(spark, sf), path, kind="activity")
    rows = spark.read.schema(_TYPES).options(**sinks.TIMES).json(f"{path}/data")
    head = spark.read.schema("kind STRING, total BIGINT, first_ts TIMESTAMP_NTZ, last_ts TIMESTAMP_NTZ").options(**sinks.TIMES).json(f"{path}/manifest")
    return rows.withColumns({c: head.select(c).scalar() for c in head.columns})


@query(f"""WITH r AS ({_ROWS}) SELECT r.*, (SELECT 'conversations_' || strftime(min(ts), '%Y%m%d') || '_' || strftime(max(ts), '%Y%m%d') || '.csv' FROM r) AS file_name FROM r""")
def csv_export(spark, sf):
    """IO6: the rows read back with their header, and the name of the range."""
    rows = S.activity(spark, sf)
    bounds = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(sinks.export_name(F.col("a"), F.col("b")).alias("n"))
    path = f"{scratch_path(spark, 'csv-export')}/{bounds.first()['n'] or 'empty.csv'}"
    sinks.export_csv(rows, path)
    back = spark.read.option("header", "true").options(**sinks.TIMES).schema(_TYPES).csv(path)
    return back.withColumn("file_name", F.element_at(F.split(F.lit(path), "/"), -1))


@query(f"""WITH r AS ({_ROWS}) SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens FROM r WHERE ts >= TIMESTAMP '2024-01-08' GROUP BY 1""")
def day_append(spark, sf):
    """IO2: two appends under day partitions; the filter on the day prunes partitions."""
    path, rows = scratch_path(spark, "day-append"), S.activity(spark, sf)
    tables.append_by_day(rows.where("id % 2 = 0"), path)
    tables.append_by_day(rows.where("id % 2 = 1"), path)
    return spark.read.parquet(path).where(F.col("day") >= F.lit("2024-01-08").cast("date")).groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens"))


@query(f"""WITH r AS ({_ROWS}) SELECT a.user_id, count(*) AS pairs FROM r a JOIN r b ON a.user_id = b.user_id AND b.important_flag WHERE NOT a.important_flag GROUP BY 1""")
def bucketed_append(spark, sf):
    """IO2: two appends to a bucketed table, joined with itself by the bucket's key; the table is dropped at the end."""
    table, rows = f"activity_{uuid.uuid4().hex}", S.activity(spark, sf)
    try:
        tables.append_bucketed(rows.where("id % 2 = 0"), table, "user_id", 8)
        tables.append_bucketed(rows.where("id % 2 = 1"), table, "user_id", 8)
        stored = spark.table(table)
        counts = stored.groupBy("user_id").agg(F.count_if(~F.col("important_flag")).alias("plain"), F.count_if("important_flag").alias("marked"))
        found = counts.where("plain > 0 AND marked > 0").select("user_id", (F.col("plain") * F.col("marked")).alias("pairs"))
        return materialise(found, "bucketed-append")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
