"""ST1-ST9: the live forms of scoring, counting, sessions, throttling and ingestion.

State is keyed finely and bounded by watermarks; sinks are append-only files or ``foreachBatch`` functions that are
safe to repeat: a batch writes folders named by its number, and what it continues is read from the folder of the batch before. Checkpoints live
below the folder the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chatlake.functions.lexicon import Lexicon
from chatlake.operators.monitoring import throttle
from chatlake.operators.risk import high_risk_alerts, score_exchanges
from chatlake.operators.segments import time_segment
from chatlake.operators.usage import with_cost
from chatlake.session import exists, is_folder, remove, scratch_path


def read_files(spark: SparkSession, folder: str, glob: str, schema: StructType | str, per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream. A table of the given name may be one file or a folder of part files."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(per_trigger))
    table = f"{folder.rstrip('/')}/{glob}"
    return reader.parquet(table) if is_folder(spark, table) else reader.option("pathGlobFilter", glob).parquet(folder)


def run_available(frame: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """ST9: process what has arrived, then stop; returns the written rows."""
    spark = frame.sparkSession
    base = scratch_path(spark, purpose)
    query = (
        frame.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{base}/rows")


#: Batches after which an upsert table is written anew as one.
COMPACT_EVERY = 16


def upsert(path: str, keys: list[str], compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """Sink of update mode: a batch's rows replace those of earlier batches with the same keys.

    Each batch is a folder of its own, so a repeated batch replaces itself. Every ``compact_every`` batches the newest rows of
    all keys are written as one folder, and the folders before the compaction before that are deleted.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            whole = _newest(spark, path, batch.schema, keys, batch_id, compact_every)
            whole.write.mode("overwrite").parquet(f"{path}/whole/batch={batch_id}")
            for old in range(max(0, batch_id - 2 * compact_every + 1), batch_id - compact_every + 1):
                remove(spark, f"{path}/rows/batch={old}")
            remove(spark, f"{path}/whole/batch={batch_id - 2 * compact_every}")

    return handle


def _newest(spark: SparkSession, path: str, schema: StructType, keys: list[str], upto: int, compact_every: int) -> DataFrame:
    last = (upto // compact_every) * compact_every - 1  # the newest compaction that lies before this batch
    if last >= 0 and not exists(spark, f"{path}/whole/batch={last}"):
        last = -1
    parts = ([f"{path}/whole/batch={last}"] if last >= 0 else []) + [
        f"{path}/rows/batch={i}" for i in range(last + 1, upto + 1) if exists(spark, f"{path}/rows/batch={i}")]
    number = F.regexp_extract(F.input_file_name(), r"/batch=(\d+)/", 1).cast("bigint")
    rows = spark.read.schema(schema).parquet(*parts).withColumn("__batch", number) if parts else None
    if rows is None:
        return spark.createDataFrame([], schema)
    values = [c for c in schema.names if c not in keys]
    # One row of state per key moves, whatever the number of batches: the newest is found map-side.
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "__batch").alias("__v")) if values else rows.select(*keys).distinct()
    return found.select(*keys, "__v.*").select(*schema.names) if values else found


def upserted(spark: SparkSession, path: str, schema: StructType, keys: list[str], upto: int, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """The table that `upsert` keeps, as of batch ``upto``."""
    return _newest(spark, path, schema, keys, upto, compact_every)


def run_upsert(frame: DataFrame, purpose: str, keys: list[str]) -> DataFrame:
    """Process what has arrived in update mode and return the newest row of each key. Groups that the watermark has passed leave the
    state; their rows stay in the table."""
    path = scratch_path(frame.sparkSession, f"{purpose}-table")
    last = [-1]
    sink = upsert(path, keys)

    def handle(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        last[0] = batch_id

    run_batches(frame, purpose, handle, "update")
    return upserted(frame.sparkSession, path, frame.schema, keys, last[0])


def run_batches(frame: DataFrame, purpose: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what has arrived through ``handle(batch, batch_id)``."""
    query = (
        frame.writeStream.outputMode(mode).foreachBatch(handle).trigger(availableNow=True)
        .option("checkpointLocation", f"{scratch_path(frame.sparkSession, purpose)}/checkpoint").start()
    )
    query.awaitTermination()


def scored_messages(exchanges: DataFrame, lexicon: Lexicon) -> DataFrame:
    """ST1: R8e on arrival; stateless."""
    return score_exchanges(exchanges, lexicon)


def write_scored(log_path: str, alert_path: str) -> Callable[[DataFrame, int], None]:
    """ST1 sink: the log and the alerts of a batch under its own folder, so a repeated batch replaces itself.

    The batch is scored once, for the log; the alerts are read from what was logged.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        log = f"{log_path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(log)
        logged = batch.sparkSession.read.schema(batch.schema).parquet(log)
        high_risk_alerts(logged).write.mode("overwrite").parquet(f"{alert_path}/batch={batch_id}")

    return handle


def daily_counts(usage: DataFrame, *, delay: str = "1 hour", per_user: bool = False, prices=None) -> DataFrame:
    """ST2: usage per day (and user); rows later than the watermark are dropped."""
    keys = ["user_id"] if per_user else []
    window = F.window("ts", "1 day")
    return (
        with_cost(usage, prices).withWatermark("ts", delay).groupBy(window, *keys)
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"),
             F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))
        .select(F.to_date("window.start").alias("day"), *keys, "requests", "input_tokens", "output_tokens", "cost")
    )


def session_batches(path: str, gap: dt.timedelta, delay: dt.timedelta = dt.timedelta(hours=1)) -> Callable[[DataFrame, int], None]:
    """ST3 sink: sessions closed by inactivity; differs from W9 only for a gap of exactly the limit.

    A batch's rows become sessions of their own and are joined with the sessions left open by the batch before. Sessions that ended longer
    than the gap before the watermark (the newest time minus ``delay``) are closed and never read again; rows older than the
    watermark are dropped. Only sessions meet by user, not activity.
    """
    span, late = (f"INTERVAL {int(x.total_seconds() * 1e6)} MICROSECOND" for x in (gap, delay))
    seconds = f"{gap.total_seconds()} seconds"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/sessions/batch={batch_id - 1}"
        clock = spark.read.parquet(f"{path}/clock/batch={batch_id - 1}").first()["high"] if batch_id and exists(spark, f"{path}/clock/batch={batch_id - 1}") else None
        rows = batch.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
        high = rows.agg(F.max("ts")).first()[0]
        if clock is not None:
            rows = rows.where(F.col("ts") >= F.lit(clock) - F.expr(late))
            high = max(high, clock) if high is not None else clock
        fresh = rows.groupBy("user_id", F.session_window("ts", seconds).alias("w")).agg(
            F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("messages")).drop("w")
        if clock is not None and exists(spark, f"{before}/closed=false"):
            fresh = fresh.unionByName(spark.read.schema(fresh.schema).parquet(f"{before}/closed=false"))
        order = Window.partitionBy("user_id").orderBy("first", "last")
        reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
        starts = fresh.withColumn("__new", F.coalesce(F.col("first") >= reached + F.expr(span), F.lit(True)).cast("int"))
        merged = starts.withColumn("__no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "__no").agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.sum("messages").alias("messages")).drop("__no")
        closed = F.col("last") + F.expr(span) <= F.lit(high) - F.expr(late) if high is not None else F.lit(False)
        merged.withColumn("closed", closed).write.mode("overwrite").partitionBy("closed").parquet(f"{path}/sessions/batch={batch_id}")
        spark.createDataFrame([(high,)], "high timestamp").write.mode("overwrite").parquet(f"{path}/clock/batch={batch_id}")
        # A repeated batch still needs the open sessions of the one before it.
        remove(spark, f"{path}/sessions/batch={batch_id - 2}/closed=false")

    return handle


def sessions_of(spark: SparkSession, path: str, gap: dt.timedelta) -> DataFrame:
    """Closed sessions of all batches and the open ones of the newest: user_id, session_start, session_end, messages, closed."""
    rows = spark.read.parquet(f"{path}/sessions").withColumn("closed", F.col("closed").cast("boolean"))
    newest = rows.agg(F.max("batch").alias("b")).select("b").scalar()
    kept = rows.where(F.col("closed") | (F.col("batch") == newest))
    end = F.col("last") + F.expr(f"INTERVAL {int(gap.total_seconds() * 1e6)} MICROSECOND")
    return kept.select("user_id", F.col("first").alias("session_start"), end.alias("session_end"), "messages", "closed")


def throttle_batches(path: str, cooldown: dt.timedelta, delay: dt.timedelta = dt.timedelta(minutes=10)) -> Callable[[DataFrame, int], None]:
    """ST4 sink: W8 continued from batch to batch; (category, ts, alert_id) rows in, kept ones out.

    The state is one instant per category, that of its last kept alert. Alerts within a cooldown of it, or older, are held back; the others of a
    batch go through `monitoring.throttle`, so no category is one task's. An instant leaves the state once the newest alert of any
    category is more than a cooldown and ``delay`` past it.
    """
    gap, late = (int(x.total_seconds() * 1_000_000) for x in (cooldown, delay))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
        before = f"{path}/state/batch={batch_id - 1}"
        known = exists(spark, before)
        if known:
            last = spark.read.parquet(before).withColumnsRenamed({"category": "__c", "last": "__last"})
            rows = rows.join(last, F.col("category").eqNullSafe(F.col("__c")), "left").where(
                F.col("__last").isNull() | (F.col("us") >= F.col("__last") + gap)).drop("__c", "__last")
        throttle(rows, "category", cooldown, order="alert_id").write.mode("overwrite").parquet(f"{path}/kept/batch={batch_id}")
        kept = spark.read.parquet(f"{path}/kept/batch={batch_id}").select("category", F.col("us").alias("last"))
        state = kept.unionByName(spark.read.parquet(before)) if known else kept
        newest = state.groupBy("category").agg(F.max("last").alias("last"))
        limit = state.agg(F.max("last")).first()[0]
        newest.where(F.col("last") + gap + late >= F.lit(limit)).write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")

    return handle


def rate_breaches(requests: DataFrame, key: str, limit: int, *, window: str = "1 hour", slide: str | None = None,
                  delay: str = "10 minutes") -> DataFrame:
    """ST5: clients past the limit per fixed (or sliding) window."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        requests.withWatermark("ts", delay).groupBy(key, span.alias("w")).agg(F.count(F.lit(1)).alias("requests"))
        .where(F.col("requests") > limit).select(key, F.col("w.start").alias("window_start"), "requests")
    )


def cost_levels(usage: DataFrame, threshold: float, *, before: DataFrame | None = None, prices=None) -> tuple[DataFrame, DataFrame]:
    """W6 continued: (one row per new multiple, (user_id, day, total, top) after all rows), from where ``before`` of the same form ends.

    ``total`` is the running cost per (user, day) in ten-billionths and ``top`` its highest value so far. Windows hold one hour of a user; hours
    meet by their summaries only.
    """
    unit = 10_000_000_000
    step_size = int(round(threshold * unit))
    level = lambda c: F.when(c > step_size, F.floor(c / F.lit(step_size))).otherwise(F.lit(0)).cast("bigint")
    keys = ["user_id", "day"]
    rows = with_cost(usage, prices).select(
        F.col("user_id").cast("string").alias("user_id"), F.to_date("ts").alias("day"), time_segment().alias("hour"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", F.coalesce((F.col("cost") * unit).cast("bigint"), F.lit(0)).alias("units"))
    inside = Window.partitionBy(*keys, "hour").orderBy("us", "event_id")
    local = rows.withColumn("sum", F.sum("units").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    hours = local.groupBy(*keys, "hour").agg(F.sum("units").alias("units"), F.max("sum").alias("most"))
    if before is not None:
        # What a key brings along comes before its first hour: a sum, and how far above it the sum once was.
        known = before.select(*keys, F.lit(0).alias("late"), F.lit(None).cast("timestamp").alias("hour"), F.col("total").alias("units"), F.col("top").alias("most"))
        hours = hours.withColumn("late", F.lit(1)).select(*known.columns).unionByName(known)
    else:
        hours = hours.withColumn("late", F.lit(1))
    in_order = Window.partitionBy(*keys).orderBy("late", "hour")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumn("offset", F.coalesce(F.sum("units").over(earlier), F.lit(0)))
    hours = hours.withColumn("reached", F.greatest(F.lit(0), F.max(F.col("offset") + F.col("most")).over(earlier)))
    start = hours.where("late = 1").select(*[F.col(c).alias(f"__{c}") for c in (*keys, "hour")], "offset", "reached")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, "hour")]
    # Both windows run over the hour's own sums, in the partitioning of the first.
    local = local.withColumn("most", F.max("sum").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    placed = local.join(start, same[0] & same[1] & same[2])
    now, highest = level(F.col("offset") + F.col("sum")), level(F.greatest("reached", F.col("offset") + F.col("most")))
    risen = placed.withColumn("level", now).where(F.col("level") > highest).select(*keys, "event_id", "level")
    after = hours.groupBy(*keys).agg(F.sum("units").alias("total"), F.greatest(F.lit(0), F.max(F.col("offset") + F.col("most"))).alias("top"))
    return risen, after


def cost_level_batches(path: str, threshold: float, *, delay: dt.timedelta = dt.timedelta(hours=1), prices=None) -> Callable[[DataFrame, int], None]:
    """ST7 sink: W6 continued from batch to batch; one row per new multiple of the running cost per (user, day).

    The state is one row per (user, day), until the watermark (the newest time minus ``delay``) has passed the day; rows that are not newer
    than the watermark of the batch before are dropped.
    """
    late = F.expr(f"INTERVAL {int(delay.total_seconds() * 1e6)} MICROSECOND")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state, last = f"{path}/state/batch={batch_id}", f"{path}/state/batch={batch_id - 1}"
        known, clock = exists(spark, last), None
        rows = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        high = rows.agg(F.max("ts")).first()[0]
        if known:
            clock = spark.read.parquet(f"{path}/clock/batch={batch_id - 1}").first()["high"]
        if clock is not None:
            rows = rows.where(F.col("ts").isNull() | (F.col("ts") > F.lit(clock) - late))
            high = max(high, clock) if high is not None else clock
        risen, after = cost_levels(rows, threshold, before=spark.read.parquet(last) if known else None, prices=prices)
        risen.write.mode("overwrite").parquet(f"{path}/levels/batch={batch_id}")
        if high is not None:
            over = F.date_add("day", 1).cast("timestamp") <= F.lit(high) - late
            after = after.where(F.col("day").isNull() | ~over)
        after.write.mode("overwrite").parquet(state)
        spark.createDataFrame([(high,)], "high timestamp").write.mode("overwrite").parquet(f"{path}/clock/batch={batch_id}")
        # A repeated batch still needs the state of the one before it.
        remove(spark, f"{path}/state/batch={batch_id - 2}")

    return handle


def without_replays(exchanges: DataFrame, key: str = "id", *, delay: str = "1 day") -> DataFrame:
    """ST8: an exchange delivered again within the delay is dropped."""
    return exchanges.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def ingest_batches(index_path: str, folder: str, *, size: int, overlap: int) -> Callable[[DataFrame, int], None]:
    """ST6 sink: each batch of files yields the next version of the index (replace by name).

    The version of a batch is built from the one before it, so a repeated batch rebuilds the same folder.
    Deleted files are purged by the batch form, `ingest.refresh`, which sees the whole listing.
    """
    from chatlake.operators.chunking import chunks
    from chatlake.operators.ingest import classify

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{index_path}/version={batch_id - 1}"
        latest = batch.groupBy("doc_name").agg(F.max_by(F.struct("doc_id", "path", "text", "suffix"), "path").alias("f")).select(
            "doc_name", "f.doc_id", F.col("f.path").alias("source_path"), "f.text", "f.suffix")
        if batch_id == 0:
            result = chunks(latest, size=size, overlap=overlap)
        else:
            index = spark.read.parquet(before)
            todo = classify(latest, index).where("action <> 'skip'").drop("action")
            result = index.join(todo.select("doc_name").distinct(), "doc_name", "left_anti").unionByName(
                chunks(todo, size=size, overlap=overlap))
        result.write.mode("overwrite").parquet(f"{index_path}/version={batch_id}")

    return handle
