"""Streams over several batches with late rows, a restart and repeated batches."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from chatlake.plans.stream_queries import stream_scored_log
from chatlake.schemas import MESSAGES
from chatlake.streaming import jobs as J

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "event_id bigint, user_id bigint, ts timestamp, model string, input_tokens bigint, output_tokens bigint"


def at(hours):
    return START + dt.timedelta(hours=hours)


def put(spark, folder, name, rows):
    spark.createDataFrame([(i, u, at(h), "m", 1, 1) for i, u, h in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def feed(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)


def run(frame, handle, check, mode):
    q = frame.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()


BATCHES = ([(1, 1, 0), (2, 1, 1), (3, 2, 2)], [(4, 1, 30), (5, 2, 50), (6, 1, 2)], [(7, 1, 3), (8, 2, 51), (9, 3, 100)])


def test_daily_usage_is_upserted(spark, tmp_path):
    """Event 6 comes late but within the delay of its batch; event 7 comes after its day has left the state."""
    folder, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    frame = lambda: J.daily_counts(feed(spark, folder), per_user=True).select("day", "user_id", "requests")
    sink, last = J.upsert(table, ["day", "user_id"], compact_every=2), [0]

    def handle(batch, number):
        sink(batch, number)
        sink(batch, number)  # a batch may be delivered again
        last[0] = number

    schema = "day date, user_id bigint, requests bigint"
    for n, rows in enumerate(BATCHES):
        put(spark, folder, f"b{n}", rows)
        run(frame(), handle, check, "update")
    run(frame(), handle, check, "update")  # a restart without new files

    from pyspark.sql.types import StructType
    got = {(r.day.day, r.user_id): r.requests for r in J.upserted(spark, table, StructType.fromDDL(schema), ["day", "user_id"], last[0], 2).collect()}
    assert got == {(1, 1): 3, (1, 2): 1, (2, 1): 1, (3, 2): 2, (5, 3): 1}


def test_sessions_close_and_continue(spark, tmp_path):
    folder, path, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    gap = dt.timedelta(hours=24)
    sink = J.session_batches(path, gap)

    def handle(batch, number):
        sink(batch, number)
        sink(batch, number)

    for n, rows in enumerate(BATCHES):
        put(spark, folder, f"b{n}", rows)
        run(feed(spark, folder).select("user_id", "ts"), handle, check, "append")
        if n == 1:
            middle = {(r.user_id, r.messages, r.closed) for r in J.sessions_of(spark, path, gap).collect()}
            # The watermark was at 1 h when the second batch came, so event 6 joined the open session of its user.
            assert middle == {(1, 3, True), (1, 1, False), (2, 1, True), (2, 1, False)}
    run(feed(spark, folder).select("user_id", "ts"), handle, check, "append")
    rows = [(r.user_id, r.messages, (r.session_end.replace(tzinfo=dt.timezone.utc) - START).total_seconds() / 3600, r.closed) for r in J.sessions_of(spark, path, gap).collect()]
    # Event 7 lies before the watermark of the third batch and is dropped.
    assert sorted(rows) == [(1, 1, 54, True), (1, 3, 26, True), (2, 1, 26, True), (2, 2, 75, True), (3, 1, 124, False)]


@pytest.mark.parametrize("cooldown", [1, 60, 2000])
def test_throttle_goes_on_between_batches(spark, tmp_path, cooldown):
    folder, path, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    sink = J.throttle_batches(path, dt.timedelta(minutes=cooldown), dt.timedelta(days=30))

    def handle(batch, number):
        sink(batch, number)
        sink(batch, number)

    batches = [[(100 * n + i, i % 2, 10 * n + i * i % 17 / 3) for i in range(40)] for n in range(3)]
    batches[2].append((999, 0, 0.01))
    for n, rows in enumerate(batches):
        put(spark, folder, f"b{n}", rows)
        run(feed(spark, folder).select(F.col("user_id").cast("string").alias("category"), "ts", F.col("event_id").alias("alert_id")), handle, check, "append")
    got = {r.alert_id for r in spark.read.parquet(f"{path}/kept").collect()}
    last, want = {}, set()
    for rows in batches:
        for i, user, h in sorted(rows, key=lambda r: (at(r[2]), r[0])):
            if user not in last or (at(h) - last[user]).total_seconds() >= cooldown * 60:
                last[user] = at(h)
                want.add(i)
    assert got == want


def test_a_table_may_be_a_folder_of_part_files(spark, tmp_path):
    """The part files have names of their own; a table of one file has the table's."""
    rows = spark.createDataFrame([(i, i % 3, "user", f"text {i}") for i in range(9)], MESSAGES)
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "conversations.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    shutil.copy(next((tmp_path / "part").glob("*.parquet")), tmp_path / "one" / "conversations.parquet")
    for name in ("many", "one"):
        stream = J.read_files(spark, str(tmp_path / name), "conversations.parquet", MESSAGES)
        assert J.run_available(stream.select("conv_id"), f"folder-{name}").count() == 9
        assert stream_scored_log(spark, str(tmp_path / name)).agg(F.sum("messages")).first()[0] == 9


def test_cost_levels_continue_and_forget(spark, tmp_path):
    """Batches and one run over all rows agree with plain Python; days that have passed leave the state, a repeated batch replaces itself."""
    rng = random.Random(3)
    first = [(i, rng.choice([1, 2, None]), at(rng.random() * 40), rng.choice(["m", "x", None]), rng.randrange(-200, 2000), rng.choice([None, 5, 900])) for i in range(300)]
    later = [(i, rng.choice([1, 2, None]), at(39.5 + rng.random() * 60), "m", rng.randrange(2000), 5) for i in range(300, 500)]
    rows = [first, later]
    prices = {"m": ("0.01", "0.02"), "x": ("0.03", "0.01")}

    def want(batches):
        out, total, top = set(), {}, {}
        step = 50_000_000
        for batch in batches:
            for i, u, t, m, a, b in sorted(batch, key=lambda r: (r[2], r[0])):
                pair = {"x": (300_000, 100_000)}.get(m, (100_000, 200_000))
                key = (None if u is None else str(u), t.date())
                total[key] = total.get(key, 0) + (0 if b is None else a * pair[0] + b * pair[1])
                level = total[key] // step if total[key] > step else 0
                if level > top.get(key, 0):
                    top[key] = level
                    out.add((*key, i, level))
        return out

    key = lambda frame: {(r.user_id, r.day, r.event_id, r.level) for r in frame.collect()}
    make = lambda part: spark.createDataFrame(part, SCHEMA).repartition(3)
    assert key(J.cost_levels(make(first + later), 0.005, prices=prices)[0]) == want([first + later])
    path = str(tmp_path / "levels")
    sink = J.cost_level_batches(path, 0.005, prices=prices)
    for n, part in enumerate([*rows, [(900, 1, at(2), "m", 90000, 5)]]):
        sink(make(part), n)
        sink(make(part), n)
    # The last row is far behind the watermark.
    got = key(spark.read.schema("user_id string, day date, event_id bigint, level bigint").parquet(f"{path}/levels"))
    newest = max(r[2] for r in first) - dt.timedelta(hours=1)
    assert got == want([first, [r for r in later if r[2] > newest]]) and len(got) > 100
    assert {r.day for r in spark.read.parquet(f"{path}/state/batch=2").collect()} <= {at(72).date(), at(96).date()}
