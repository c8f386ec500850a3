"""The golden look-back numbers on a rebuilt fixture."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatlake.operators import analytics as N
from chatlake.operators import risk as K

NOW = dt.datetime(2024, 6, 15, 12)


@pytest.fixture(scope="module")
def activity(spark):
    plan = [("a", 2, True, 100), ("a", 1, False, 200), ("a", 40, True, 300)]
    plan += [("b", 20, i < 4, 250) for i in range(12)] + [("c", 70, True, 400)] + [("d", 8, i == 0, 150) for i in range(3)]
    rows = [(i, u, NOW - dt.timedelta(days=d, minutes=i), t, f) for i, (u, d, f, t) in enumerate(plan, 1)]
    df = spark.createDataFrame(rows, "id BIGINT, user_id STRING, ts TIMESTAMP, token_count BIGINT, important_flag BOOLEAN")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def progress(spark):
    rows = [("a", 2, "high"), ("a", 50, "medium"), ("b", 45, "high"), ("d", 6, "medium")]
    df = spark.createDataFrame([(i, u, NOW - dt.timedelta(days=d), lv, ["x"]) for i, (u, d, lv) in enumerate(rows)],
                               "event_id INT, user_id STRING, ts TIMESTAMP, risk_level STRING, keywords ARRAY<STRING>")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.mark.parametrize("days,rows,users,high,medium,depth", [(7, 2, 1, 1, 1, 2), (30, 17, 3, 1, 1, 4), (90, 19, 4, 2, 2, 6)])
def test_lookback(activity, progress, days, rows, users, high, medium, depth):
    window = N.since(activity, as_of=NOW, days=days)
    o = N.overview(window).first()
    assert (o.total_messages, o.unique_users) == (rows, users)
    r = K.risk_summary(N.since(progress, as_of=NOW, days=days)).first()
    assert (r.high, r.medium, r.general, r.unknown) == (high, medium, 0, 0)
    assert N.depth_trend(window).count() == depth


def test_history_and_export(activity):
    for days, want in ((30, (2, 1)), (90, (3, 2))):
        s = N.user_snapshots(N.since(activity, as_of=NOW, days=days)).where("user_id = 'a'").first()
        assert (s.total_messages, s.important_messages) == want
    rows = N.export_rows(N.between(activity, "2024-06-12", "2024-06-15"), "s", limit=100).collect()
    assert [r.id for r in rows] == [1, 2] and all(len(r.user_hash) == 12 for r in rows)


def test_bounds():
    assert N.parse_bound("2024-01-02", end=True) == dt.datetime(2024, 1, 2, 23, 59, 59, 999_999)
    assert N.parse_bound("2024-01-02T10:00:00+07:00") == dt.datetime(2024, 1, 2, 3)
    assert N.lookback_start(NOW, 0) == dt.datetime(2024, 6, 15) and N.clamp("lookback", 999) == 180


def test_empty_window(activity):
    k = N.engagement(N.since(activity, cutoff=dt.datetime(2030, 1, 1))).first()
    assert (k.active_users, k.avg_messages_per_user, k.important_message_share) == (0, 0.0, 0.0)


def test_filter_reaches_the_reader(spark):
    from chatlake.sources import adapters as S

    plan = N.overview(N.since(S.activity(spark, "/root/testdata/sf0.001"), as_of=S.AS_OF, days=7))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan.split("ReadSchema")[1]
