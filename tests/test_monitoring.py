import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlake.operators import monitoring as M
from chatlake.operators import usage as U

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("seed,cooldown,slice_seconds", [(1, 60, 30), (2, 60, 600), (3, 45, 45), (4, 10, 3600), (5, 300, 100)])
def test_throttle_matches_the_sequential_rule(spark, seed, cooldown, slice_seconds):
    rng = random.Random(seed)
    rows = [(rng.choice("aab"), START + dt.timedelta(seconds=rng.randint(0, 4000)), i) for i in range(250)]
    df = spark.createDataFrame(rows, "category STRING, ts TIMESTAMP, event_id BIGINT").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.event_id for r in M.throttle(df, "category", dt.timedelta(seconds=cooldown), segment=dt.timedelta(seconds=slice_seconds)).collect()}
    last, want = {}, set()
    for c, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if c not in last or (t - last[c]).total_seconds() >= cooldown:
            last[c] = t
            want.add(i)
    assert got == want


@pytest.mark.parametrize("rows,fan,cooldown", [(1, 2, 60), (3, 2, 45), (7, 3, 200), (16, 32, 5)])
def test_throttle_of_one_hot_category(spark, rows, fan, cooldown):
    """All alerts of one category, in slices of few alerts and ranges of few slices: no group is larger than that."""
    rng = random.Random(rows)
    table = [("hot", START + dt.timedelta(seconds=rng.randint(0, 6000), milliseconds=rng.choice([0, 0, 500])), i) for i in range(400)]
    table += [(None, START + dt.timedelta(seconds=30 * i), 1000 + i) for i in range(20)] + [("rare", START, 2000)]
    df = spark.createDataFrame(table, "category STRING, ts TIMESTAMP, event_id BIGINT").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.event_id for r in M.throttle(df, "category", dt.timedelta(seconds=cooldown), rows=rows, fan=fan).collect()}
    last, want = {}, set()
    for c, t, i in sorted(table, key=lambda r: (r[1], r[2])):
        if c not in last or (t - last[c]).total_seconds() >= cooldown:
            last[c] = t
            want.add(i)
    assert got == want


def test_step_functions_compose():
    """Combining two neighbouring functions equals going through one after the other, for every state before them."""
    rng = random.Random(3)
    for _ in range(200):
        gap = rng.choice([1, 5, 20])
        us = np.array(sorted(rng.sample(range(100, 200), rng.randint(2, 40))))
        cut = rng.randint(1, len(us) - 1)
        left, right = M._steps(us[:cut], gap), M._steps(us[cut:], gap)
        both = M._then(left, right, gap)
        for before in [None, *range(60, int(us[0]))]:
            assert M._after(*both, before, gap) == M._after(*right, M._after(*left, before, gap), gap) == M._after(*M._steps(us, gap), before, gap)
        assert len(both[0]) <= np.searchsorted(us, us[0] + gap) + 1 + len(right[0])


def test_no_cooldown_keeps_everything(spark):
    df = spark.createDataFrame([("a", START, 1), ("a", START, 2)], "category STRING, ts TIMESTAMP, event_id BIGINT")
    assert M.throttle(df, "category", dt.timedelta(0)).count() == 2


def test_cost_alert_at_exactly_the_threshold(spark):
    rows = [(1, "u", START, "m", 1000, 0), (2, "u", START + dt.timedelta(seconds=1), "m", 1000, 0), (3, "u", START + dt.timedelta(hours=2), "m", 1000, 0)]
    df = spark.createDataFrame(rows, "event_id BIGINT, user_id STRING, ts TIMESTAMP, model STRING, input_tokens BIGINT, output_tokens BIGINT")
    costed = U.with_cost(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), {"m": ("0.5", "0")})
    # 0.5, then exactly 1.0 (no alert), then 1.5.
    assert [(r.event_id, r.level) for r in U.cost_alerts(costed, "1.0").collect()] == [(3, 1)]
