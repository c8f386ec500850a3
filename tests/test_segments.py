"""Running sums, neighbours, ranks and trailing lists against plain Python, with segments far smaller than a key."""

import random

import pytest
from pyspark.sql import functions as F

from chatlake.operators.segments import following, numbered, previous, running, top_n, trailing, turn_segment


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    # Key "hot" holds most rows; positions have holes, so some segments are empty.
    return [(k, t, rng.randint(0, 9)) for k, n in (("hot", 120), ("b", 7), (None, 3)) for t in sorted(rng.sample(range(300), n))]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k STRING, turn BIGINT, v BIGINT").repartition(5)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_running(frame, rows):
    got = running(frame, ["k"], turn_segment(width=8), [F.col("turn")], {"s": F.col("v")}, {"s": "total"}).collect()
    want = set()
    for k, rs in by_key(rows).items():
        total = sum(r[2] for r in rs)
        acc = 0
        for r in rs:
            acc += r[2]
            want.add((k, r[1], acc, total))
    assert {(r.k, r.turn, r.s, r.total) for r in got} == want and len(got) == len(rows)


def test_numbered_and_neighbours(frame, rows):
    base = numbered(frame, ["k"], turn_segment(width=8), [F.col("turn")])
    got = following(previous(base, ["k"], turn_segment(width=8), ["turn"], {"v": "before"}), ["k"], turn_segment(width=8), ["turn"], {"v": "after"})
    want = {
        (k, r[1], i + 1, rs[i - 1][2] if i else None, rs[i + 1][2] if i + 1 < len(rs) else None)
        for k, rs in by_key(rows).items() for i, r in enumerate(rs)
    }
    assert {(r.k, r.turn, r.rn, r.before, r.after) for r in got.collect()} == want


def test_top_n(frame, rows):
    got = top_n(frame, ["k"], [F.col("v").desc(), F.col("turn")], 4).collect()
    want = {(k, r[1]) for k, rs in by_key(rows).items() for r in sorted(rs, key=lambda r: (-r[2], r[1]))[:4]}
    assert {(r.k, r.turn) for r in got} == want


def test_trailing(frame, rows):
    base = numbered(frame.where("k IS NOT NULL"), ["k"], turn_segment(width=8), [F.col("turn")], "i")
    got = trailing(base, ["k"], "i", "v", 4, "last", width=5).collect()
    want = {(k, r[1], tuple(x[2] for x in rs[max(0, i - 3):i + 1])) for k, rs in by_key(rows).items() if k for i, r in enumerate(rs)}
    assert {(r.k, r.turn, tuple(r["last"])) for r in got} == want and len(got) == len(want)


def test_top_n_limits_groups_before_the_exchange(frame):
    plan = top_n(frame, ["k"], [F.col("turn")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan
