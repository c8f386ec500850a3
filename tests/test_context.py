import random

from pyspark.sql import functions as F

from chatlake.functions.lexicon import Lexicon
from chatlake.operators import context as X

LEX = Lexicon(high=("danger",), medium=("worry",))


def frame(spark, convs):
    rows = [(c, t, r, x) for c, msgs in convs.items() for t, (r, x) in enumerate(msgs)]
    return spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")


def test_pairing_matches_the_scan(spark):
    rng = random.Random(11)
    convs = {c: [(rng.choice(["user", "assistant", "system", "user"]), f"{c}-{t}") for t in range(rng.randint(0, 14))] for c in range(40)}
    df = frame(spark, convs)
    pairs, lone = set(), set()
    for c, msgs in convs.items():
        waiting = None
        for t, (role, text) in enumerate(msgs):
            if role == "user":
                if waiting:
                    lone.add((c, waiting[0]))
                waiting = (t, text)
            elif role == "assistant":
                if waiting:
                    pairs.add((c, t, waiting[1], text))
                    waiting = None
                else:
                    lone.add((c, t))
        if waiting:
            lone.add((c, waiting[0]))
    assert {tuple(r) for r in X.exchanges(df).collect()} == pairs
    assert {(r.conv_id, r.turn) for r in X.unpaired(df).collect()} == lone


def test_compaction_and_buckets(spark):
    msgs = [("system", "s"), ("system_summary", " old "), ("user", "plain"), ("assistant", "ok"), ("user", "danger"), ("assistant", "stay"),
            ("user", "alone"), ("user", "last"), ("assistant", "bye")]
    df = frame(spark, {1: msgs, 2: msgs[:4]})
    rows = X.compact(df, max_tokens=1, keep=1, lexicon=LEX).orderBy("conv_id", "part_rank", "turn").collect()
    assert [(r.text, r.part) for r in rows if r.conv_id == 1] == [
        ("s", "preserved"), ("old", "summary"), ("danger", "passthrough"), ("stay", "passthrough"), ("alone", "passthrough"), ("last", "recent"), ("bye", "recent")]
    assert [r.part for r in rows if r.conv_id == 2] == ["whole"] * 4
    pairs = X.compaction_buckets(df, max_tokens=1, keep=1, lexicon=LEX).first().pairs
    assert [(p.user_message, p.bot_response) for p in pairs] == [("plain", "ok")]
    new = spark.createDataFrame([(1, "short"), (2, "unused")], "conv_id BIGINT, summary STRING")
    texts = [r.text for r in X.compact(df, max_tokens=1, keep=1, lexicon=LEX, summaries=new).where("part = 'summary'").collect()]
    assert texts == ["Summary of the conversation so far: short"]


def test_summary_merge(spark):
    df = frame(spark, {1: [("system", "base"), ("system_summary", "one"), ("user", "hi"), ("system_summary", "two")],
                       2: [("user", "hi"), ("system_summary", "x")], 3: [("user", "hi"), ("system_summary", " ")]})
    rows = {(r.conv_id, r.turn): r.text for r in X.merge_summaries(df, header="H:").collect()}
    assert rows == {(1, 0): "base\n\nH:one\n\ntwo", (1, 2): "hi", (2, -1): "H:x", (2, 0): "hi", (3, 0): "hi"}


def test_context_row_goes_in_once(spark):
    mark = X.CONTEXT_MARK
    df = frame(spark, {1: [("system", "s"), ("user", "u")], 2: [("user", "u")], 3: [("system", mark + " x"), ("user", "u")]})
    ctx = spark.createDataFrame([(1, "c"), (2, "c"), (3, "c")], "conv_id BIGINT, context STRING")
    rows = X.inject_context(df, ctx).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.text.split("\n")[0]) for r in rows] == [
        (1, 0, "s"), (1, 1, mark), (1, 2, "u"), (2, 0, mark), (2, 1, "u"), (3, 0, mark + " x"), (3, 1, "u")]


def test_token_budget_with_missing_counts(spark):
    rows = [(1, "u", 5, None, True), (2, "u", 9, 0, False), (3, "u", 8, 50, False), (4, "u", 7, 60, False), (5, "u", 6, 1, False)]
    df = spark.createDataFrame(rows, "id BIGINT, user_id STRING, ts BIGINT, token_count BIGINT, important_flag BOOLEAN")
    kept = X.token_budget(df, 100, estimate=F.lit(10).cast("bigint")).orderBy("rn").collect()
    # Order 1, 2, 3, then 4 overflows; 5 would fit but comes after the stop.
    assert [(r.id, r.running_tokens) for r in kept] == [(1, 10), (2, 20), (3, 70)]
