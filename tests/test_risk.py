import pytest
from pyspark.sql import functions as F

from chatlake.functions import risk as R
from chatlake.functions.lexicon import Lexicon
from chatlake.operators.risk import score

LEX = Lexicon(
    high=("overdose", "kms", "end it", "can’t go on", "🔪", "OVERDOSE"), medium=("stress", "substance", "sub", "lsd", "💊", "เครียด"),
    negations=("not ", "ไม่ได้", "a very long negation"), suicide=("kms", "end it", "can't go on", "🔪"), overdose=("overdose",), substance_signals=("sub", "lsd"),
)

CASES = [
    ("An OVERDOSE", "high", ["overdose"]), ("stress", "medium", ["stress"]), ("stress and lsd", "high", ["stress", "lsd"]),
    ("nothing", "general", []), ("", "general", []), ("🔪", "high", ["🔪"]), ("so 💊", "medium", ["💊"]),
    ("not overdose", "medium", ["overdose"]), ("not stress", "general", []), ("not really, no, overdose", "high", ["overdose"]),
    ("bookmarkms", "general", []), ("kms", "high", ["kms"]), ("ดีkms", "high", ["kms"]), ("ดkms", "general", []), ("🔪🔪 not kms", "high", ["🔪"]),
    ("😀 not kms", "medium", ["kms"]), ("substance", "medium", ["substance"]), ("can't go on", "high", ["can't go on"]),
    ("เครียด", "medium", ["เครียด"]), ("ไม่ได้เครียด", "general", []), ("not overdose but overdose", "medium", ["overdose"]),
    ("stress substance", "high", ["substance", "stress"]),
]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i INT, text STRING")
    return {r.i: r for r in score(df, LEX).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_level_and_keywords(scored, i):
    assert (scored[i].risk_level, scored[i].keywords) == (CASES[i][1], CASES[i][2])


def test_category_importance_level_band(spark):
    df = spark.createDataFrame([(["overdose", "kms"],), (["overdose"],), (["substance"],), (["stress"],)], "k ARRAY<STRING>")
    assert [r[0] for r in df.select(R.category(F.col("k"), LEX)).collect()] == ["suicide", "overdose", "substance", "emotional"]
    df = spark.createDataFrame([("a" * 300, "b" * 500, "general"), ("a" * 301, "b", "general"), ("a", "b" * 501, None), ("a", "b", "high"), ("a", "b", "general")], "u STRING, b STRING, l STRING")
    assert [r[0] for r in df.select(R.is_important(F.col("u"), F.col("b"), F.col("l"))).collect()] == [False, True, True, True, False]
    df = spark.createDataFrame([(None,), ("",), ("LOW",), ("High",), ("odd",)], "l STRING")
    assert [r[0] for r in df.select(R.normalise_level(F.col("l"))).collect()] == ["unknown", "unknown", "general", "high", "odd"]
    df = spark.createDataFrame([("alcohol", 10), ("alcohol", 26), ("alcohol", 27), ("x", 3), ("x", 4), ("x", 27)], "s STRING, n INT")
    assert [r[0] for r in df.select(R.score_band(F.col("s"), F.col("n"))).collect()] == ["low", "medium", "high", "low", "medium", "high"]
