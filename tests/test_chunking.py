"""Packing and merging against brute-force restatements on random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from chatlake.functions import chunking as C
from chatlake.functions import text as T
from chatlake.operators import chunking as H

TOKEN = re.compile(r"[A-Za-z0-9_]+|[฀-๿]")


def count(text):
    return len(TOKEN.findall(text))


def random_text(rng, headings=False, thai=False):
    out = []
    for _ in range(rng.randint(1, 60)):
        words = [rng.choice(["alpha", "be", "x1", "zeta", "longer_word", "ดี" if thai else "omega"]) for _ in range(rng.randint(1, 40))]
        out.append(" ".join(words) + rng.choice([".", "!", "?", "", "...", "\n"]))
        if headings and rng.random() < 0.1:
            out.append("\n# Title " + rng.choice("abc") + "\n")
    return rng.choice([" ", "\n", "\n\n"]).join(out).strip()


def expected(text, size, overlap):
    """Chunks by walking an explicit list of units; independent of the fold used in Spark."""
    limit, words = C.token_limit(size), C.overlap_tokens(overlap)
    if count(text) <= limit:
        return [text]
    for pattern in (r"(?m)(?=^#{1,6}\s+)", r"\n{2,}", r"(?<=[.!?。！？])\s+"):
        found = [p.strip() for p in re.split(pattern, text) if p.strip()]
        if len(found) > 1:
            break
    else:
        found = [text.strip()]
    flat = []
    for unit in found:
        if count(unit) <= limit:
            flat.append(unit)
            continue
        parts = [p.strip() for p in re.split(r"(?<=[.!?。！？])\s+", unit) if p.strip()]
        if len(parts) > 1:
            group, used = [], 0
            for p in parts + [None]:
                n = 0 if p is None else max(1, count(p))
                if group and (p is None or used + n > limit):
                    flat.append(" ".join(group))
                    group, used = [], 0
                if p is not None:
                    group, used = group + [p], used + n
        else:
            w = max(320, limit * 4)
            flat += [unit[i:i + w].strip() for i in range(0, len(unit), w) if unit[i:i + w].strip()]
    out, held, used = [], [], 0
    for unit in flat:
        n = max(1, count(unit))
        if held and used + n > limit:
            done = "\n\n".join(held).strip()
            out.append(done)
            tail = "" if not words else (" ".join(done.split()[-words:]) if " " in done else done[-max(60, 3 * words):])
            held, used = ([tail], count(tail)) if tail else ([], 0)
        held, used = held + [unit], used + n
    return out + ["\n\n".join(held).strip()]


@pytest.mark.parametrize("size,overlap", [(1100, 120), (500, 0), (600, 60)])
def test_token_chunks(spark, size, overlap):
    rng = random.Random(size)
    texts = [random_text(rng, headings=i % 3 == 0, thai=i % 4 == 0) for i in range(60)] + ["x" * 40_000, "word " * 3000]
    texts = [t.strip() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    got = {r.i: r.pieces for r in H.chunk_texts(df, "text", size=size, overlap=overlap).collect()}
    for i, t in enumerate(texts):
        assert got[i] == expected(t, size, overlap), i


def test_character_mode(spark):
    rng = random.Random(3)
    texts = [random_text(rng) for _ in range(20)] + ["", "a" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    for r in H.chunk_texts(df, "text", size=100, overlap=0).collect():
        assert all(0 < len(p) <= 100 for p in r.pieces)
        assert re.sub(r"\s|\. |\.", "", "".join(r.pieces)) == re.sub(r"\s|\. |\.", "", r.text)
    text = spark.createDataFrame([("one two three four five six",), ("a" * 30,), ("## a b\n## " + "c d " * 6,)], "t STRING")
    got = [r.p for r in text.select(C.character_chunks(F.col("t"), 12, 4).alias("p")).collect()]
    assert got[0] == ["one two", "two three four", "four five six"]
    assert got[1] == ["a" * 12, "aaaa " + "a" * 12, "aaaa " + "a" * 6]
    assert got[2][0] == "## a b" and all(len(p) <= 17 for p in got[2])


def test_merge(spark):
    rng = random.Random(5)
    docs = [[(rng.choice([5, 10, 30, 60, 90]), rng.choice(["", "a", "b"]), rng.choice([1, 1, 2])) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    rows = [(i, [(" ".join(["w"] * n), n, t, p, p, j, None, 0) for j, (n, t, p) in enumerate(d)]) for i, d in enumerate(docs)]
    kind = "ARRAY<STRUCT<content: STRING, n: INT, title: STRING, page_start: INT, page_end: INT, segment: INT, segment_end: INT, position: INT>>"
    df = spark.createDataFrame(rows, f"i INT, parts {kind}")
    got = {r.i: [(c.n, c.title, c.page_start, c.segment_end) for c in r.m] for r in df.select("i", C.merge_short(F.col("parts"), 24, 100).alias("m")).collect()}
    for i, d in enumerate(docs):
        out = []
        for j, (n, t, p) in enumerate(d):
            if out and n < 24 and out[-1][0] + n <= 100 and out[-1][2] == p:
                m, u, q, _ = out[-1]
                out[-1] = (m + n, u if not t or t == u else t if not u else f"{u} | {t}", q, j)
            else:
                out.append((n, t, p, None))
        # The tail rule of the contract never finds anything left to merge after this pass.
        assert got[i] == out


def test_markdown_document(spark):
    text = ("Source: somewhere\n\nTable of Contents\nIntro ......... 3\n![img](x.png) Opening words about [a plan](http://x) that go on for a while and a bit more, "
            "enough for a passage that carries meaning to a reader.\nhttps://example.com\n\n## Index\nfoo\n## Real part\n" + "meaningful words in a row " * 12 + "\n## Tiny\nonly five small words here now\n")
    df = spark.createDataFrame([("d", "guide_relapse.md", text, "md"), ("e", "empty.md", "  \n", "md")], "doc_id STRING, doc_name STRING, text STRING, suffix STRING")
    rows = H.chunks(df, size=1500, overlap=200).orderBy("chunk_index").collect()
    body = "\n".join(r.content for r in rows)
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and len(rows) == 2
    assert "a plan" in body and not any(x in body for x in ("Source:", "Contents", "....", "img", "example.com", "Index"))
    assert rows[0].metadata.topic == "relapse" and rows[0].metadata.source_weight == 1.10
    assert rows[-1].metadata.section_title == "Real part | Tiny"
    assert all(r.metadata.token_count == count(r.content) and r.metadata.char_count == len(r.content) for r in rows)


def test_text_functions(spark):
    df = spark.createDataFrame([("ﬁne  Ａ　b",), ("สวัสดีครับผมชื่อ ab c",), ("a\r\n\n b c",)], "t STRING")
    assert df.select(T.sanitise_string(F.col("t"))).first()[0] == "fine A b"
    tokens = df.select(T.lexical_tokens(F.col("t"))).collect()[1][0]
    run = "สวัสดีครับผมชื่อ"
    assert tokens == [run] + [run[i:i + 3] for i in range(len(run) - 2)] + ["ab"]
    assert df.select(T.normalise(F.col("t"))).collect()[2][0] == "a\nb\nc"
    assert [r[0] for r in df.select(T.language(F.col("t"))).collect()] == ["en", "mixed", "en"]
    masked = spark.sql("SELECT map('o', map('token', 'abcdefghijkl', 'x', 'y')) AS m").select(T.mask_nested(F.col("m"))).first()[0]
    assert masked == {"o": {"token": "abcd****ijkl", "x": "y"}}
