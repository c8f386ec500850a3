"""Decontamination against a plain search for every window in every document."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from chatlake.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, item_id string, row string, places int, items string, spans int, n_words int"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_rows(docs, items):
    wanted = {}
    for item_id, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - 9) if ws else 0):
            wanted.setdefault(tuple(ws[i:i + 10]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for size in {len(w) for w in wanted}:
            for i in range(len(ws) - size + 1):
                at = wanted.get(tuple(ws[i:i + size]))
                if at:
                    hit.update(range(i, i + size))
                    found |= at
        listed = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(ws), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def made(rng):
    kinds = [f"w{i}" for i in range(30)] + ["é", "日本", "İx", "x9"]
    make = lambda n: " ".join(rng.choice(kinds) for _ in range(n))
    items = [(i, make(rng.randint(8, 40))) for i in range(40)]
    items += [(3, make(14)), (50, "one two"), (51, "alone"), (52, ""), (53, None), (54, "!!"), (None, make(20)), (55, items[0][1]), (56, "a b c d e f")]
    # Common words inside, and a window whose shingles are all frequent but which never occurs whole.
    items += [(60, "s t u v w x y z s t u v w x y z"), (61, "S! T-u_v  W\nx y")]
    docs = [(0, None), (1, ""), (2, "?!"), (3, "One, TWO."), (4, "Alone"), (5, "x Alone."), (6, "a b c d e f"), (7, "a b c d e"), (8, "b a b c d e f g")]
    for i in range(120):
        parts = [make(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            ws = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(ws) - 1))
            parts += [" ".join(ws[a:a + rng.choice([5, 9, 10, 11, 30])]).upper(), make(rng.randint(0, 9))]
        docs.append((10 + i, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs += [(200, "s t u v w x y z " * 4000), (201, "t u v w x y z s t"), (202, " ".join(w for _, t in items for w in words(t)) * 2)]
    docs += [docs[30], docs[30], (30, "an id that repeats: " + items[2][1]), (None, "no id " + items[1][1]), (None, items[4][1])]
    return docs, items


@pytest.mark.parametrize(("bound", "bits"), [(200_000, 24), (0, 24), (0, 6)])
def test_rows(spark, monkeypatch, bound, bits):
    docs, items = made(random.Random(5))
    tables = {"documents": spark.createDataFrame([(*r, "i", "r", 1, "x", 2, 3) for r in docs], SCHEMA).repartition(5),
              "benchmark": spark.createDataFrame([(*r, 4, None) for r in items], "item_id long, text string, shingle int, length int").repartition(3)}
    real = decontamination.marked
    monkeypatch.setattr(decontamination, "read", lambda s, f, name: tables[name])
    monkeypatch.setattr(decontamination, "marked", lambda d, b: real(d, b, bound, bits))
    got = sorted(map(tuple, decontamination.op13_decontamination(spark, "").collect()), key=str)
    assert got == plain_rows(docs, items)
    assert 40 < sum(r[5] for r in got) < len(got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontamination.marked(docs.limit(0), items).count() == 0
    assert [tuple(r) for r in decontamination.marked(docs, items.limit(0)).orderBy("doc_id").collect()] == [(1, 3, None, None), (2, 0, None, None)]


def test_prefix_is_the_rarest_shingle(spark):
    """Of a window's shingles the one that the documents have least often is joined."""
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f g h")] * 3 + [(2, "c d e f g h i j")], "doc_id long, text string")
    shingles = decontamination.window_shingles(decontamination.windows(items))
    entries = decontamination.prefixes(shingles, decontamination.occurrences(docs, shingles, [5])).collect()
    assert [(r["place"], r["wanted"]) for r in entries] in ([(4, "a b c d e f g h i j")], [(5, "a b c d e f g h i j")])
    assert shingles.join(decontamination.occurrences(docs, shingles, [5]), "shingle").agg(F.sum("n")).first()[0] == 3 * 4 + 4
