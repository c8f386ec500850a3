"""Periodic runs against a search of all periods and stretches in plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from chatlake.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, id string, k1 long, h string, runs int, period int, start string"


def plain_runs(ws):
    """(start, period, length) of all runs; a stretch belongs to its least period."""
    n, found = len(ws), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, q, length) for (s, length), q in found.items())


def plain_damage(doc_id, ws):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(ws)
    if h % 10 or not n:
        return ws
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    ws = plain_damage(doc_id, WORD.findall(text or ""))
    runs = plain_runs(ws)
    drop = {i for s, q, length in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    kept = " ".join(w for i, w in enumerate(ws) if i not in drop)
    listed = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
    top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def made_texts(rng):
    """Words of few kinds, repeats of many lengths (also inside each other), constant texts, white space of all kinds."""
    out = [None, "", " \n\t", "one", "a " * 11, "a " * 12, "a\tb\r\n" * 6, ("a b " * 5) + "a", "é🙂 x " * 9, "z " * 700, ("q " * 40 + "r ") * 8]
    for _ in range(40):
        kinds = rng.choice([1, 2, 3, 50])
        piece = lambda: " ".join(f"w{rng.randrange(kinds)}" for _ in range(rng.randint(1, 40)))
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = piece()
            parts += [p] * rng.choice([1, 1, 2, 3, 7])
        text = " ".join(parts)
        out.append(" ".join([text] * rng.choice([1, 1, 2, 3])))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = made_texts(rng)
    rows = [(i, t, None, "x", 1, "h", 2, 3, "s") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (20, "another text of this id " * 4, *rows[0][2:]), (None, "no id " * 9, *rows[0][2:]), (None, None, *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("tile", [64, 256, periods.TILE])
def test_fragments_against_all_stretches(tile):
    """All tiles of a text, stitched by hand, give its runs."""
    rng = random.Random(tile)
    for text in made_texts(rng):
        ws = (text or "").split()
        codes = np.array([hash(w) & 0xFFFF for w in ws], np.int64)
        parts = {}
        for least, most, start, stop in periods.plan(len(ws), tile):
            for q, a, b in zip(*(x.tolist() for x in periods.fragments(codes[start:stop], least, most, start > 0, stop < len(ws))), strict=True):
                parts.setdefault(q, []).append((a + start, b + start))
        found = {}
        for q in sorted(parts):
            joined = []
            for a, b in sorted(parts[q]):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            for a, b in joined:
                if b - a + q >= max(12, 2 * q):
                    found.setdefault((a, b + q - a), q)
        assert sorted((s, q, length) for (s, length), q in found.items()) == plain_runs(ws), text


@pytest.mark.parametrize("bound", [1_000_000, 0])
@pytest.mark.parametrize("tile", [64, periods.TILE])
def test_rows(spark, docs, tmp_path, monkeypatch, tile, bound):
    monkeypatch.setattr(periods, "read", lambda *_: docs)
    monkeypatch.setattr(periods, "TILE", tile)
    real, lists = periods.with_runs, periods.run_lists
    monkeypatch.setattr(periods, "with_runs", lambda rows, found: real(rows, found, bound))
    monkeypatch.setattr(periods, "run_lists", lambda rows, _: lists(rows, tile))
    got = sorted(map(tuple, periods.op11_periodic_runs(spark, "").collect()), key=str)
    assert got == sorted((plain_row(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert sum(r[1] > 0 for r in got) > 15


def test_long_text_and_empty_table(spark):
    rng = random.Random(5)
    part = [f"w{rng.randrange(10 ** 6)}" for _ in range(30_000)]
    text = " ".join(["x", *part, *part, *part, *part[:500]])
    frame = spark.createDataFrame([(3, text)], "doc_id long, text string")
    row = periods.described(frame, 1 << 12, texts=True).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 30_000, 90_500)]
    assert row["collapsed_text"] == " ".join(["x", *part])
    assert periods.described(frame.limit(0)).count() == 0
