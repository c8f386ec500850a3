"""The Jaccard join with hot groups, long texts, repeated ids and small bounds, against plain sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlake.llm import components, jaccard


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def linked(rows):
    """Smallest id that links reach, by comparing all pairs of texts."""
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(shingles(t)), []).append(i)
    groups = [s for s in sets if s]
    root = list(range(len(groups)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(groups)):
        for b in range(a):
            if 100 * len(groups[a] & groups[b]) >= 75 * len(groups[a] | groups[b]):
                root[find(a)] = find(b)
    least = {}
    for g, s in enumerate(groups):
        least.setdefault(find(g), []).extend(sets[s])
    return {frozenset(s): min((i for i in least[find(g)] if i is not None), default=None) for g, s in enumerate(groups)}


def check(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = linked(rows)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.clustered(frame, **options).collect()]
    plain = [(i, len(shingles(t)), i if not shingles(t) else i if want[frozenset(shingles(t))] is None else want[frozenset(shingles(t))]) for i, t in rows]
    assert sorted(got, key=str) == sorted(plain, key=str)


def edited(rng, words, n, tag):
    out = list(words)
    for k in range(n):
        out[rng.randrange(len(out))] = f"{tag}x{k}"
    return " ".join(out)


def test_null_ids_and_long_texts(spark):
    """500 near copies without an id, texts of 8000 shingles that share parts, and a repeated id."""
    rng = random.Random(2)
    base = [f"b{rng.randrange(10 ** 6)}" for _ in range(80)]
    rows = [(None, edited(rng, base, 1, f"n{k}")) for k in range(500)] + [(5, " ".join(base)), (None, None), (None, ""), (3, "one two")]
    long = [[f"l{k}w{rng.randrange(10 ** 6)}" for _ in range(8004)] for k in range(6)]
    for k, words in enumerate(long):
        rows.append((100 + k, " ".join(words)))
        rows.append((200 + k, " ".join(words[:7600] + long[(k + 1) % 6][:400])))
        rows.append((300 + k, " ".join(words[:4000] + long[(k + 1) % 6][:4000])))
    rows += [(7, " ".join(long[0])), (7, " ".join(base)), (7, "another text of the id seven here")]
    check(spark, rows)


@pytest.mark.parametrize("hot", [5, 200_000])
def test_hot_shingles(spark, monkeypatch, hot):
    """Texts that share most of their words with many others, few of them linked; shingles dealt out by node or not."""
    rng = random.Random(4)
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "TIMES_MEAN", 0)
    passage = [f"p{rng.randrange(10 ** 6)}" for _ in range(120)]
    rows = []
    for k in range(150):
        own = [f"o{k}w{i}" for i in range(rng.choice([8, 15, 25, 40]))]
        rows.append((k, " ".join(own + passage)))
        if k % 5 == 0:
            rows.append((1000 + k, " ".join(own + passage[:-1])))
    family = [f"f{rng.randrange(10 ** 6)}" for _ in range(60)]
    rows += [(2000 + k, edited(rng, family, rng.choice([0, 1, 2, 4]), f"e{k}")) for k in range(120)]
    check(spark, rows, hot=hot)


def test_fine_points_bound_the_overlap():
    rng = np.random.default_rng(1)
    for n, m, shared in [(10, 3000, 5), (40, 60, 30), (9000, 700, 650), (2000, 2000, 0), (1, 1, 1)]:
        both = rng.integers(0, 1 << 63, shared, np.uint64) << np.uint64(1)
        a = np.unique(np.concatenate((both, rng.integers(0, 1 << 63, n - shared, np.uint64) << np.uint64(1))))
        b = np.unique(np.concatenate((both, rng.integers(0, 1 << 63, m - shared, np.uint64) << np.uint64(1))))
        ga, gb = (jaccard.groups_of(jaccard.point_of(x), len(x)) for x in (a, b))
        assert len(ga) == len(a) and (np.diff(ga) >= 0).all()
        most = jaccard.common_at_most(ga, gb)
        assert shared <= most <= np.minimum(*jaccard.dense([ga, gb], np.array([len(a), len(b)]))).sum()
    # Unrelated long sets are told apart, which 256 groups cannot do.
    assert most <= 1 and jaccard.common_at_most(*(jaccard.groups_of(jaccard.point_of(x), 8000) for x in (
        np.unique(rng.integers(0, 1 << 63, 8000, np.uint64)), np.unique(rng.integers(0, 1 << 63, 8000, np.uint64))))) < 3000


def test_places():
    rank = np.arange(300)
    for n in (1, 7, 1200, 1 << 20):
        places = jaccard.place_of(n, rank[:max(1, n // 4)])
        size, rest = jaccard.size_and_rest(places)
        assert (size == n).all() and (rest >= n - rank[:len(rest)]).all() and rest[0] == n
    huge = jaccard.size_and_rest(jaccard.place_of(1 << 30, rank))
    assert jaccard.may_link(huge[0], huge[1], np.full(300, 3), np.full(300, 3), 75).all()


def test_bounds(spark, monkeypatch):
    """The ways beyond the broadcast bounds give the same rows, and scratch files go."""
    from chatlake import session

    monkeypatch.setattr(jaccard, "BROADCAST_NODES", 1)
    monkeypatch.setattr(jaccard, "BROADCAST_BLOCKS", 0)
    monkeypatch.setattr(jaccard.verified, "__defaults__", (jaccard.PERCENT, 1))
    monkeypatch.setattr(components.components, "__defaults__", ("a", "b", 7))
    rng = random.Random(8)
    base = [f"b{rng.randrange(10 ** 6)}" for _ in range(40)]
    rows = [(k, edited(rng, base, k % 3, f"n{k}")) for k in range(40)] + [(None, " ".join(base)), (3, " ".join(base))]
    check(spark, rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = len(session._WRITTEN)
    kept = jaccard.representatives(frame)
    assert len(session._WRITTEN) == before + 1
    want = linked(rows)
    ids = {i for i, t in rows if i is not None and want[frozenset(shingles(t))] == i}
    assert {r.doc_id for r in kept.filter(F.col("doc_id").isNotNull()).collect()} == ids


@pytest.mark.parametrize("task_edges", [3, 40, 1 << 20])
def test_components_of_chains_and_stars(spark, task_edges):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(30)] + [(300, 300), (-5, 400), (400, 7)] + [(200 + 2 * i, 201 + 2 * i) for i in range(20)]
    rng.shuffle(edges)
    from chatlake.session import materialise
    frame = materialise(spark.createDataFrame([e if rng.random() < .5 else e[::-1] for e in edges], "a long, b long").repartition(4), "edges")
    got = {r.node: r.root for r in components.components(frame, task_edges=task_edges).collect()}
    want = {i: -5 for i in [*range(61), -5, 400]} | {100 + i: 100 for i in range(30)} | {200 + i: 200 + i - i % 2 for i in range(40)}
    assert got == want
