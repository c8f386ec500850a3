"""The dealt methods against plain Python: the randomness battery, out-of-place distances, FTRL, the mix's cut; and ways beyond bounds."""

import collections
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlake.llm import language, mixing, quality, secrets, toxicity


def normal(z):
    z = max(-30.0, min(30.0, z))
    power = -1.5976 * z - 0.070566 * z ** 3
    return 0.0 if power > 700 else 1 / (1 + math.exp(power))


def plain_battery(token):
    """(n, p_random, p_word) of a token."""
    import re
    body = token.rstrip("=")
    k = next((size for pattern, size in ((r"[0-9]+", 10), (r"[0-9a-f]+|[0-9A-F]+", 16), (r"[a-z]+", 26), (r"[A-Z]+", 26), (r"[A-Z2-7]+", 32), (r"[a-z0-9]+", 36),
                                         (r"[A-Z0-9]+", 36), (r"[A-Za-z0-9]+", 62)) if re.fullmatch(pattern, body)), 64)
    n, codes = len(body), [ord(c) for c in body]
    chi = k / n * sum(v * v for v in collections.Counter(body).values()) - n
    mean = sum(codes) / n
    dev = sum((c - mean) ** 2 for c in codes)
    co = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:]))
    changes = sum((a > mean) != (b > mean) for a, b in zip(codes, codes[1:]))
    high = sum(c > mean for c in codes)
    df = k - 1
    z_chi = ((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    mu = 2 * high * (n - high) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    z_runs = (changes + 1 - mu) / math.sqrt(var) if var > 1e-9 else 30.0
    z_serial = co / dev * math.sqrt(n) if dev > 1e-9 else 30.0
    worst = min(1 - normal(z_chi), 2 * normal(-abs(z_runs)), 2 * normal(-abs(z_serial)))
    shift = n * (k * {10: 0.1, 16: 0.26}.get(k, 0.066) - 1)
    p_word = normal((chi - df - shift) / math.sqrt(2 * df + 4 * shift))
    if k == 16:
        share = sum(c not in "0123456789" for c in body) / n
        part = lambda x, of: x * math.log(x / of) if x > 0 else 0.0
        p_word = max(p_word, 1.0 if share <= 0.03 else math.exp(-n * (part(share, 0.03) + part(1 - share, 0.97))))
    return n, min(1.0, 3 * worst), p_word


def tokens(rng):
    kinds = ["0123456789", "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    out = ["".join(rng.choice(k) for _ in range(rng.choice([20, 31, 32, 47, 64, 130]))) for k in kinds for _ in range(12)]
    return out + ["theonationing" * 3, "x" * 40, "ab" * 20, "0" * 22, "deadbeef" * 5, out[-1] + "=="]


def test_battery(spark):
    found = tokens(random.Random(3))
    rows = spark.createDataFrame(list(enumerate(found)), "i int, t string").select("i", secrets.battery(F.col("t")).alias("b")).collect()
    for r in rows:
        n, p_random, p_word = plain_battery(found[r.i])
        assert r.b.n == n and r.b.p_random == pytest.approx(p_random, abs=1e-9) and r.b.p_word == pytest.approx(p_word, abs=1e-9), found[r.i]


def test_false_discoveries(spark):
    """Benjamini and Hochberg's rule over bins of p-values, by band of length."""
    rng = random.Random(9)
    found = [t for t in tokens(rng) + tokens(rng) if "=" not in t]
    frame = spark.createDataFrame([(i, "a " + " ".join(found[i::7]) + " z") for i in range(7)], "doc_id long, text string")
    limits = secrets.thresholds(secrets.scanned(frame))
    tried, bins = collections.Counter(), collections.defaultdict(collections.Counter)
    for t in found:
        n, p_random, p_word = plain_battery(t)
        band = sum(n >= edge for edge in (32, 48, 64, 128))
        tried[band] += 1
        if p_random >= 0.01:
            bins[band][min(80, math.floor(-math.log10(max(p_word, 1e-30)) * 4))] += 1
    want = []
    for band in range(5):
        ok = [i for i in range(81) if (m := sum(c for b, c in bins[band].items() if b >= i)) and 10 ** (-i / 4) * tried[band] <= 0.01 * m]
        want.append(min(ok, default=81))
    assert limits == want


def test_redaction_against_slices(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("ab é🙂\n") for _ in range(rng.choice([0, 5, 4095, 4096, 4097, 9000, 20_000])))
        spans = sorted((a, min(len(text), a + rng.choice([1, 3, 700, 5000]))) for a in (rng.randrange(len(text)) for _ in range(rng.randint(0, 30))) ) if text else []
        rows.append((i, text, [{"start": a, "kind": 0, "end": b} for a, b in spans]))
    frame = spark.createDataFrame(rows, "i int, text string, s array<struct<start:int,kind:int,end:int>>")
    for r in frame.withColumn("out", secrets.without(F.col("text"), F.col("s"), "[x]")).collect():
        out, at = "", 0
        for x in r.s:
            if x.start >= at:
                out += r.text[at:x.start] + "[x]"
            at = max(at, x.end)
        assert r.out == out + r.text[at:]


def test_many_secrets_in_one_text(spark):
    """Twice the matches in one text take no more than about twice the time."""
    taken = {}
    for n in (10_000, 20_000, 20_000, 40_000):
        frame = spark.createDataFrame([(1, " ".join(f"token=abcdefgh{i}" for i in range(n)))], "doc_id long, text string").cache()
        frame.count()
        start = time.perf_counter()
        text = secrets.redacted(frame).first()["text"]
        taken[n] = time.perf_counter() - start
        assert text == " ".join(["[secret]"] * n)
    assert taken[40_000] < 2.6 * taken[20_000] + 1


def plain_profile(texts, size):
    counts = collections.Counter()
    for text in texts:
        flat = "".join(c if c.isalpha() else " " for c in text.lower())
        padded = " " + flat + " "
        while "  " in padded:
            padded = padded.replace("  ", " ")
        # The text itself keeps one space at its ends where it has some there.
        inner = flat
        while "  " in inner:
            inner = inner.replace("  ", " ")
        padded = " " + inner + " "
        counts.update(c for c in inner if c != " ")
        counts.update(padded[i:i + 2] for i in range(len(padded) - 1))
        counts.update(padded[i:i + 3] for i in range(len(padded) - 2))
    key = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], key(x[0])))[:size]]


def test_out_of_place_distances(spark):
    rng = random.Random(6)
    vocabulary = {"aa": "der und nicht schön ist ein straße", "bb": "the and of which is a street", "cc": "le et dans qui est une rue œuvre", "dd": "el y de que está una calle año"}
    make = lambda lang, n: "".join(w + rng.choice([" ", ", ", "\n", " 12 "]) for w in rng.choices(vocabulary[lang].split(), k=n))
    rows = [(i, make(lang, rng.randint(1, 30)), lang) for i, lang in enumerate(rng.choices(list(vocabulary), k=80))]
    rows += [(100 + i, make("aa", 4) + make("bb", 4) + rng.choice(["zz", "éé", ""]), None) for i in range(30)] + [(200, "a", None), (201, " ,a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    size = 40
    profiles = {lang: {g: i for i, g in enumerate(plain_profile([t for _, t, x in rows if x == lang], size))} for lang in vocabulary}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predicted(docs, language.learned(docs, size)).collect()}
    for i, text, _ in rows:
        own = plain_profile([text], size)
        away = sorted((sum(abs(p[g] - j) if g in p else size for j, g in enumerate(own)), lang) for lang, p in profiles.items())
        assert got[i][0] == away[0][1] and got[i][1] == pytest.approx(1 - away[0][0] / away[1][0] if away[1][0] else 0.0)


def test_profiles_are_cut_before_languages_meet(spark, capsys):
    docs = spark.createDataFrame([("a b", "x")], "text string, lang string")
    language.profiles(docs).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def plain_ftrl(examples, epochs):
    """Weights by feature, one coordinate at a time."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == "bias" else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for feats, label in examples:
            w = {i: weight(i) for i in [*sorted(feats), "bias"]}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - label
            for i in w:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    return weight


def test_ftrl_against_plain_loops(spark):
    """The same scores as FTRL on the words, pairs and skipped pairs themselves, without hashing."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["ab", "Cd!", "ef", "gh", "vile", "(ij)"], weights=[4, 4, 4, 4, 1 + 6 * (i % 3 == 0), 4], k=rng.randint(0, 12))), int(i % 3 == 0)) for i in range(240)]

    def feats(text):
        w = [x.lower().strip("!()") for x in text.split()]
        return {(x,) for x in w} | set(zip(w, w[1:])) | {(a, "*", b) for a, b in zip(w, w[2:])}

    frame = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(4)
    order = [r.doc_id for r in frame.orderBy(F.xxhash64(F.col("doc_id").cast("string"))).collect()]
    weight = plain_ftrl([(feats(rows[i][1]), rows[i][2]) for i in order], 3)
    got = {r.doc_id: r.score for r in toxicity.scored(frame, toxicity.fitted(frame, epochs=3)).collect()}
    for i, text, _ in rows:
        want = 1 / (1 + math.exp(-(weight("bias") + sum(weight(f) for f in feats(text)))))
        assert got[i] == pytest.approx(want, abs=2e-5)
    assert len({round(x, 4) for x in got.values()}) > 20


@pytest.fixture(scope="module")
def mix_docs(spark):
    rng = random.Random(12)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([1, 3, 20, 90]))), rng.choice(["a", "a", "a", "b", "c", None]), None) for i in range(300)]
    rows += [(None, "no id", "a", None)] * 3 + [(9, "twice here", "b", 1)] * 2 + [(4, "one more text of the id", "a", None), (400, None, "b", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, slot int").repartition(5).cache()


@pytest.mark.parametrize("bound", [100_000, 0])
def test_mixed_copies_follow_the_schedule(mix_docs, bound):
    counts = mixing.mixed_counts(mixing.materialise(mixing.sized(mix_docs), "t"), block=4)
    want = {(r.doc_id, r.row): r.n for r in counts.filter("taken > 0").groupBy("doc_id", "row").agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("n")).collect()}
    size = collections.Counter((r.doc_id, r.row) for r in counts.filter("size > 0").collect())
    mixed = mixing.mixed(mix_docs, block=4, bound=bound)
    got = collections.Counter((r.doc_id, r.row) for r in mixed.select("doc_id", F.xxhash64("doc_id", "text").alias("row")).collect())
    assert got == collections.Counter({k: n * size[k] for k, n in want.items() if n}) and mixed.columns == mix_docs.columns


def test_texts_of_the_mix_stay_in_place(mix_docs, capsys):
    mixing.mixed(mix_docs).explain()
    assert "Exchange hashpartitioning" not in capsys.readouterr().out


def test_slots_are_made_in_many_tasks(spark, monkeypatch, capsys):
    plan = spark.createDataFrame([("a", 0, 10 ** 6, 1e6, 400_000, 500_000, 0, mixing.POINTS)],
                                 "source string, source_no int, source_size long, target double, n_blocks long, n_slots long, low long, high long")
    monkeypatch.setattr(mixing, "SLICES_PER_TASK", 8)
    slots = mixing.schedule(plan)
    assert slots.count() == 500_000
    slots.explain()
    assert "Exchange hashpartitioning(slice" in (plan_text := capsys.readouterr().out) and ", 16), REPARTITION_BY_NUM" in plan_text
    assert mixing.schedule(plan, bound=0).groupBy("block").count().groupBy("count").count().count() <= 2


def test_blocked_hosts_beyond_the_bound(spark):
    rows = [(i, "x" if i % 3 else "good words " * 30, "bad" if i < 90 else "null" if i % 2 else None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    measured = quality.measured(docs)
    hosts = quality.host_verdicts(measured, "source")
    near, far = (sorted(quality.joined_verdicts(measured, hosts, "source", b).select("doc_id", "kept").collect()) for b in (200_000, 0))
    assert near == far and {r.doc_id for r in far if not r.kept} >= set(range(90))
    assert np.array([r.kept for r in far]).any() == any(not r.blocked for r in hosts.collect())
