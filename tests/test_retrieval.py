import random

import numpy as np
from pyspark.sql import functions as F

from chatlake.operators import retrieval as Q
from chatlake.plans import hybrid


def test_blocks_give_the_same_neighbours_as_one_matrix(spark):
    rng = np.random.default_rng(1)
    vs = rng.normal(size=(200, 6)).astype("float32")
    vs[7] = 0
    qs = rng.normal(size=(9, 5)).astype("float32")
    qs[2] = 0
    v = spark.createDataFrame([(f"d{i}", i % 3, x.tolist()) for i, x in enumerate(vs)], "doc_id STRING, chunk_index INT, vector ARRAY<FLOAT>").repartition(4)
    q = spark.createDataFrame([(i, x.tolist(), 4 + i) for i, x in enumerate(qs)], "query_id INT, vector ARRAY<FLOAT>, fetch_k INT")
    one = {(r.query_id, r.doc_id, r.cosine_rank) for r in Q.dense_topk(q, v, size=6).collect()}
    many = {(r.query_id, r.doc_id, r.cosine_rank) for r in Q.dense_topk(q, v, size=6, block=2).collect()}
    want = set()
    for i, x in enumerate(qs.astype(float)):
        x = np.append(x, 0)
        if not x.any():
            continue
        w = vs.astype(float)
        n = np.linalg.norm(w, axis=1)
        s = w @ x / (np.where(n == 0, 1e-12, n) * np.linalg.norm(x))
        order = sorted(range(200), key=lambda j: (-round(s[j], 9), f"d{j}"))[:4 + i]
        want |= {(i, f"d{j}", r) for r, j in enumerate(order, 1)}
    assert one == want and many == want


def test_diverse_matches_repeated_picking(spark):
    rng = random.Random(4)
    rows = [(q, f"d{rng.randint(0, 4)}", c, round(rng.random(), 2)) for q in range(12) for c in range(14)]
    df = spark.createDataFrame(rows, "query_id INT, doc_id STRING, chunk_index INT, score DOUBLE")
    got = {}
    for r in Q.diverse(df, 5).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.chunk_index))
    for q in range(12):
        left = sorted([r for r in rows if r[0] == q], key=lambda r: (-r[3], r[1], r[2]))
        taken, out = {}, []
        while len(out) < 5:
            open_ = [r for r in left if taken.get(r[1], 0) < 2]
            if not open_:
                break
            best = max(open_, key=lambda r: (round(r[3] - 0.08 * taken.get(r[1], 0), 9), -left.index(r)))
            out.append((best[1], best[2]))
            taken[best[1]] = taken.get(best[1], 0) + 1
            left.remove(best)
        assert got[q] == out


def test_context_budget_keeps_the_first_line(spark):
    df = spark.createDataFrame([(1, 1, "x" * 50), (1, 2, "y"), (2, 1, "a" * 4), (2, 2, "b" * 4), (2, 3, "c")], "query_id INT, position INT, line STRING")
    assert sorted((r.query_id, r.position) for r in Q.context_budget(df, "line", 10).collect()) == [(1, 1), (2, 1), (2, 2)]


def corpus(spark):
    rows = [("a", "relapse.md", 0, "coping plan for craving and relapse prevention at home", 1.10), ("b", "general.md", 0, "craving and relapse are words in this text too", 1.0),
            ("c", "other.md", 0, "gardening in spring with tomatoes and beans and peas", 1.0)]
    df = spark.createDataFrame(rows, "doc_id STRING, doc_name STRING, chunk_index INT, content STRING, w DOUBLE")
    none = F.lit(None)
    return df.select("doc_id", "doc_name", "chunk_index", "content", F.struct(
        none.cast("string").alias("source_path"), F.lit("").alias("section_title"), none.cast("int").alias("page_start"), none.cast("int").alias("page_end"),
        F.lit("en").alias("language"), F.lit(20).alias("token_count"), F.lit("general").alias("topic"), F.lit("k").alias("source_kind"), F.col("w").alias("source_weight")).alias("metadata"))


def test_lexical_leg_alone_and_blank_questions(spark):
    q = spark.createDataFrame([(1, "please craving relapse"), (2, "   "), (3, "zzzz")], "query_id INT, question STRING")
    rows = hybrid.search(q, corpus(spark), None, None, top_k=2).orderBy("query_id", "position").collect()
    assert [(r.query_id, r.doc_id) for r in rows] == [(1, "a"), (1, "b")]
    assert rows[0].line.startswith("[1] source: relapse.md (score=") and rows[0].dense_score == 0.0
    text = Q.contexts(hybrid.search(q, corpus(spark), None, None, top_k=2)).first().context
    assert text == rows[0].line + "\n\n" + rows[1].line


def test_embedding_cache(spark):
    t = spark.createDataFrame([(1, " x "), (2, "x"), (3, ""), (4, "y")], "i INT, text STRING")
    inputs = Q.embedding_inputs(t, "text", size=3)
    key = inputs.where("i = 1").first().cache_key
    cache = spark.createDataFrame([(key, [1.0, 2.0])], "cache_key STRING, vector ARRAY<FLOAT>")
    assert [r.input for r in Q.missing_embeddings(inputs, cache).collect()] == ["y"]
    got = {r.i: r.vector for r in Q.with_embeddings(inputs, cache, size=3).collect()}
    assert got == {1: [1.0, 2.0, 0.0], 2: [1.0, 2.0, 0.0], 3: [0.0, 0.0, 0.0], 4: None}


def test_a_task_sends_on_no_more_than_k_rows_of_a_query(spark, monkeypatch):
    """However many batches a task reads, its list of the best is one; small tiles change nothing."""
    rng = np.random.default_rng(5)
    vs = np.round(rng.normal(size=(3000, 3)), 1).astype("float32")  # many equal scores
    v = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(vs)], "doc_id INT, chunk_index INT, vector ARRAY<FLOAT>").repartition(4)
    q = spark.createDataFrame([(i, x.tolist(), 5) for i, x in enumerate(rng.normal(size=(7, 3)))], "query_id INT, vector ARRAY<FLOAT>, k INT")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        sent = Q._dense_by_matrix(q, v, "query_id int, doc_id int, chunk_index int, cosine double").groupBy("query_id", F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(sent) == 28 and all(r["count"] == 5 for r in sent)
    import pandas as pd
    matrix = Q._Matrix.of(q.toPandas())
    frame = pd.DataFrame({"doc_id": range(3000), "chunk_index": 0, "vector": list(vs)})
    results = []
    for rows, queries in ((2048, 512), (64, 2)):
        monkeypatch.setattr(Q, "TILE_ROWS", rows)
        monkeypatch.setattr(Q, "TILE_QUERIES", queries)
        best = Q._Best(matrix)
        best.add(frame)
        results.append(best.result().reset_index(drop=True))
    assert results[0].equals(results[1])


def test_lexical_search_moves_no_texts_and_agrees_with_the_exchange(spark, monkeypatch):
    """Scored where the chunks are read: the rows of the join, Thai text and absent texts included; a task sends on k rows of a query at most."""
    rng = random.Random(11)
    words = [f"w{min(rng.randrange(80), rng.randrange(80))}" for _ in range(6000)]
    rows = [(f"d{i % 300}", i // 300, " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 9, 60])))) for i in range(700)]
    rows += [("th", 0, "ความอยากและการเลิกยา w1"), ("none", 0, None), (None, 0, "w1 w2"), (None, 0, "w2 w3")]
    rows += [*rows[:40], ("d3", 0, "w1 w1 w2 w5"), ("d4", 1, "w1")]  # keys that occur again, with the same and other texts
    chunks = spark.createDataFrame(rows, "doc_id STRING, chunk_index INT, content STRING").repartition(5)
    asked = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 6, 30]))), rng.choice([1, 4, 20])) for i in range(25)]
    queries = spark.createDataFrame([*asked, (50, "ความอยาก", 3), (51, "nothing here", 3), (52, "", 3)], "query_id INT, search_text STRING, fetch_k INT")
    key = lambda frame: sorted((r.query_id, r.lexical_rank, r.doc_id, r.chunk_index, round(r.lexical, 8)) for r in frame.collect())
    want = key(Q.lexical_search(queries, chunks, bound=0))
    whole = Q.lexical_search(queries, chunks)
    assert key(whole) == want and len(want) > 100
    assert "content" not in whole._jdf.queryExecution().executedPlan().toString()
    for name in ("TILE_CELLS", "TILE_ROWS"):
        monkeypatch.setattr(Q, name, 7)
    pairs = np.array([0, 0, 1, 2, 2]), np.array([0, 1, 1, 0, 2]), np.array([1.0, 2, 3, 4, 5])
    got = Q.weighted_sums(*pairs, 3, 2, np.array([0, 2, 3, 3]), np.array([0, 1, 1]), np.array([10.0, 100, 1000]))
    assert got.tolist() == [[10, 2100], [0, 3000], [40, 400]]
