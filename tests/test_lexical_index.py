"""The stored lexical index against the search that reads all texts."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from chatlake.operators import lexical_index as X
from chatlake.operators import retrieval as Q


@pytest.fixture(scope="module")
def chunks(spark):
    """Chunks of four vocabularies, common and rare words, an empty one and copies."""
    rng = random.Random(6)
    rows = []
    for i in range(600):
        kind = rng.randrange(4)
        words = [f"v{kind}w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.choice([3, 20, 80]))] + ["all"] * rng.randint(0, 3)
        rows.append((f"d{i % 500}", i // 500, " ".join(words) + f" rare{i % 97}"))
    rows += [("empty", 0, ""), ("none", 0, None)]
    return spark.createDataFrame(rows, "doc_id STRING, chunk_index INT, content STRING").repartition(4).cache()


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"v{i % 4}w{rng.randrange(60)}" for _ in range(rng.choice([1, 4, 12]))) + rng.choice(["", " all all", f" rare{i}"]), rng.choice([1, 3, 20])) for i in range(30)]
    return spark.createDataFrame([*rows, (98, "unknown words only", 5), (99, "", 5)], "query_id INT, search_text STRING, fetch_k INT")


@pytest.mark.parametrize("block", [4, 64])
def test_same_rows_as_the_full_search(spark, chunks, queries, tmp_path, block):
    index = X.build(chunks, str(tmp_path / "index"), buckets=16, block=block)
    got = X.bm25(queries, index, block=block)
    want = Q.lexical_search(queries, chunks)
    key = lambda rows: sorted((r.query_id, r.lexical_rank, r.doc_id, r.chunk_index, round(r.lexical, 8)) for r in rows.collect())
    assert key(got) == key(want) and got.count() > 100


def test_blocks_below_the_threshold_are_not_read(spark, chunks, queries, tmp_path, monkeypatch):
    index = X.build(chunks, str(tmp_path / "index"), buckets=16, block=4)
    read = []
    real = X.exact
    monkeypatch.setattr(X, "exact", lambda pairs, *rest: read.append(pairs.count()) or real(pairs, *rest))
    few = queries.where("fetch_k < 20 AND query_id < 90")
    X.bm25(few, index, block=4).count()
    terms, wanted = X.weighted_terms(few, index, "search_text")
    every = index.table("blocks", wanted).join(terms, ["bucket", "term"]).select("query_id", "block").distinct().count()
    assert sum(read) < 0.6 * every


def test_only_the_queries_buckets_are_read(spark, chunks, queries, tmp_path, capsys):
    """The plan reads postings, not texts, and only the partitions of the terms' buckets."""
    index = X.build(chunks, str(tmp_path / "index"), buckets=64)
    one = queries.where("query_id = 1").limit(1)
    _, wanted = X.weighted_terms(one, index, "search_text")
    assert 0 < len(wanted) < 20
    plan = X.bm25(one, index)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket#" in plan.replace("PartitionFilters: [isnotnull(bucket", "PartitionFilters: [bucket") and "content" not in plan
    files = index.table("postings", wanted).select(F.input_file_name().alias("f")).distinct()
    assert {int(r.f.split("bucket=")[1].split("/")[0]) for r in files.collect()} <= set(wanted)


def test_the_index_is_built_once_for_the_same_files(spark, chunks, tmp_path, monkeypatch):
    source = str(tmp_path / "chunks")
    chunks.write.parquet(source)
    built = []
    real = X.build
    monkeypatch.setattr(X, "build", lambda *a, **k: built.append(1) or real(*a, **k))
    first = X.stored(spark, source, spark.read.parquet(source))
    assert X.stored(spark, source, spark.read.parquet(source)).path == first.path and built == [1]
    chunks.limit(5).write.mode("append").parquet(source)
    assert X.stored(spark, source, spark.read.parquet(source)).path != first.path and built == [1, 1]


def test_no_posting_is_a_row_of_its_own(spark, chunks, queries, tmp_path):
    """What is stored and exchanged grows with blocks, not with postings; what is scored leaves its task as best rows only."""
    index = X.build(chunks, str(tmp_path / "index"), buckets=8, block=64)
    blocks = index.table("blocks")
    n_blocks = blocks.select("block").distinct().count()
    assert index.table("postings").count() <= 8 * n_blocks
    assert blocks.agg(F.sum("n")).first()[0] == Q.postings(Q.tokenised(chunks)).count()
    terms, wanted = X.weighted_terms(queries, index, "search_text")
    pairs = X.block_bounds(terms, wanted, index).select("query_id", "block")
    plan = X.exact(pairs, terms, wanted, index, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and X.exact(pairs.coalesce(1), terms, wanted, index, 2).coalesce(1).groupBy("query_id").count().count() == 30


def test_repeated_and_absent_keys(spark, tmp_path, monkeypatch):
    """Counts of rows of one key and length are added, other lengths stay apart; chunks without a key are counted, not found.

    What cannot travel must not matter where it lies in a module beside the helpers that do."""
    for module in (Q, X):
        monkeypatch.setattr(module, "lock", threading.RLock(), raising=False)
    rows = [("a", 0, "red blue"), ("a", 0, "red green"), ("a", 0, "red red red sky"), ("b", 0, "red sea"), ("c", 1, "sky sky sea"), (None, 0, "red red"),
            ("d", None, "blue sea"), ("e", 0, ""), ("f", 0, None), ("g", 2, "red red red red")]
    chunks = spark.createDataFrame(rows, "doc_id STRING, chunk_index INT, content STRING")
    queries = spark.createDataFrame([(1, "red sky", 5), (2, "sea blue blue", 2), (3, "nothing", 5), (None, "red", 5)],
                                    "query_id INT, search_text STRING, fetch_k INT")
    got = X.bm25(queries, X.build(chunks, str(tmp_path / "index"), buckets=4, block=2), block=2)
    tokens = Q.tokenised(chunks)
    index = Q.postings(tokens).where("doc_id IS NOT NULL AND chunk_index IS NOT NULL")
    want = Q.bm25(queries, index, Q.corpus_stats(tokens))
    key = lambda rows: sorted((r.query_id, r.lexical_rank, r.doc_id, r.chunk_index, round(r.lexical, 8)) for r in rows.collect())
    assert key(got) == key(want) and {r.doc_id for r in got.collect()} == {"a", "b", "c", "g"}


def test_batches_and_parts_do_not_show(spark, chunks, queries, tmp_path):
    """Blocks that go on in the next Arrow batch, and more query terms than travel at once."""
    want = Q.lexical_search(queries, chunks)
    key = lambda rows: sorted((r.query_id, r.lexical_rank, r.doc_id, r.chunk_index, round(r.lexical, 8)) for r in rows.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        index = X.build(chunks, str(tmp_path / "index"), buckets=4, block=16)
        got = key(X.bm25(queries, index, block=16, bound=60))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == key(want)
