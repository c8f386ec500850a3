"""Toxicity by logistic regression over hashed word n-grams and skip-grams, fitted with FTRL-proximal.

Features of a text are which words, pairs of neighbours and pairs with one word between occur in it (words lower-cased and stripped
of punctuation at their ends), hashed to 2^20 places. FTRL-proximal keeps a learning rate per coordinate, and its L1 penalty leaves
most weights at exactly zero, so the model is a short list whatever the corpus.

The model is fitted on at most ``MAX_ROWS`` labelled rows, those with the smallest hash of their id, in that order, in one task:
this bound is a parameter. Scores cover every row. Null and empty texts have no features and get the score of the bias. Without a
labelled row all scores are 0.5. Rows without an id or label are not learned from; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import gram_hashes, id_share, mixed, read, steps, utf8, word_hashes, word_spans
from chatlake.llm.registry import query

BITS = 20
MAX_ROWS = 20_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 1.0
EPOCHS = 4
THRESHOLD = 0.3


def plain_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, without ASCII punctuation at their ends; words per text as first positions."""
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    solid = (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    starts, ends, first = word_spans(raw, offsets)
    places = np.flatnonzero(solid)
    begin = np.searchsorted(places, starts)
    stop = np.searchsorted(places, ends)
    full = stop > begin
    lo = np.where(full, places[np.minimum(begin, max(len(places) - 1, 0))] if len(places) else 0, starts)
    hi = np.where(full, (places[np.maximum(stop - 1, 0)] if len(places) else 0) + 1, ends)
    return word_hashes(low, lo, hi), first


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and place of each feature occurrence, repeats included."""
    hashes, first = plain_words(raw, offsets)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shift = np.uint64(64 - bits)
    docs, places = [doc], [mixed(hashes + np.uint64(1)) >> shift]
    if len(hashes) > 1:
        same = doc[1:] == doc[:-1]
        docs.append(doc[1:][same])
        places.append((gram_hashes(hashes, 2) >> shift)[same])
    if len(hashes) > 2:
        same = doc[2:] == doc[:-2]
        docs.append(doc[2:][same])
        places.append((mixed(hashes[:-2] * np.uint64(0x9FB21C651E98DF25) + hashes[2:]) >> shift)[same])
    return np.concatenate(docs), np.concatenate(places).astype(np.int64)


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate FTRL-proximal; place 2^bits is the bias, which has no penalty."""

    def __init__(self, bits: int = BITS) -> None:
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


def example_lists(labelled: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id``, ``label``, ``_order`` and the distinct feature places (``at``, 32-bit integers) of each labelled row, made where its text is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            doc, place = features(*utf8(step["text"]), bits)
            pairs = np.unique(doc << (bits + 1) | place)
            cuts = np.searchsorted(pairs >> (bits + 1), np.arange(step.num_rows + 1))
            places = (pairs & ((1 << (bits + 1)) - 1)).astype("<u4")
            lists = [places[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([step["doc_id"], step["label"], step["_order"], pa.array(lists, pa.binary())], ["doc_id", "label", "_order", "at"])

    kinds = {f.name: f.dataType.simpleString() for f in labelled.schema.fields}
    return labelled.select("doc_id", "label", "_order", "text").mapInArrow(
        run, f"doc_id {kinds['doc_id']}, label {kinds['label']}, _order long, at binary")


def fitted(labelled: DataFrame, rows: int = MAX_ROWS, bits: int = BITS, epochs: int = EPOCHS) -> DataFrame:
    """``place`` and ``weight`` of all weights that are not zero, from ``doc_id``, ``text`` and ``label`` (0 or 1).

    The ``rows`` labelled rows of the smallest hashes are learnt from, in that order. Their lists of feature places, at most 2^bits numbers
    each whatever the text's length, meet in one task; texts do not.
    """
    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_order", "doc_id", "at", "label"], na_position="first")
        model = Ftrl(bits)
        examples = [(np.append(np.frombuffer(x, "<u4"), 1 << bits).astype(np.int32), float(label)) for x, label in zip(frame["at"], frame["label"], strict=True)]
        for _ in range(epochs):
            for at, label in examples:
                model.learn(at, label)
        every = np.arange(len(model.z))
        w = model.weights(every)
        return pd.DataFrame({"place": every[w != 0], "weight": w[w != 0]})

    known = labelled.filter("doc_id IS NOT NULL AND label IS NOT NULL").select(
        "doc_id", "text", "label", F.xxhash64(F.col("doc_id").cast("string")).alias("_order"))
    chosen = example_lists(known, bits).orderBy("_order", "doc_id", "at", "label").limit(rows)
    return chosen.groupBy(F.lit(0).alias("_one")).applyInPandas(learn, "place long, weight double")


def scored(docs: DataFrame, model: DataFrame, keep: tuple[str, ...] = ("doc_id",), bits: int = BITS) -> DataFrame:
    """``keep`` and ``score`` of every row. The weights, at most 2^bits + 1, are collected and sent to the tasks."""
    rows = model.toPandas()
    weights = np.zeros((1 << bits) + 1, np.float32)
    weights[rows["place"].to_numpy(np.int64)] = rows["weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            doc, place = features(*utf8(step["text"]), bits)
            used = weights[place] != 0
            pairs = np.unique(doc[used] << (bits + 1) | place[used])
            total = np.bincount(pairs >> (bits + 1), weights[pairs & ((1 << (bits + 1)) - 1)], minlength=step.num_rows)
            yield pa.RecordBatch.from_arrays([*[step[k] for k in keep], pa.array(sigmoid(total + weights[-1]))], [*keep, "score"])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, score double")


@query()
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    share = F.coalesce(id_share(F.col("doc_id"), 4), F.lit(2))
    labels = read(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label")).filter(share != 2)
    # The labelled rows with the smallest hashes are chosen before their texts are fetched.
    chosen = labels.filter("label IS NOT NULL").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "label").limit(MAX_ROWS)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return scored(docs, fitted(labelled)).select(
        "doc_id", (share == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
