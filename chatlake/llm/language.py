"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (one to three characters, letters in lower case, all else as one space) in order
of frequency, ties by n-gram. A document's distance to a language is the sum over the document's profile of how far each n-gram is
out of place in the language's profile; an n-gram that is not in it counts as the profile's length. The nearest language wins,
ties by name.

Null texts, texts without a letter and texts judged without any learned language give ``und`` and score 0. Rows without an id are
held out. Repeated rows count as often as they occur. Languages are few by nature: the profiles have at most ``SIZE`` rows for each
of at most ``MAX_LANGUAGES`` languages, else ``ValueError``; they alone reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.llm.common import id_share, read, steps
from chatlake.llm.registry import query

SIZE = 400
MAX_LANGUAGES = 2000
UNKNOWN = "und"
_SPACE = 32


class Letters:
    """Lower-case letters keep their code point; everything else is a space."""

    def __init__(self) -> None:
        codes = np.full(0x110000, _SPACE, np.int64)
        for c in range(0x110000):
            if chr(c).isalpha():
                codes[c] = c
        self.codes = codes

    def of(self, text: str) -> np.ndarray:
        codes = self.codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
        return codes[keep]


_LETTERS: list[Letters] = []


def letters() -> Letters:
    if not _LETTERS:
        _LETTERS.append(Letters())
    return _LETTERS[0]


def grams(codes: np.ndarray) -> np.ndarray:
    """All n-grams of one to three characters as integers; single spaces and pairs of spaces do not occur as such."""
    padded = np.concatenate(([_SPACE], codes, [_SPACE]))
    two = padded[:-1] << 21 | padded[1:]
    three = two[:-1] << 21 | padded[2:]
    return np.concatenate((codes[codes != _SPACE], two, three))


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per step and language, how often each n-gram occurs."""
    own = letters()
    for step in steps(batches):
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(step["lang"].to_pylist(), step["text"].to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            found, n = np.unique(np.concatenate([grams(own.of(t)) for t in texts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found), pa.array(n)], ["lang", "gram", "n"])


def profiles(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``lang``, ``gram`` and ``rank`` (from 0) of each language's most frequent n-grams."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counts = known.mapInArrow(gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # A filter on the row number itself lets each task drop n-grams beyond the first ``size`` before languages meet.
    ranked = counts.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= size)
    return ranked.select("lang", "gram", (F.col("place") - 1).alias("rank"))


class Model:
    """All profiles as one matrix: out-of-place ranks of known n-grams by language."""

    def __init__(self, rows: list, size: int) -> None:
        self.size, self.langs = size, sorted({r["lang"] for r in rows})
        if len(self.langs) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        self.grams = np.array(sorted({r["gram"] for r in rows}), np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        column = {x: i for i, x in enumerate(self.langs)}
        for r in rows:
            self.ranks[np.searchsorted(self.grams, r["gram"]), column[r["lang"]]] = r["rank"]

    def predict(self, codes: np.ndarray) -> tuple[str, float]:
        """The nearest language, and by how much it is nearer than the next as a share of that one's distance."""
        found, n = np.unique(grams(codes), return_counts=True)
        best = np.lexsort((found, -n))[:self.size]
        at = np.searchsorted(self.grams, found[best])
        at[at < len(self.grams)] = np.where(self.grams[at[at < len(self.grams)]] == found[best][at < len(self.grams)],
                                            at[at < len(self.grams)], len(self.grams))
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(best), dtype=np.int32)[:, None])).sum(axis=0)
        first = int(np.argmin(away))
        rest = np.delete(away, first)
        other = int(rest.min()) if len(rest) else self.size * len(best)
        return self.langs[first], float(1 - away[first] / other) if other else 0.0


def predicted(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` of every row; only the text is looked at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = letters()
        for step in steps(batches):
            langs, scores = [], []
            for text in step["text"].to_pylist():
                codes = own.of(text or "")
                lang, score = model.predict(codes) if model.langs and (codes != _SPACE).any() else (UNKNOWN, 0.0)
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*[step[k] for k in keep], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, lang_pred string, score double")


def learned(docs: DataFrame, size: int = SIZE) -> Model:
    return Model(profiles(docs, size).collect(), size)


@query()
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    share = F.coalesce(id_share(F.col("doc_id"), 5), F.lit(0))
    model = learned(docs.filter(share != 0))
    return predicted(docs, model).select("doc_id", (share == 0).alias("held_out"), "lang_pred", "score")
