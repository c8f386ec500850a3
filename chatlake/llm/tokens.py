"""Token counts by section: each document is encoded once, and its tokens' character spans are joined to its sections.

A section runs from its start to the next one's. A token belongs to the section that holds it. A token that crosses a boundary
belongs, by rule, to the section of its first character ("first"), of its last ("last"), or to the one with most of its
characters, ties to the earlier ("most"). A token that holds part of a character has that character's span.

A null text is empty. An empty text has one empty section with no token. Repeated rows are counted one by one. An empty table
gives no rows. All positions are code points. Columns other than those named are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import read, steps, utf8
from chatlake.llm.encoding import STEP, encoder
from chatlake.llm.registry import query

RULES = ("first", "last", "most")
SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def joined_fields(docs: DataFrame, fields: list[str]) -> DataFrame:
    """``doc_id``, ``text`` and ``starts`` for fields written one after another, each on a line of its own; null is empty."""
    values = F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    starts = F.transform(F.sequence(F.lit(0), F.lit(len(fields) - 1)), lambda i: F.aggregate(
        F.slice(values, 1, i), F.lit(0), lambda acc, x: acc + F.length(x) + 1))
    return docs.select("doc_id", F.array_join(values, "\n").alias("text"), starts.alias("starts"))


def attributed(rows: DataFrame, path: str, rule: str = "most") -> DataFrame:
    """Tokens of each section of ``doc_id``, ``text`` and, as ascending code points from 0, ``starts``.

    Without ``starts`` the lines are the sections, found with the tokens.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    given = "starts" in rows.columns
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for step in steps(batches, limit=STEP):
            raw, offsets = utf8(step["text"])
            ids, first = own.ids(step["text"])
            lead = (raw & 0xC0) != 0x80
            char = np.cumsum(lead) - 1  # number of each byte's character among all texts
            chars = np.append(char, char[-1] + 1 if len(char) else 0)[offsets]
            ends = np.cumsum(own.sizes[ids])
            begins = ends - own.sizes[ids]
            token_start, token_last = char[begins], char[ends - 1]
            if given:
                lists = step["starts"]
                counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                within = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(step.num_rows), counts)
                starts = within + chars[:-1][doc]
            else:
                feeds = np.flatnonzero(raw == 10)
                owner = np.searchsorted(offsets, feeds, side="right") - 1
                counts = np.bincount(owner, minlength=step.num_rows) + 1
                doc = np.repeat(np.arange(step.num_rows), counts)
                begin = np.cumsum(counts) - counts
                starts = np.empty(len(doc), np.int64)
                starts[begin] = chars[:-1]
                inner = np.ones(len(doc), bool)
                inner[begin] = False
                starts[inner] = char[feeds] + 1
            # Sections that are empty or start with the next document share a start: the last one with it holds the character.
            a = np.searchsorted(starts, token_start, side="right") - 1
            b = np.searchsorted(starts, token_last, side="right") - 1
            crossing = np.flatnonzero(a != b)
            to = b.copy() if rule == "last" else a.copy()
            if rule == "most":
                for t in crossing:
                    edges = np.clip(np.append(starts[a[t]:b[t] + 1], token_last[t] + 1), token_start[t], token_last[t] + 1)
                    to[t] = a[t] + int(np.argmax(np.diff(edges)))
            total = np.bincount(to, minlength=len(starts))
            crossed = np.bincount(to[crossing], minlength=len(starts))
            base = chars[:-1][doc]
            stop = np.append(starts[1:], chars[-1])
            last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
            stop[last] = chars[1:][doc[last]]
            section = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays([
                step["doc_id"].take(pa.array(doc)), pa.array(section.astype(np.int32)), pa.array(starts - base), pa.array(stop - base),
                pa.array(total), pa.array(crossed)], names)

    return rows.select("doc_id", "text", *(["starts"] if given else [])).mapInArrow(run, SCHEMA)


@query()
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return attributed(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
