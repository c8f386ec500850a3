"""Cheapest repair of a conversation's role order, by an auction for the shortest path in a lattice of whole-number costs.

A conversation must read as an optional system turn and then pairs of user and assistant, or be empty. A node of the lattice is (rows used, what
was written last: nothing, system, user, assistant). Arcs keep (0), rerole (2) or delete (3) the next row or insert a turn (2); a row that ends
without a full stop, question or exclamation mark costs 1 more unless deleted, a blank or repeated row must be deleted.

The auction holds a price for each node, at most the cost of any arc plus the price behind it, and a path. Where the path's end can be
priced higher, it is, and the path contracts by that node; else the path extends along the arc that gives its price. On arrival the price of
the start is the least cost. Rows are taken in blocks from the last to the first, so a path never runs further than to nodes whose price is
already the exact cost to the end. Arcs whose cost is the difference of their prices are tight: every cheapest repair is a path of tight arcs,
and the one whose letters are least is traced from the start over nodes from which tight arcs reach the end.

One shuffle deals the rows by conversation. Each conversation passes a task twice in one sorted stream, first as one code per
row, then with its texts, which are hashed as they pass: a task holds a few numbers for each row of one conversation, never its texts.

Null role and text count as one space, a null id or turn as one space in the damage's key. A null id is one conversation. Rows of equal turn
are ordered by role, then text. Repeated rows are damaged alike and stay. Roles count by their first character, so the empty role has none and
fits nowhere. Conversations that lose all rows give zeros. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.llm.common import read
from chatlake.llm.registry import query

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
#: Rows of one block of the auction.
BLOCK = 16
#: Repairs of conversations up to this many rows are remembered by their codes, this many of them.
SHORT, REMEMBERED = 32, 1 << 15
START, SYSTEM, USER, ASSISTANT = range(4)
LETTERS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Columns that the stream reads.
_STREAM = ["conv_id", "phase", "initial", "fault", "turn", "line", "role", "text"]
_OUT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def after(last: int) -> int:
    """What an inserted or reroled turn must be."""
    return ASSISTANT if last == USER else USER


def arcs(row: tuple[str, str] | None, last: int) -> list[tuple[str, int, int, int]]:
    """(letter, rows used, next last, cost) of the arcs from a node before ``row`` (initial, fault), in the letters' order."""
    out = [] if row is None else [("D", 1, last, DELETE)]
    out.append(("I", 0, after(last), INSERT))
    if row is not None and row[1] not in ("b", "d"):
        more = UNFINISHED if row[1] == "t" else 0
        kept = LETTERS.get(row[0])
        if kept == after(last) or (kept == SYSTEM and last == START):
            out.append(("K", 1, kept, KEEP + more))
        out.append(("R", 1, after(last), REROLE + more))
    return out


class Auction:
    """Prices of all nodes of one conversation."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.rows = rows
        n = len(rows)
        self.price = [[0] * 4 for _ in range(n + 1)]
        exact: set[tuple[int, int]] = set()
        # After the last row, nothing more is due where nothing was written or a pair is closed; these are the path's destinations.
        self.ends = {(n, START), (n, ASSISTANT)}
        exact |= self.ends
        for first in range((n // BLOCK) * BLOCK, -1, -BLOCK):
            solved = {(first, last) for last in range(4)}
            for node in sorted(solved - self.ends):
                self._walk(node, exact)
            exact = solved

    def out_of(self, node: tuple[int, int]) -> list[tuple[str, tuple[int, int], int]]:
        at, last = node
        row = self.rows[at] if at < len(self.rows) else None
        return [(letter, (at + used, to), cost) for letter, used, to, cost in arcs(row, last)]

    def _walk(self, origin: tuple[int, int], exact: set[tuple[int, int]]) -> None:
        path = [origin]
        while path[-1] not in exact:
            node = path[-1]
            best, ahead = min((cost + self.price[to[0]][to[1]], to) for _, to, cost in self.out_of(node))
            if self.price[node[0]][node[1]] < best:
                self.price[node[0]][node[1]] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(ahead)

    def tight(self, node: tuple[int, int]) -> list[tuple[str, tuple[int, int]]]:
        here = self.price[node[0]][node[1]]
        return [(letter, to) for letter, to, cost in self.out_of(node) if here == cost + self.price[to[0]][to[1]]]

    def trace(self) -> str:
        """The least letters of a path of tight arcs from the start to an end."""
        open_ = [[False] * 4 for _ in self.price]
        for at, last in self.ends:
            open_[at][last] = True
        for at in range(len(self.rows), -1, -1):
            for _ in range(3):  # inserting goes on within a column
                for last in range(4):
                    open_[at][last] = open_[at][last] or any(open_[to[0]][to[1]] for _, to in self.tight((at, last)))
        node, letters = (0, START), []
        while node not in self.ends:
            letter, node = next((letter, to) for letter, to in self.tight(node) if open_[to[0]][to[1]])
            letters.append(letter)
        return "".join(letters)


@lru_cache(REMEMBERED)
def _remembered(rows: tuple[tuple[str, str], ...]) -> tuple[int, str]:
    auction = Auction(list(rows))
    return auction.price[0][START], auction.trace()


def repaired(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """Cost and letters of the cheapest repair of rows of (initial, fault); fault is b, d, t or nothing."""
    if len(rows) <= SHORT:
        return _remembered(tuple((r if r in LETTERS else "", fault) for r, fault in rows))
    auction = Auction(rows)
    return auction.price[0][START], auction.trace()


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``gone``, the rows as the contract damages them; dropped rows are kept, marked."""
    named = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    dealt = named.withColumn("kind", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return dealt.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(times).alias("copy")).drop("copy")


def unchanged(rows: DataFrame) -> DataFrame:
    """Rows of conversations as they are, in the form of ``damaged``."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("gone"))


def ending(text: Column) -> Column:
    """The last character that is no white space; empty where there is none."""
    return F.right(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit(1))


def streamed(rows: DataFrame) -> DataFrame:
    """Each row twice, as a code and with its text, sorted so that all codes of a conversation come before its texts."""
    dealt = rows.repartition("conv_id")
    # Both windows and the sort keep the partitioning by conversation, so nothing moves again.
    order = [F.col("gone"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(*order[:2])) > 1
    line = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    last = ending(F.col("text"))
    fault = F.when(last == "", "b").when(F.col("again"), "d").when(~last.isin(".", "!", "?"), "t").otherwise("")
    coded = dealt.withColumn("again", again).withColumn("line", line).withColumn("fault", F.when(F.col("gone"), "g").otherwise(fault))
    once = lambda phase, c: F.when(F.col("phase") == phase, F.col(c)).alias(c)
    both = coded.withColumn("initial", F.left("role", F.lit(1))).withColumn("phase", F.explode(F.array(F.lit(0), F.lit(1))))
    kept = both.filter((F.col("phase") == 0) | ~F.col("gone"))
    return kept.select("conv_id", "phase", once(0, "initial"), once(0, "fault"), "turn", "line", once(1, "role"), once(1, "text")).sortWithinPartitions(
        F.asc_nulls_first("conv_id"), "phase", "line")


class Conversation:
    """What is known of one conversation while its rows pass."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []
        self.counts = dict.fromkeys("bdt", 0)
        self.illegal = self.turns = 0
        self.low = self.high = None
        self.at = self.cost = 0
        self.audit: str | None = None
        self.last = START
        self.digest, self.empty = hashlib.sha256(), True

    def code(self, initial: str, fault: str, turn: int | None) -> None:
        if fault == "g":
            return
        if self.rows and self.rows[-1][0] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.rows.append((initial, fault))
        if fault:
            self.counts[fault] += 1
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = (turn if self.low is None else self.low), turn

    def solve(self) -> None:
        if self.audit is None:
            self.cost, self.audit = repaired(self.rows)

    def _written(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.last = after(self.last)
            self._written(("user", "assistant")[self.last == ASSISTANT], "")
            self.at += 1

    def text(self, role: str, text: str) -> None:
        self.solve()
        self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.last = LETTERS[role[0]]
            self._written(role, text)
        elif letter == "R":
            self.last = after(self.last)
            self._written(("user", "assistant")[self.last == ASSISTANT], text)

    def result(self) -> tuple:
        self.solve()
        self._inserted()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *(self.counts[c] for c in "bdt"), self.illegal, self.cost, self.audit, self.digest.hexdigest())


def structure(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``conv_id``, ``turn``, ``role``, ``text`` and ``gone``: counts, cost, audit and digest."""
    names = ["conv_id", *[x.split()[0] for x in _OUT.split(", ")]]
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        key, open_, out = none, Conversation(), []

        def table(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind)] + [
                pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)], names)

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            values = zip(*(batch[c].to_pylist() for c in _STREAM), strict=True)
            for conv, part in groupby(values, key=lambda v: v[0]):
                if key is none or conv != key:
                    if key is not none:
                        out.append((key, *open_.result()))
                    key, open_ = conv, Conversation()
                for _, phase, initial, fault, turn, _, role, text in part:
                    if phase == 0:
                        open_.code(initial, fault, turn)
                    else:
                        open_.text(role, text)
            if len(out) >= 4096:
                yield table(out)
                out = []
        if key is not none:
            yield table([*out, (key, *open_.result())])

    return streamed(rows).mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_OUT}")


@query()
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return structure(damaged(read(spark, folder, "conversations")))
