"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from chatlake.llm import repair

FORM = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, phase int, line string, gone int, initial string"


def followers(last):
    return "a" if last == "u" else "u"


def plain_repair(rows):
    """Least (cost, letters) by Dijkstra over (rows used, what was written), comparing the letters themselves."""
    heap, done = [(0, "", 0, "", 0)], set()
    while heap:
        cost, letters, i, last, written = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, letters
        push = lambda c, letter, j, to: heapq.heappush(heap, (cost + c, letters + letter, j, to, written + 1))
        push(2, "I", i, followers(last))
        if i < len(rows):
            initial, fault = rows[i]
            push(3, "D", i + 1, last)
            if fault not in ("b", "d"):
                extra = 1 if fault == "t" else 0
                if (initial == followers(last) and initial in "ua") or (initial == "s" and last == ""):
                    push(extra, "K", i + 1, initial)
                push(2 + extra, "R", i + 1, followers(last))


def every_repair(rows, most):
    """Least (cost, letters) over all strings of edits up to a length, by the definition."""
    best = None
    for size in range(most + 1):
        for letters in itertools.product("DIKR", repeat=size):
            if sum(x != "I" for x in letters) != len(rows):
                continue
            outs, cost, i = [""], 0, 0
            for x in letters:
                if x == "I":
                    outs, cost = [o + c for o in outs for c in "ua"], cost + 2
                    continue
                initial, fault = rows[i]
                i += 1
                if x == "D":
                    cost += 3
                    continue
                if fault in ("b", "d"):
                    outs = []
                cost += (fault == "t") + (2 if x == "R" else 0)
                outs = [o + c for o in outs for c in (initial if x == "K" and initial else "#" if x == "K" else "ua")]
            if any(FORM.fullmatch(o) for o in outs) and (best is None or (cost, "".join(letters)) < best):
                best = cost, "".join(letters)
    return best


def test_auction_against_all_edits():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "x", ""]), rng.choice(["", "", "", "t", "b", "d"])) for _ in range(rng.randint(0, 4))]
        assert repair.repaired(rows) == every_repair(rows, len(rows) + 3) == plain_repair(rows), rows


@pytest.mark.parametrize("size", [5, 20, repair.SHORT + 1, 120])
def test_auction_against_dijkstra(size):
    rng = random.Random(size)
    for _ in range(10):
        rows = [(rng.choice("suauaua "), rng.choice(["", "", "", "", "t", "b", "d"])) for _ in range(rng.randint(max(0, size - 9), size))]
        assert repair.repaired(rows) == plain_repair(rows), rows


def test_prices_are_feasible():
    """No price exceeds an arc's cost plus the price behind it, and the start's is the least cost."""
    rows = [("u", ""), ("u", "t"), ("a", "b"), ("s", ""), ("a", ""), ("a", "d"), ("u", "")] * 9
    auction = repair.Auction(rows)
    for node in itertools.product(range(len(rows) + 1), range(4)):
        assert node in auction.ends or all(auction.price[node[0]][node[1]] <= cost + auction.price[to[0]][to[1]] for _, to, cost in auction.out_of(node))
    assert auction.price[0][0] == plain_repair(rows)[0]


def plain_rows(table):
    """The contract in plain Python."""
    by = {}
    for conv, turn, role, text in table:
        by.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, coded = set(), []
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            coded.append((role[:1], fault))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        cost, audit = plain_repair(coded)
        lines, last, i = [], "", 0
        for x in audit:
            if x == "I":
                last = followers(last)
                lines.append({"u": "user:", "a": "assistant:"}[last])
                continue
            _, role, text = rows[i]
            i += 1
            if x == "K":
                last = role[0]
                lines.append(f"{role}:{text}")
            elif x == "R":
                last = followers(last)
                lines.append({"u": "user:", "a": "assistant:"}[last] + text)
        counts = [sum(c[1] == x for c in coded) for x in "bdt"]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_rows(spark, monkeypatch):
    rng = random.Random(11)
    table = []
    texts = ["Yes.", "No", "What?", "", " \n", "é🙂!", "a.b.c", "Long. " * 3000, "line\x0b.\r\n", "same", "same", None]
    for conv in [*range(150), None]:
        turns = list(range(rng.choice([1, 1, 2, 5, 9, 40])))
        for turn in turns:
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]) if rng.random() < .4 else ("user", "assistant")[turn % 2]
            table.append((conv, rng.choice([turn, turn, turn, turn, turn + 3, None]), role, rng.choice(texts)))
    table += table[10:14]
    frame = spark.createDataFrame([(*r, 1, "x", 2, None) for r in table], SCHEMA).repartition(6)
    monkeypatch.setattr(repair, "read", lambda *_: frame)
    got = repair.op12_conversation_repair(spark, "")
    assert sorted(map(tuple, got.collect()), key=str) == plain_rows(table)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert repair.structure(repair.damaged(frame.limit(0))).count() == 0


def test_long_conversation_and_one_shuffle(spark, capsys):
    frame = spark.range(6_000).selectExpr("7L AS conv_id", "id AS turn", "IF(id % 2 = 0 OR id % 977 = 5, 'user', 'assistant') AS role", "'Text number ' || id || '.' AS text")
    frame = repair.structure(repair.unchanged(frame))
    row = frame.first()
    rows = [("u" if i % 2 == 0 or i % 977 == 5 else "a", "") for i in range(6_000)]
    assert (row["cost"], row["audit"]) == plain_repair(rows)
    frame.explain()
    assert capsys.readouterr().out.split("Initial Plan")[-1].count("Exchange") == 1
