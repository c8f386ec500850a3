"""Higher-order functions: ``let`` evaluates an expression once, ``fold`` collects many results in linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, with ``value`` evaluated a single time per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Parts that one inner fold takes, and so the most results that a step copies.
FOLD_BLOCK = 256


def fold(parts: Column, carry: dict[str, Column], kind: str, step: Callable[[Column, Column], Column],
         finish: Callable[[Column, Column], Column], block: int = FOLD_BLOCK) -> Column:
    """A fold over an array that appends results of type ``kind`` to a list and hands a small state on.

    ``step(state, part)`` gives a struct of ``done``, an array of new results, and the next state's fields; ``finish(results, state)`` the
    outcome. Spark copies the whole state at each step of ``aggregate``, so a growing list in it costs the square of its length. Here
    the list of a block of parts is carried within the block only, and the outer fold appends whole blocks.
    """
    empty = F.expr(f"cast(array() AS ARRAY<{kind}>)")
    lists = F.expr(f"cast(array() AS ARRAY<ARRAY<{kind}>>)")

    def state(done: Column, source: Column) -> Column:
        return F.struct(done.alias("done"), *[source[n].alias(n) for n in carry])

    def inner(acc: Column, part: Column) -> Column:
        return let(step(acc, part), lambda r: state(F.when(F.size(r["done"]) > 0, F.concat(acc["done"], r["done"])).otherwise(acc["done"]), r))

    def outer(acc: Column, part: Column) -> Column:
        return let(F.aggregate(part, state(empty, acc), inner), lambda r: state(F.concat(acc["done"], F.array(r["done"])), r))

    def over(whole: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(whole) - 1) / block).cast("int")))
        blocks = F.transform(starts, lambda i: F.slice(whole, i * block + 1, F.lit(block)))
        start = F.struct(lists.alias("done"), *[c.alias(n) for n, c in carry.items()])
        return F.aggregate(blocks, start, outer, lambda acc: finish(F.flatten(acc["done"]), acc))

    return let(parts, over)
