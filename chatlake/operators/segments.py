"""Order-dependent building blocks that survive a hot key.

A window over ``partitionBy(user)`` sorts all rows of a user in one task. When one user holds a large
share of the table that task never ends, so every running total, lag and rank below works on
(key, segment) slices instead, where the segment is a coarse, monotone function of the order (an hour,
a block of turns). Per-slice summaries are aggregated map-side, turned into offsets by a window over
the few summaries of each key, and joined back on (key, segment) - the same hash partitioning that the
slice window needs, so the rows are exchanged once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SEG = "__segment"


def turn_segment(order: str = "turn", width: int = 4096) -> Column:
    return F.floor(F.col(order) / F.lit(width))


def time_segment(ts: str = "ts", unit: str = "hour") -> Column:
    return F.date_trunc(unit, F.col(ts))


def _join_back(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = summary.withColumnsRenamed({c: f"__k_{c}" for c in [*keys, _SEG]})
    on = None
    for c in [*keys, _SEG]:
        test = df[c].eqNullSafe(renamed[f"__k_{c}"])
        on = test if on is None else on & test
    return df.join(renamed, on).drop(*[f"__k_{c}" for c in [*keys, _SEG]])


def running(df: DataFrame, keys: Sequence[str], segment: Column, order: Sequence[Column],
            sums: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """Add inclusive running sums per key in ``order``; ``totals`` maps a sum to a column of its key total."""
    keys = list(keys)
    base = df.withColumn(_SEG, segment)
    per_segment = base.groupBy(*keys, _SEG).agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_segment.select(
        *keys, _SEG,
        *[F.sum(f"__s_{n}").over(before).alias(f"__o_{n}") for n in sums],
        *[F.sum(f"__s_{n}").over(by_key).alias(t) for n, t in (totals or {}).items()],
    )
    inside = Window.partitionBy(*keys, _SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _join_back(base, offsets, keys)
    for name, value in sums.items():
        local = F.sum(value).over(inside)
        out = out.withColumn(name, F.when(F.col(f"__o_{name}").isNull(), local).otherwise(F.col(f"__o_{name}") + local))
    return out.drop(_SEG, *[f"__o_{n}" for n in sums])


def surroundings(df: DataFrame, keys: Sequence[str], segment: Column, order: Sequence[str], *, number: str | None = None,
                 total: str | None = None, before: dict[str, str] | None = None, after: dict[str, str] | None = None,
                 wider: dict[str, tuple[Column, Sequence[str]]] | None = None) -> DataFrame:
    """Number, total, preceding and next values of each row of a key, all from one summary per slice.

    ``before`` and ``after`` map a column to the name under which the neighbour's value is added; ``wider`` adds sums over all rows of some
    of the keys only. The rows are read twice, once for the summaries and once for themselves, however much is asked for.
    """
    keys, order_row = list(keys), F.struct(*order)
    base = df.withColumn(_SEG, segment)
    sides = {"__last": (F.max_by, before), "__first": (F.min_by, after)}
    parts = [F.count(F.lit(1)).cast("bigint").alias("__rows")]
    parts += [edge(F.struct(*columns), order_row).alias(name) for name, (edge, columns) in sides.items() if columns]
    parts += [F.sum(value).alias(f"__w_{name}") for name, (value, _) in (wider or {}).items()]
    slices = base.groupBy(*keys, _SEG).agg(*parts)
    by_key = Window.partitionBy(*keys)
    in_order = by_key.orderBy(_SEG)
    known = [F.coalesce(F.sum("__rows").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"),
             F.sum("__rows").over(by_key).alias("__total")]
    known += [F.lag("__last").over(in_order).alias("__outer_last")] if before else []
    known += [F.lead("__first").over(in_order).alias("__outer_first")] if after else []
    known += [F.sum(f"__w_{name}").over(Window.partitionBy(*some)).alias(name) for name, (_, some) in (wider or {}).items()]
    out = _join_back(base, slices.select(*keys, _SEG, *known), keys)
    inside = Window.partitionBy(*keys, _SEG).orderBy(*order)
    if number:
        out = out.withColumn(number, F.col("__offset") + F.row_number().over(inside))
    if total:
        out = out.withColumn(total, F.col("__total"))
    for shift, outer, columns in ((F.lag, "__outer_last", before), (F.lead, "__outer_first", after)):
        if columns:
            out = out.withColumn("__near", F.coalesce(shift(F.struct(*columns)).over(inside), F.col(outer)))
            for source, name in columns.items():
                out = out.withColumn(name, F.col("__near").getField(source))
            out = out.drop("__near", outer)
    return out.drop(_SEG, "__offset", "__total")


def numbered(df: DataFrame, keys: Sequence[str], segment: Column, order: Sequence[Column], name: str = "rn",
             total: str | None = None) -> DataFrame:
    """Row number per key (and, on request, the key's row count)."""
    return running(df, keys, segment, order, {name: F.lit(1).cast("bigint")}, {name: total} if total else None)


def previous(df: DataFrame, keys: Sequence[str], segment: Column, order: Sequence[str],
             columns: dict[str, str]) -> DataFrame:
    """Add the preceding row's values per key (``columns`` maps a source column to its new name)."""
    return _neighbour(df, keys, segment, order, columns, backwards=False)


def following(df: DataFrame, keys: Sequence[str], segment: Column, order: Sequence[str],
              columns: dict[str, str]) -> DataFrame:
    """Add the next row's values per key."""
    return _neighbour(df, keys, segment, order, columns, backwards=True)


def _neighbour(df, keys, segment, order, columns, backwards):
    keys = list(keys)
    base = df.withColumn(_SEG, segment)
    values = F.struct(*[F.col(c) for c in columns])
    edge = F.min_by if backwards else F.max_by
    edges = base.groupBy(*keys, _SEG).agg(edge(values, F.struct(*order)).alias("__edge"))
    seg_order = F.col(_SEG).desc() if backwards else F.col(_SEG).asc()
    outer = edges.select(
        *keys, _SEG, F.lag("__edge").over(Window.partitionBy(*keys).orderBy(seg_order)).alias("__outer"),
    )
    row_order = [F.col(o).desc() if backwards else F.col(o).asc() for o in order]
    inside = Window.partitionBy(*keys, _SEG).orderBy(*row_order)
    out = _join_back(base, outer, keys)
    out = out.withColumn("__near", F.coalesce(F.lag(values).over(inside), F.col("__outer")))
    for source, name in columns.items():
        out = out.withColumn(name, F.col("__near").getField(source))
    return out.drop(_SEG, "__outer", "__near")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, *, rank: str = "rn",
          slots: int = 32) -> DataFrame:
    """First ``n`` rows per key with their rank.

    The row_number filter becomes a group limit on the map side, so a task sends at most ``n`` rows of a key.
    A first round deals what the tasks send for a key onto ``slots`` reducers, by the number of the sending
    task; the second round sees at most ``slots * n`` rows of a key. The result does not depend on the deal.
    """
    keys = list(keys)
    first = Window.partitionBy(*keys, "__slot").orderBy(*order)
    dealt = df.withColumn("__slot", F.pmod(F.spark_partition_id(), F.lit(slots)))
    limited = dealt.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= n).drop("__r", "__slot")
    w = Window.partitionBy(*keys).orderBy(*order)
    return limited.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def trailing(df: DataFrame, keys: Sequence[str], index: str, value: str, size: int, name: str,
             width: int = 4096) -> DataFrame:
    """Collect the last ``size`` values per key (current row included) in order of a dense ``index``.

    The last ``size - 1`` rows of each block are also sent to the next block, so a block is complete in itself.
    """
    if not 0 < size <= width:
        raise ValueError("size must lie between 1 and the block width")
    keys = list(keys)
    block = F.floor((F.col(index) - 1) / width)
    spill = F.pmod(F.col(index) - 1, F.lit(width)) >= width - (size - 1)
    blocks = F.when(spill, F.array(block, block + 1)).otherwise(F.array(block))
    spread = df.withColumn("__home", block).withColumn("__block", F.explode(blocks))
    w = Window.partitionBy(*keys, "__block").orderBy(index).rowsBetween(-(size - 1), 0)
    return (
        spread.withColumn(name, F.collect_list(value).over(w))
        .where(F.col("__home") == F.col("__block")).drop("__home", "__block")
    )
