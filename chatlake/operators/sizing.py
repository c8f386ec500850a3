"""Broadcasts are only taken behind a measured row count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows below which a narrow relation is taken to fit every executor.
BROADCAST_ROWS = 100_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no further than one row past the bound."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a relation within the bound; otherwise leave the join to the optimizer."""
    return F.broadcast(df) if fits(df, rows) else df
