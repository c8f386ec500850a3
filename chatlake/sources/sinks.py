"""IO5, IO6: exports. Both write distributed part files plus a one-row manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BOM = "\ufeff"
#: Times are written to the microsecond; Spark's own formats for text files stop at milliseconds.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def manifest(df: DataFrame, ts: str = "ts", **labels: str) -> DataFrame:
    """Header of an export: row count and time bounds, one row."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
    ).select(*[F.lit(v).alias(k) for k, v in labels.items()], "total", "first_ts", "last_ts")


def export_json(df: DataFrame, path: str, ts: str = "ts", **labels: str) -> None:
    """IO5: one JSON object per line under ``data``, the header under ``manifest``; non-ASCII stays as is."""
    df.write.mode("overwrite").options(**TIMES).json(f"{path}/data")
    manifest(df, ts, **labels).write.mode("overwrite").options(**TIMES).json(f"{path}/manifest")


def export_csv(df: DataFrame, path: str, *, bom: bool = False) -> None:
    """IO6: CSV with a header row; ``bom`` marks each part file for spreadsheet programs."""
    names = list(df.columns)
    if bom:
        df = df.withColumnsRenamed({names[0]: _BOM + names[0]})
    df.write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").options(**TIMES).csv(path)


def export_name(start: Column, end: Column, stem: str = "conversations", suffix: str = "csv") -> Column:
    """File name derived from the exported range."""
    return F.concat(F.lit(stem + "_"), F.date_format(start, "yyyyMMdd"), F.lit("_"),
                    F.date_format(end, "yyyyMMdd"), F.lit("." + suffix))
