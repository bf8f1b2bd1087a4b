"""Scans with a budget and statistics of what they read."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.operators.intervals import point_join, union_segments


class Scan(NamedTuple):
    """The rows that are kept, and one row of rows_scanned, rows_met, rows_kept and truncated."""

    rows: DataFrame
    statistics: DataFrame


def _within(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows in order: a top-k per partition, merged; all of them if ``most`` is 0 or less."""
    return df.orderBy(*order).limit(most) if most > 0 else df


def head(df: DataFrame, ts: str, tie: str, most: int) -> Scan:
    """Exactly the first ``most`` rows by time; 0 or a negative number means all."""
    kept = F.least(F.col("rows_met"), F.lit(most)) if most > 0 else F.col("rows_met")
    told = df.agg(F.count("*").alias("rows_met")).select(F.col("rows_met").alias("rows_scanned"), "rows_met", kept.alias("rows_kept"), (kept < F.col("rows_met")).alias("truncated"))
    return Scan(_within(df, [ts, tie], most), told)


def windowed(df: DataFrame, ts: str, tie: str, windows: DataFrame, most: int, cell: float) -> Scan:
    """The first ``most`` rows whose time, a number, is in any of ``windows`` (lo, hi: both ends included).

    Windows are merged first, so a row meets one at most; both sides are joined by cells of time of the width
    ``cell``, and neither is held in one task.
    """
    merged = union_segments(windows.withColumn("__one", F.lit(1)), ["__one"], "lo", "hi").select("__one", "lo", "hi")
    met = point_join(df.withColumn("__one", F.lit(1)), merged, ["__one"], ts, ("lo", "hi"), cell).select(*df.columns)
    scanned = df.agg(F.count("*")).scalar()
    kept = F.least(F.col("rows_met"), F.lit(most)) if most > 0 else F.col("rows_met")
    told = met.agg(F.count("*").alias("rows_met")).withColumn("rows_scanned", scanned).select("rows_scanned", "rows_met", kept.alias("rows_kept"), (kept < F.col("rows_met")).alias("truncated"))
    return Scan(_within(met, [ts, tie], most), told)
