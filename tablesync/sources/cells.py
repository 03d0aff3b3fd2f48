"""Wide-column tables as a long table of cells (rowkey, family, qualifier, ver, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.operators.common import blank, newest_per_key


def split_column(column: str) -> tuple[str, str]:
    family, _, qualifier = column.partition(":")
    if not family or not qualifier:
        raise ValueError(f"cell column {column!r} is not family:qualifier")
    return family, qualifier


def _requested(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = [split_column(c) for c in columns]
    wanted = F.lit(False)
    for family, qualifier in pairs:
        wanted = wanted | ((F.col("family") == family) & (F.col("qualifier") == qualifier))
    return cells.where(wanted)


def scan_latest(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per row key with the newest version of each requested column, all as text."""
    picks = []
    for column in columns:
        family, qualifier = split_column(column)
        hit = (F.col("family") == family) & (F.col("qualifier") == qualifier)
        picks.append(F.max_by(F.when(hit, F.col("value")), F.when(hit, F.col("ver"))).alias(qualifier))
    return _requested(cells, columns).groupBy("rowkey").agg(*picks)


def scan_versions(cells: DataFrame, columns: Sequence[str], max_versions: int) -> DataFrame:
    """Up to ``max_versions`` newest versions of each requested cell, one row each."""
    return newest_per_key(_requested(cells, columns), ["rowkey", "family", "qualifier"], [F.col("ver").desc()], max_versions)


def rowkey_range(cells: DataFrame, start: str | None, end: str | None, binary: bool = False) -> DataFrame:
    """Cells with start <= rowkey < end, in byte order; without both ends the range is ignored.

    ``binary`` means the ends are written as hex, and the row key column holds bytes.
    """
    if blank(start) or blank(end):
        return cells
    lo, hi = (F.unhex(F.lit(start)), F.unhex(F.lit(end))) if binary else (F.lit(start), F.lit(end))
    return cells.where((F.col("rowkey") >= lo) & (F.col("rowkey") < hi))
