"""Rows into cells of a wide-column table."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.sources.cells import split_column

# What to do with a null cell.
NULL_MODES = ("skip", "empty")


def row_key(df: DataFrame, layout: str) -> Column:
    """Key built from a JSON array of ``{"index": i}`` and ``{"value": text}`` parts, joined as text."""
    parts = []
    for part in json.loads(layout):
        if "index" in part:
            parts.append(F.coalesce(F.col(df.columns[int(part["index"])]).cast("string"), F.lit("")))
        else:
            parts.append(F.lit(str(part["value"])))
    return F.concat(*parts)


def null_cells(cells: DataFrame, mode: str = "skip") -> DataFrame:
    """Drop null cells, or write them as empty values."""
    if mode not in NULL_MODES:
        raise ValueError(f"unknown null mode {mode!r}; one of {', '.join(NULL_MODES)}")
    if mode == "skip":
        return cells.where(F.col("value").isNotNull())
    return cells.withColumn("value", F.coalesce("value", F.lit("")))


def rows_to_cells(
    df: DataFrame, layout: str, columns: Sequence[tuple[int, str]], version: int | str | None = None, null_mode: str = "skip"
) -> DataFrame:
    """One cell per row and ``(index, "family:qualifier")``; index 1 is the first column.

    ``version`` is a fixed number, or the name of the column that holds it.
    """
    ver = F.col(version).cast("bigint") if isinstance(version, str) else F.lit(1 if version is None else version).cast("bigint")
    for _, column in columns:
        split_column(column)
    wide = df.select(
        row_key(df, layout).alias("rowkey"), ver.alias("ver"), *[F.col(df.columns[i - 1]).cast("string").alias(c) for i, c in columns]
    )
    cells = wide.unpivot(["rowkey", "ver"], [f"`{c}`" for _, c in columns], "column", "value")
    family, qualifier = F.substring_index("column", ":", 1), F.expr("substring(column, instr(column, ':') + 1)")
    return null_cells(cells.select("rowkey", family.alias("family"), qualifier.alias("qualifier"), "ver", "value"), null_mode)
