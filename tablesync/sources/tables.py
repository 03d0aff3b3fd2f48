"""Tables stored as files or in the session catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tablesync.operators.common import blank


def select_table(df: DataFrame, columns: Sequence[str] = (), where: str | None = None) -> DataFrame:
    """Chosen columns with an optional filter text; both reach a Parquet or ORC scan."""
    if not blank(where):
        df = df.where(where)
    return df.select(*columns) if columns else df


def run_query(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], args: Mapping[str, object] | None = None) -> DataFrame:
    """A user query over ``{name}`` tables, with ``:name`` parameters bound as values."""
    return spark.sql(sql, args=dict(args or {}), **tables)


def read_multi(tables: Sequence[DataFrame]) -> DataFrame:
    """Several tables of one shape as one source; a differing shape is an error."""
    shape = tables[0].dtypes
    for i, df in enumerate(tables[1:], start=2):
        if df.dtypes != shape:
            raise ValueError(f"table {i} has columns {df.dtypes}, expected {shape}")
    return reduce(DataFrame.unionByName, tables)
