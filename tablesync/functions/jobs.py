"""Fields of a job description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIDE = "struct<name:string, parameter:struct<column:array<string>, connection:array<struct<table:array<string>>>>>"
JOB_SCHEMA = f"job struct<content:array<struct<reader:{_SIDE}, writer:{_SIDE}>>>"


def job_contents(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per reader and writer pair: their names, tables and columns."""

    def tables(side: str) -> Column:
        return F.flatten(F.col(f"c.{side}.parameter.connection.table"))

    pairs = df.select(*keep, F.posexplode(F.from_json(column, JOB_SCHEMA)["job"]["content"]).alias("position", "c"))
    return pairs.select(
        *keep, "position",
        F.col("c.reader.name").alias("reader_name"), tables("reader").alias("reader_tables"), F.col("c.reader.parameter.column").alias("reader_columns"),
        F.col("c.writer.name").alias("writer_name"), tables("writer").alias("writer_tables"), F.col("c.writer.parameter.column").alias("writer_columns"),
    )
