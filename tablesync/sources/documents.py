"""Document collections: typed fields out of JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.functions.casts import spark_type


def parse_field(field: str) -> tuple[str, str]:
    """``name:type`` into its parts."""
    name, _, declared = field.rpartition(":")
    if not name:
        raise ValueError(f"document field {field!r} is not name:type")
    return name, spark_type(declared)


def _schema(fields: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in map(parse_field, fields))


def read_documents(spark: SparkSession, path: str | Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Documents of JSON files, one per line; only the named fields are parsed."""
    return spark.read.schema(_schema(fields)).json(path)


def parse_documents(df: DataFrame, column: str, fields: Sequence[str]) -> DataFrame:
    """The same over a text column, keeping the other columns."""
    others = [c for c in df.columns if c != column]
    return df.withColumn("_doc", F.from_json(column, _schema(fields))).select(*others, "_doc.*")
