"""Declared column types of files and streams, and the casts to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Declared type names and the Spark type behind each. Dates carry a time of
# day and no zone.
DECLARED_TYPES = {
    "string": "string",
    "long": "bigint",
    "date": "timestamp_ntz",
    "double": "double",
    "bool": "boolean",
    "bytes": "binary",
}


def spark_type(declared: str) -> str:
    try:
        return DECLARED_TYPES[declared.lower()]
    except KeyError:
        raise ValueError(f"unknown column type {declared!r}; one of {', '.join(DECLARED_TYPES)}") from None


def cast_declared(column: Column, declared: str) -> Column:
    """Value in its declared type, null where the text does not fit."""
    return column.try_cast(spark_type(declared))


def constant(value: str | None, declared: str) -> Column:
    return F.lit(value).cast(spark_type(declared))
