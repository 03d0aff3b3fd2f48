"""Delimited and ORC files, addressed by column position, and single partition directories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.casts import cast_declared, constant, spark_type

# File types a reader may name. "seq" and "rc" are known but not readable by path.
READABLE_TYPES = ("text", "csv", "orc")
UNREADABLE_TYPES = ("seq", "rc")

FileColumn = Mapping[str, object]
"""``{"index": i, "type": t}`` for a field by position or ``{"value": v, "type": t}`` for a constant; ``"name"`` is optional."""


def _name(spec: FileColumn) -> str:
    return str(spec.get("name") or (f"_c{spec['index']}" if "index" in spec else "_value"))


NULL_TEXT = "\\N"
"""Fixed value: how a null field is written in text files."""

_NO_FIELD = "\uffff"
"""A separator no text has: a line stays one field."""


def read_lines_raw(
    spark: SparkSession, path: str | Sequence[str], width: int, sep: str = "\u0001", skip_header: bool = False, null_value: str = NULL_TEXT
) -> DataFrame:
    """Every field of plain text lines as text, named ``_f0`` onward: quotes are data, empty text is empty, only ``null_value`` is null."""
    if skip_header:  # the first line of each file
        lines = spark.read.csv(path, schema="value string", sep=_NO_FIELD, quote="", header=True, nullValue=_NO_FIELD, enforceSchema=True)
    else:
        lines = spark.read.text(path)
    fields = F.split("value", rf"\Q{sep}\E", -1)
    return lines.select(*[F.nullif(F.get(fields, F.lit(i)), F.lit(null_value)).alias(f"_f{i}") for i in range(width)])


def read_delimited_raw(
    spark: SparkSession, path: str | Sequence[str], width: int, sep: str = ",", skip_header: bool = False, null_value: str = ""
) -> DataFrame:
    """Every field as text, named ``_f0`` onward; no inference pass over the data."""
    schema = T.StructType([T.StructField(f"_f{i}", T.StringType()) for i in range(width)])
    return spark.read.csv(path, schema=schema, sep=sep, header=skip_header, nullValue=null_value, enforceSchema=True)


def read_delimited(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[FileColumn], sep: str = ",",
    skip_header: bool = False, null_value: str | None = None, quoted: bool = False,
) -> DataFrame:
    """Fields by position in their declared type, plus constants. Text that does not fit its type is null.

    Plain lines unless ``quoted``, which reads quoted CSV.
    """
    width = 1 + max((int(c["index"]) for c in columns if "index" in c), default=0)
    if quoted:
        raw = read_delimited_raw(spark, path, width, sep, skip_header, null_value or "")
    else:
        raw = read_lines_raw(spark, path, width, sep, skip_header, NULL_TEXT if null_value is None else null_value)
    return raw.select(
        *[
            (cast_declared(F.col(f"_f{c['index']}"), str(c["type"])) if "index" in c else constant(c.get("value"), str(c["type"]))).alias(_name(c))
            for c in columns
        ]
    )


def read_orc(spark: SparkSession, path: str | Sequence[str], columns: Sequence[FileColumn]) -> DataFrame:
    """ORC fields by position."""
    raw = spark.read.orc(path)
    return raw.select(
        *[
            (F.col(raw.columns[int(c["index"])]).cast(spark_type(str(c["type"]))) if "index" in c else constant(c.get("value"), str(c["type"]))).alias(_name(c))
            for c in columns
        ]
    )


def read_file(spark: SparkSession, path, file_type: str, columns: Sequence[FileColumn], **options) -> DataFrame:
    """Files of a named type."""
    kind = file_type.lower()
    if kind in ("text", "csv"):
        return read_delimited(spark, path, columns, quoted=kind == "csv", **options)
    if kind == "orc":
        return read_orc(spark, path, columns)
    if kind in UNREADABLE_TYPES:
        raise ValueError(f"file type {kind!r} is read through a Hive table, not by path")
    raise ValueError(f"unknown file type {file_type!r}; one of {', '.join(READABLE_TYPES)}")


def read_partition(
    spark: SparkSession, root: str, partition: str, schema: T.StructType | str, file_format: str = "parquet", **constants: str
) -> DataFrame:
    """The files of one partition directory below ``root``.

    Read on its own the directory does not carry the partition value; pass it as a constant.
    """
    df = spark.read.format(file_format).schema(schema).load(f"{root}/{partition}/*")
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})
