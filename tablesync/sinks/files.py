"""Delimited, ORC, document, partitioned and discarding sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tablesync.functions.casts import spark_type
from tablesync.sources.documents import parse_field
from tablesync.sources.files import _NO_FIELD, NULL_TEXT

# File types a writer may name, and its write modes.
WRITABLE_TYPES = ("text", "csv", "orc")
WRITE_MODES = {"append": "append", "nonConflict": "errorifexists"}

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def write_mode(name: str) -> str:
    if name not in WRITE_MODES:
        raise ValueError(f"unknown write mode {name!r}; one of {', '.join(WRITE_MODES)}")
    return WRITE_MODES[name]


def _typed(df: DataFrame, columns: Sequence[tuple[str, str]] | None) -> DataFrame:
    if not columns:
        return df
    if len(columns) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns to write, {len(columns)} declared")
    return df.select(*[F.col(c).cast(spark_type(t)).alias(n) for c, (n, t) in zip(df.columns, columns)])


def _field(df: DataFrame, column: str, sep: str) -> Column:
    """Text of a field of a plain line."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.coalesce(F.date_format(column, TIMESTAMP_FORMAT), F.lit(NULL_TEXT))
    text = F.col(column).cast("string")
    if kind == "string":
        broken = text.contains(sep) | text.contains("\n") | text.contains("\r") | (text == NULL_TEXT)
        text = F.when(broken, F.raise_error(F.concat(F.lit(f"a line can't carry this text of {column}: "), text))).otherwise(text)
    return F.coalesce(text, F.lit(NULL_TEXT))


def write_files(
    df: DataFrame, path: str, file_name: str, file_type: str = "text", columns: Sequence[tuple[str, str]] | None = None,
    sep: str = ",", mode: str = "append", header: bool = False,
) -> str:
    """Write named, typed columns below ``path/file_name`` and return that path.

    Type ``text`` is plain lines, as they are read back: nothing is quoted, null is ``\\N``, and a text that holds the separator
    or a line break is an error, since no line could carry it. Type ``csv`` quotes.
    """
    target = f"{path}/{file_name}"
    typed = _typed(df, columns)
    writer = typed.write.mode(write_mode(mode))
    if file_type == "text":
        names = sep.join(typed.columns)
        lines = typed.select(F.concat_ws(sep, *[_field(typed, c, sep) for c in typed.columns]).alias(names if header else "value"))
        if header:
            lines.write.mode(write_mode(mode)).csv(target, sep=_NO_FIELD, quote="", header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        else:
            lines.write.mode(write_mode(mode)).text(target)
    elif file_type == "csv":
        writer.option("timestampNTZFormat", TIMESTAMP_FORMAT).csv(target, sep=sep, header=header)
    elif file_type == "orc":
        writer.orc(target)
    else:
        raise ValueError(f"unknown file type {file_type!r}; one of {', '.join(WRITABLE_TYPES)}")
    return target


def write_partition_dir(df: DataFrame, path: str, *fields: str) -> str:
    """Write into ``path/field=value``; a rerun replaces only the partitions it writes.

    The rebalance hint clusters rows by partition, so a day is not one small file per task, and
    splits a day that holds most of the rows by size.
    """
    clustered = df.hint("rebalance", *fields)
    clustered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*fields).parquet(path)
    return path


def write_documents(df: DataFrame, path: str, fields: Sequence[str] | None = None, mode: str = "append") -> str:
    """Write one JSON document per row, with ``name:type`` columns by position."""
    columns = [parse_field(f) for f in fields] if fields else None
    if columns:
        if len(columns) != len(df.columns):
            raise ValueError(f"{len(df.columns)} columns to write, {len(columns)} declared")
        df = df.select(*[F.col(c).cast(t).alias(n) for c, (n, t) in zip(df.columns, columns)])
    df.write.mode(write_mode(mode)).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return path


def write_console(df: DataFrame, rows: int | None = None) -> int:
    """Print every row, or the first ``rows``; they come to the driver partition by partition. Returns how many were printed."""
    printed = 0
    print(*df.columns, sep="\t")
    for row in (df if rows is None else df.limit(rows)).toLocalIterator():
        print(*row, sep="\t")
        printed += 1
    return printed


def write_nowhere(df: DataFrame, **measures: Column) -> dict:
    """Compute every row and drop it: times the read side alone. Returns ``measures`` as seen by the rows that reached the sink."""
    observation = Observation()
    df.observe(observation, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in measures.items()]).write.format("noop").mode("overwrite").save()
    return observation.get
