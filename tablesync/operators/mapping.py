"""From reader columns to writer columns: pairing, constants, parameters, casts, quality."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.functions.casts import cast_declared, constant, spark_type
from tablesync.operators.common import blank

# Default error limit of a sync.
MAX_DIRTY_RECORDS = 0
MAX_DIRTY_RATIO = 0.02


class ErrorLimitExceeded(RuntimeError):
    """More dirty records than the sync allows."""


def map_columns(df: DataFrame, reader: Sequence[str], writer: Sequence[str]) -> DataFrame:
    """Reader columns renamed to the writer's, paired by position."""
    if len(reader) != len(writer):
        raise ValueError(f"{len(reader)} reader columns for {len(writer)} writer columns")
    return df.select(*[F.col(r).alias(w) for r, w in zip(reader, writer)])


def filter_where(df: DataFrame, where: str | None) -> DataFrame:
    return df if blank(where) else df.where(where)


def constant_column(df: DataFrame, name: str, value: str | None, declared: str = "string") -> DataFrame:
    return df.withColumn(name, constant(value, declared))


_PARAMETER = re.compile(r"\$\{(\w+)\}")
_DEFINITION = re.compile(r"-D(\w+)=(\S*)")


def parse_definitions(text: str) -> dict[str, str]:
    """``-Dname=value`` pairs of a parameter string."""
    return dict(_DEFINITION.findall(text))


def substitute_params(text: str, params: Mapping[str, object]) -> str:
    """Text with every ``${name}`` replaced; an unknown name is an error. For paths and constants."""

    def value(match):
        if match[1] not in params:
            raise KeyError(f"no value for parameter {match[1]}")
        return str(params[match[1]])

    return _PARAMETER.sub(value, text)


_QUOTED = re.compile(r"'\$\{(\w+)\}'|'(?:[^']|'')*'")


def bind_params(sql: str) -> str:
    """Query text with ``${name}``, in quotes of its own or not, turned into a ``:name`` marker, to be bound as a value.

    A parameter that is only part of a quoted text can't be bound; it is an error.
    """

    def quoted(match):
        if match[1]:
            return f":{match[1]}"
        if _PARAMETER.search(match[0]):
            raise ValueError(f"parameter inside the text {match[0]}")
        return match[0]

    return _PARAMETER.sub(r":\1", _QUOTED.sub(quoted, sql))


def flag_dirty(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Columns in their declared type; for a row with text that does not fit, ``dirty_reason``
    names the fields and ``dirty_record`` keeps the row as it was read."""
    typed = {name: cast_declared(F.col(name), declared) for name, declared in columns}
    failed = [
        F.when(F.col(name).isNotNull() & typed[name].isNull(), F.lit(f"{name} is not {declared}"))
        for name, declared in columns if spark_type(declared) not in ("string", "binary")
    ]
    reason = F.concat_ws("; ", *failed) if failed else F.lit("")
    out = [typed[c].alias(c) if c in typed else F.col(c) for c in df.columns]
    return df.select(
        *out, F.when(reason != "", reason).alias("dirty_reason"),
        F.when(reason != "", F.to_json(F.struct(*df.columns))).alias("dirty_record"),
    )


def split_dirty(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without the flag, and rejected rows with their reason."""
    good = flagged.where(F.col("dirty_reason").isNull()).drop("dirty_reason", "dirty_record")
    return good, flagged.where(F.col("dirty_reason").isNotNull()).select("dirty_reason", "dirty_record")


def quality_counts(flagged: DataFrame) -> DataFrame:
    """Rows read, good and dirty, as one row."""
    return flagged.agg(
        F.count(F.lit(1)).alias("read_count"),
        F.count_if(F.col("dirty_reason").isNull()).alias("good_count"),
        F.count_if(F.col("dirty_reason").isNotNull()).alias("dirty_count"),
    )


def over_limit(read: int, dirty: int, max_records: int | None = MAX_DIRTY_RECORDS, max_ratio: float | None = MAX_DIRTY_RATIO) -> bool:
    """Whether either limit is broken; ``None`` turns a limit off."""
    return (max_records is not None and dirty > max_records) or (max_ratio is not None and read > 0 and dirty / read > max_ratio)


def check_error_limit(read: int, dirty: int, max_records: int | None = MAX_DIRTY_RECORDS, max_ratio: float | None = MAX_DIRTY_RATIO) -> None:
    if over_limit(read, dirty, max_records, max_ratio):
        raise ErrorLimitExceeded(f"{dirty} of {read} records are dirty (limits: {max_records} records, ratio {max_ratio})")


def shard_slice(df: DataFrame, key: str, index: int, total: int) -> DataFrame:
    """The part of shard ``index`` of ``total``: by value for whole numbers, by hash otherwise."""
    whole = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    number: Column = F.col(key) if whole else F.xxhash64(key)
    return df.where(F.pmod(number, F.lit(total)) == index)
