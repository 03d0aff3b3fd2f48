"""Generated rows, for timing readers and writers on their own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.functions.casts import constant

GeneratedColumn = Mapping[str, object]
"""``{"name", "type", "value"}`` for a constant, ``{"name", "type", "random": "lo,hi"}`` for a random value."""


def _random(spec: GeneratedColumn, key: Column, seed: int) -> Column:
    declared = str(spec["type"])
    lo, hi = [p.strip() for p in str(spec["random"]).split(",")]
    # 60 bits of a hash of row id and column: a lost task regenerates the same rows.
    named = F.concat_ws(":", key.cast("string"), F.lit(seed), F.lit(str(spec["name"])))
    bits = F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("bigint")
    if declared == "long":
        return F.lit(int(lo)) + F.pmod(bits, F.lit(int(hi) - int(lo) + 1))
    if declared == "double":
        return F.lit(float(lo)) + F.pmod(bits, F.lit(1 << 53)) / F.lit(float(1 << 53)) * (float(hi) - float(lo))
    if declared == "date":
        first, last = F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")
        span = F.timestamp_diff("SECOND", first, last) + 1
        return F.timestamp_add("SECOND", F.pmod(bits, span).cast("int"), first)
    if declared == "bool":
        zeros, ones = int(lo), int(hi)
        return F.pmod(bits, F.lit(zeros + ones)) >= zeros
    # Text and bytes: a random length between the bounds.
    length = F.lit(int(lo)) + F.pmod(bits, F.lit(int(hi) - int(lo) + 1))
    source = F.repeat(F.sha2(named, 256), int(hi) // 64 + 1)
    text = F.substring(source, F.lit(1), length.cast("int"))
    return text.cast("binary") if declared == "bytes" else text


def generate_columns(df: DataFrame, key: str, columns: Sequence[GeneratedColumn], seed: int = 0) -> DataFrame:
    """Adds generated columns to rows identified by ``key``."""
    made = {
        str(c["name"]): (_random(c, F.col(key), seed) if "random" in c else constant(None if c.get("value") is None else str(c["value"]), str(c["type"])))
        for c in columns
    }
    return df.withColumns(made)


def generate(spark: SparkSession, slice_rows: int, channels: int, columns: Sequence[GeneratedColumn], seed: int = 0) -> DataFrame:
    """``slice_rows`` rows in each of ``channels`` slices."""
    ids = spark.range(0, slice_rows * channels, 1, channels)
    return generate_columns(ids, "id", columns, seed).drop("id")
