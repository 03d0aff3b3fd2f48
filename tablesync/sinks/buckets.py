"""A table dealt to buckets by the hash of its key. An upsert reads and writes the buckets that its batch touches, no others.

The merged buckets are written beside the table first. From the moment a file names them they count, and a dynamic partition
overwrite then puts them in their place. A run that dies on the way is carried on by the next one, and readers see
either the state before or the state after a batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.operators.common import newest_per_key, upsert
from tablesync.session import scratch_path
from tablesync.sinks.publish import path_exists, read_text, remove, write_text

BUCKET = "_bucket"
BUCKETS = 16
"""Buckets of a new table; choose as many as make a bucket a few hundred megabytes. The number stays with the table."""

_TABLE, _PENDING = "_TABLE", "_PENDING"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _known(spark: SparkSession, root: str) -> tuple[T.StructType, int] | None:
    """Columns and number of buckets of the table."""
    text = read_text(spark, f"{root}/{_TABLE}")
    if text is None:
        return None
    about = json.loads(text)
    return T.StructType.fromJson(about["schema"]), about["buckets"]


def _pending(spark: SparkSession, root: str) -> tuple[str, list[int]] | None:
    """Merged buckets that aren't in their place yet: where they are, and which."""
    text = read_text(spark, f"{root}/{_PENDING}")
    return None if text is None else tuple(json.loads(text))


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)


def read_buckets(spark: SparkSession, root: str, only: Sequence[int] | None = None) -> DataFrame | None:
    """The table's rows, or those of some buckets; ``None`` before the first upsert."""
    known = _known(spark, root)
    if known is None:
        return None
    schema, _ = known
    pending = _pending(spark, root)
    rows = _read(spark, f"{root}/data", schema) if path_exists(spark, f"{root}/data") else None
    if pending:
        path, moved = pending
        beside = _read(spark, path, schema)
        rows = beside if rows is None else rows.where(~F.col(BUCKET).isin(moved)).unionByName(beside)
    if rows is None:
        return spark.createDataFrame([], schema)
    return (rows if only is None else rows.where(F.col(BUCKET).isin(list(only)))).drop(BUCKET)


def _put_in_place(spark: SparkSession, root: str) -> None:
    pending = _pending(spark, root)
    if pending is None:
        return
    rows = _read(spark, pending[0], _known(spark, root)[0])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{root}/data")
    remove(spark, f"{root}/{_PENDING}")
    remove(spark, pending[0])


def merge_buckets(
    batch: DataFrame, root: str, keys: Sequence[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = BUCKETS
) -> int:
    """Replace each bucket that ``batch`` touches by ``merge`` of its rows and the batch's. Returns the number of these buckets."""
    spark = batch.sparkSession
    _put_in_place(spark, root)
    known = _known(spark, root)
    if known is None:
        write_text(spark, f"{root}/{_TABLE}", json.dumps({"schema": batch.schema.jsonValue(), "buckets": buckets}))
        known = batch.schema, buckets
    schema, buckets = known
    batch = batch.select(*[F.col(f.name).cast(f.dataType) for f in schema])  # equal keys have equal types and so equal hashes
    place = bucket_of(keys, buckets)
    touched = sorted(r[0] for r in batch.select(place).distinct().collect())
    if not touched:
        return 0
    merged = merge(read_buckets(spark, root, touched), batch).select(*schema.names).withColumn(BUCKET, place)
    beside = scratch_path(spark, "buckets")
    merged.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(beside)
    write_text(spark, f"{root}/{_PENDING}", json.dumps([beside, touched]))
    _put_in_place(spark, root)
    return len(touched)


def upsert_buckets(batch: DataFrame, root: str, keys: Sequence[str], order: Sequence[Column], buckets: int = BUCKETS) -> int:
    """Rows of the batch replace those of equal key; of several in the batch the first in ``order`` counts."""

    def merge(rows: DataFrame | None, new: DataFrame) -> DataFrame:
        newest = newest_per_key(new, keys, order)
        return newest if rows is None else upsert(rows, newest, keys)

    return merge_buckets(batch, root, keys, merge, buckets)
