"""Incremental windows and the watermarks between them."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesync.operators.common import in_range, ntz
from tablesync.operators.runs import SUCCESS

# Kinds of increment.
INC_NONE, INC_ID, INC_TIME, INC_PARTITION = 0, 1, 2, 3

# How a time bound may be written, and how a partition value may be.
EPOCH_SECONDS = "Timestamp"
TIME_FORMATS = (EPOCH_SECONDS, "yyyy/MM/dd", "HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")
PARTITION_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd")

BUCKET_BITS = 20
"""Ids that agree in all but their last 20 bits form one bucket: at most 1 048 576 runs."""


def time_window(df: DataFrame, column: str, start, trigger_time) -> DataFrame:
    """Rows in ``[start, trigger_time)``, the trigger time cut to the second."""
    end = str(trigger_time).split(".")[0]
    return df.where(in_range(column, ntz(start), ntz(end), inclusive_end=False))


def id_window(df: DataFrame, column: str, start_id: int, end_id: int) -> DataFrame:
    """Rows in ``[start_id, end_id)``. The row holding the largest id waits until a later one exists."""
    return df.where(in_range(column, F.lit(start_id), F.lit(end_id), inclusive_end=False))


def max_id(df: DataFrame, pk: str) -> DataFrame:
    """Upper bound of the next id window: the largest key, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(pk), F.lit(0)).alias("max_id"))


def format_bound(ts: Column, fmt: str | None = None) -> Column:
    """A time bound as text: epoch seconds unless a format is given."""
    fmt = fmt or EPOCH_SECONDS
    if fmt not in TIME_FORMATS:
        raise ValueError(f"unknown time format {fmt!r}; one of {', '.join(TIME_FORMATS)}")
    if fmt == EPOCH_SECONDS:
        return F.timestamp_diff("SECOND", ntz("1970-01-01 00:00:00"), ts).cast("string")
    return F.date_format(ts, fmt)


def partition_value(now: Column, offset_days: int | Column, fmt: str | Column) -> Column:
    """``now`` moved by whole days, as a partition value."""
    if isinstance(fmt, str):
        if fmt not in PARTITION_FORMATS:
            raise ValueError(f"unknown partition format {fmt!r}; one of {', '.join(PARTITION_FORMATS)}")
        fmt = F.lit(fmt)
    offset = F.lit(offset_days) if isinstance(offset_days, int) else offset_days
    return F.call_function("date_format", F.date_add(now.cast("date"), offset), fmt)


def partition_spec(info: Column, now: Column) -> Column:
    """``field=value`` from a ``field,offset,format`` setting."""
    part = F.split(info, ",")
    value = partition_value(now, part[1].cast("int"), part[2])
    return F.concat(part[0], F.lit("="), value)


def advance_watermark(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Job state after its runs: the newest successful one moves the start of id and time jobs.

    Runs reduce to one row per job before they meet the job table.
    """
    done = runs.where(F.col("handle_code") == SUCCESS).groupBy("job_id").agg(
        F.max_by("max_id", "id").alias("_max_id"), F.max_by("trigger_time", "id").alias("_trigger_time")
    )
    moved = {
        "inc_start_id": F.when((F.col("increment_type") == INC_ID) & F.col("_max_id").isNotNull(), F.col("_max_id")).otherwise(F.col("inc_start_id")),
        "inc_start_time": F.when((F.col("increment_type") == INC_TIME) & F.col("_trigger_time").isNotNull(), F.col("_trigger_time")).otherwise(F.col("inc_start_time")),
    }
    state = jobs.join(done.withColumnRenamed("job_id", "id"), "id", "left")
    return state.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in jobs.columns])


def previous_value(
    df: DataFrame, key: str, order: str, value: Column, out: str, bucket_bits: int = BUCKET_BITS, id_bits: int = 64, level: int = 0
) -> DataFrame:
    """Adds the last non-null ``value`` before each row of the same ``key`` in ``order`` (a unique id of ``id_bits`` bits).

    A window over a whole key would put a hot key into one task. Rows are grouped by key and id bucket instead, so a group is
    bounded by the bucket's width whatever the key holds. One row per key and bucket carries the value across bucket borders;
    where ids are sparse these rows are many too, so they are carried over buckets of buckets in the same way.
    """
    bucket, end, carried, found = (f"_{n}{level}" for n in ("bucket", "end", "carry", "value"))
    rows = df.withColumn(found, value).withColumn(bucket, F.shiftright(F.col(order).cast("bigint"), bucket_bits))
    known = F.when(F.col(found).isNotNull(), F.col(order))
    ends = rows.groupBy(key, bucket).agg(F.max_by(found, known).alias(end))
    left = id_bits - bucket_bits
    if left <= BUCKET_BITS:
        before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.select(key, bucket, F.last(end, ignorenulls=True).over(before).alias(carried))
    else:
        carry = previous_value(ends, key, bucket, F.col(end), carried, BUCKET_BITS, left, level + 1).select(key, bucket, carried)
    inside = Window.partitionBy(key, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carry, [key, bucket], "left")
    last = F.coalesce(F.last(found, ignorenulls=True).over(inside), F.col(carried))
    return joined.withColumn(out, last).drop(found, bucket, carried)


def inc_chain(runs: DataFrame, first_start, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Window of every time run when replayed in id order: it starts where the last success ended."""
    end_if_done = F.when(F.col("handle_code") == SUCCESS, F.col("trigger_time"))
    chained = previous_value(runs, "job_id", "id", end_if_done, "_previous_end", bucket_bits)
    return chained.select(
        "id", "job_id", F.coalesce("_previous_end", ntz(first_start)).alias("window_start"),
        F.col("trigger_time").alias("window_end"), "handle_code",
    )


def inc_gap_overlap(windows: DataFrame, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Runs whose window does not start where the previous run of the job ended."""
    chained = previous_value(windows, "job_id", "run_id", F.col("window_end"), "previous_end", bucket_bits)
    off = F.timestamp_diff("MICROSECOND", F.col("previous_end"), F.col("window_start"))
    kind = F.when(off > 0, "gap").when(off < 0, "overlap")
    return chained.where(off != 0).select("run_id", "job_id", "previous_end", "window_start", kind.alias("kind"), F.abs(off).alias("micros"))
