"""Streaming forms of the jobs that otherwise poll.

Every query runs with ``availableNow``: it takes what has arrived, keeps its position in the
checkpoint and ends. Outputs go through ``foreachBatch`` into a directory per batch, or merge
by key, so a batch that is repeated after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablesync.operators.common import newest_per_key, ntz
from tablesync.operators.registry import registry_latest
from tablesync.operators.runs import is_success, is_unfinished, open_failures
from tablesync.plans.sync import SyncSpec, run_sync
from tablesync.sinks.buckets import merge_buckets
from tablesync.sinks.publish import path_exists, rejected_rows

SEEN_WIDTH = 1 << 20
"""Ids of one part of the published rows of a stream that takes each id once."""


def stream_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Files below ``path`` as a stream; ``max_files`` bounds a batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that has arrived, then stop."""
    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to its own directory, replacing it when the batch is repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batch directories, with the number of their batch."""
    return spark.read.parquet(path)


def parts_before(spark: SparkSession, path: str, parts: list[int], batch_id: int, schema) -> DataFrame:
    """What earlier batches wrote into some parts; the batch's own rows, there after a failure, are left out.

    Directories of other parts are neither listed nor read.
    """
    there = [p for p in (f"{path}/part={n}" for n in parts) if path_exists(spark, p)]
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", path).schema(schema).parquet(*there).where(F.col("batch") < batch_id)


def _once(path: str, key: str, order: list[Column], width: int) -> Callable[[DataFrame, int], None]:
    """Writes the rows whose key no earlier batch has, one of each key. What was seen is the published table itself, so a
    row is recognised however late its repeat arrives, and is taken however late it arrives first.

    The table is dealt to parts of ``width`` consecutive ids. Ids are given in sequence, so a batch and its repeats fall
    into few parts, and only these are read, however long the history.
    """

    def new(batch: DataFrame, batch_id: int) -> None:
        dealt = batch.withColumn("part", F.floor(F.col(key) / width))
        parts = [r[0] for r in dealt.where(F.col(key).isNotNull()).select("part").distinct().collect()]
        schema = batch.select(key).schema.add("part", "long").add("batch", "integer")
        seen = parts_before(batch.sparkSession, path, parts, batch_id, schema)
        fresh = newest_per_key(dealt, [key], order).join(seen.select(key), key, "left_anti").withColumn("batch", F.lit(batch_id))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(path)

    return new


_REPORT = ["day_count", "running_count", "suc_count"]


def stream_daily_report(runs: DataFrame, path: str, checkpoint: str) -> None:
    """Counts per day of what each batch brings; a run changes its day's report however late it arrives. No state is held."""
    tally = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    write = batch_writer(path)

    def count(batch: DataFrame, batch_id: int) -> None:
        per_day = batch.groupBy(F.col("trigger_time").cast("date").alias("trigger_day")).agg(
            F.count("handle_code").alias("day_count"), tally(is_unfinished()).alias("running_count"), tally(is_success()).alias("suc_count")
        )
        write(per_day, batch_id)

    run_available(runs.select("trigger_time", "trigger_code", "handle_code"), count, checkpoint)


def read_daily_report(spark: SparkSession, path: str) -> DataFrame:
    """The report of every day: the sums over all batches."""
    total = read_batches(spark, path).groupBy("trigger_day").agg(*[F.sum(c).alias(c) for c in _REPORT])
    return total.select("trigger_day", "running_count", "suc_count", (F.col("day_count") - F.col("running_count") - F.col("suc_count")).alias("fail_count"))


_RUN = "trigger_time timestamp_ntz, trigger_code int, handle_code int"


def _tallies() -> list[Column]:
    tally = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return [F.count("handle_code").alias("day_count"), tally(is_unfinished()).alias("running_count"), tally(is_success()).alias("suc_count")]


def stream_report_windows(runs: DataFrame, path: str, checkpoint: str, delay: str = "2 days") -> None:
    """Counts per day in windows with a state store, which holds the days of the last ``delay`` only.

    Each batch is split at the newest time of all batches before it less ``delay``. Newer runs go to a table that a second
    stream, with that delay as its watermark, counts in windows of a day: an updated day is written whole, days that are past
    leave the state. Runs that come later than that, or have no time, would be dropped there; they are counted per day in a
    table beside it, so nothing is lost however late it is. The second stream takes all that the first has left in one
    batch, so its watermark never passes a run; should one be dropped nevertheless, the call fails.
    """
    spark = runs.sparkSession
    fresh, late, newest, days = (batch_writer(f"{path}/{n}") for n in ("fresh", "late", "newest", "days"))

    def split(batch: DataFrame, batch_id: int) -> None:
        session, top = batch.sparkSession, None
        known = f"{path}/newest/batch={batch_id - 1}"
        if path_exists(session, known):
            top = session.read.schema("newest timestamp_ntz").parquet(known).first()["newest"]
        rows = batch.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(_RUN)])
        bound = F.lit(None if top is None else str(top)).cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}")
        in_time = F.col("trigger_time").isNotNull() & (bound.isNull() | (F.col("trigger_time") >= bound))
        fresh(rows.where(in_time), batch_id)
        late(rows.where(~in_time).groupBy(F.col("trigger_time").cast("date").alias("trigger_day")).agg(*_tallies()), batch_id)
        newest(rows.agg(F.greatest(F.max("trigger_time"), F.lit(None if top is None else str(top)).cast("timestamp_ntz")).alias("newest")), batch_id)

    run_available(runs.select("trigger_time", "trigger_code", "handle_code"), split, f"{checkpoint}/split")

    # A watermark needs a time with a zone; zone-free times are taken as UTC and back, so the session's zone plays no part.
    instant = F.timestamp_micros(F.timestamp_diff("MICROSECOND", ntz("1970-01-01 00:00:00"), F.col("trigger_time")))
    kept = stream_files(spark, f"{path}/fresh", _RUN).select(instant.alias("at"), "trigger_code", "handle_code")
    daily = kept.withWatermark("at", delay).groupBy(F.window("at", "1 day")).agg(*_tallies())
    daily = daily.select(F.date_from_unix_date(F.floor(F.unix_seconds("window.start") / 86_400).cast("int")).alias("trigger_day"), *_REPORT)
    done = run_available(daily, days, f"{checkpoint}/windows", "update")
    dropped = sum(o["numRowsDroppedByWatermark"] for p in done.recentProgress for o in p["stateOperators"])
    if dropped:
        raise RuntimeError(f"{dropped} runs came behind the watermark")


def read_report_windows(spark: SparkSession, path: str) -> DataFrame:
    """The report of every day: its newest count in windows, and what came too late for them."""
    columns = "trigger_day date, day_count long, running_count long, suc_count long, batch int"
    counted = newest_per_key(spark.read.schema(columns).parquet(f"{path}/days"), ["trigger_day"], [F.col("batch").desc()])
    both = counted.unionByName(spark.read.schema(columns).parquet(f"{path}/late"))
    total = both.groupBy("trigger_day").agg(*[F.sum(c).alias(c) for c in _REPORT])
    return total.select("trigger_day", "running_count", "suc_count", (F.col("day_count") - F.col("running_count") - F.col("suc_count")).alias("fail_count"))


def stream_callback_dedup(callbacks: DataFrame, path: str, checkpoint: str, time: str = "arrived", width: int = SEEN_WIDTH) -> None:
    """The first callback of each log id."""
    run_available(callbacks, _once(path, "log_id", [F.col(time)], width), checkpoint)


def stream_registry_state(heartbeats: DataFrame, table: str, checkpoint: str) -> None:
    """Bucketed table of the newest heartbeat per executor; who is dead is asked of it at a given time."""

    def newest(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        return registry_latest(batch if before is None else before.unionByName(batch))

    def merge(batch: DataFrame, _: int) -> None:
        merge_buckets(registry_latest(batch), table, ["registry_group", "registry_key", "registry_value"], newest)

    run_available(heartbeats, merge, checkpoint)


def stream_fail_alerts(runs: DataFrame, path: str, checkpoint: str, width: int = SEEN_WIDTH) -> None:
    """Failed runs as they arrive, once each, with the retries they have left."""
    failed = open_failures(runs).select("id", "job_id", "trigger_time", F.col("executor_fail_retry_count").alias("retries_left"))
    run_available(failed, _once(path, "id", [F.col("trigger_time")], width), checkpoint)


def stream_sync(source: DataFrame, spec: SyncSpec, checkpoint: str, rejects: str | None = None) -> None:
    """A sync that follows its source: each batch passes mapping, casts and quality gate, then merges by key.

    The checkpoint is the watermark of the job. A repeated batch merges to the same state. With ``rejects`` dirty rows go there,
    by batch, and the good ones pass; without it a batch beyond the error limit stops the stream until it is mended.
    """
    if spec.mode != "upsert":
        raise ValueError("a streaming sync merges by key; give upsert_keys and mode='upsert'")

    passing = spec if rejects is None else replace(spec, max_dirty_records=None, max_dirty_ratio=None)

    def move(batch: DataFrame, batch_id: int) -> None:
        result = run_sync(batch.sparkSession, replace(passing, read=lambda spark: batch))
        if rejects is not None:
            batch_writer(rejects)(rejected_rows(batch.sparkSession, result.path), batch_id)

    run_available(source, move, checkpoint)
