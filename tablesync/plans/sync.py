"""A sync job: reader, column mapping, quality gate and writer as one declarative spec."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.operators.mapping import MAX_DIRTY_RATIO, MAX_DIRTY_RECORDS, check_error_limit, filter_where, flag_dirty, map_columns
from tablesync.sinks.cells import rows_to_cells
from tablesync.sinks.files import write_documents, write_files, write_partition_dir
from tablesync.sinks.jdbc import append_table
from tablesync.sinks.buckets import BUCKETS, read_buckets, upsert_buckets
from tablesync.sinks.publish import FULL, MERGED, PART, good_rows, mark, marker, next_version, read_current, remove, total_bytes, version_path, versions


MODES = ("overwrite", "append", "upsert")

# What a sync may write to: its own table, or a sink that gets the good rows after the error limit has passed them.
TABLE = "table"
SINKS = (TABLE, "text", "csv", "orc", "partition", "cells", "documents", "jdbc")


@dataclass(frozen=True)
class SyncSpec:
    """What to move. Reader and writer columns pair by position; ``types`` casts text by declared type."""

    read: Callable[[SparkSession], DataFrame]
    target: str
    reader_columns: Sequence[str]
    writer_columns: Sequence[str]
    where: str | None = None
    types: dict[str, str] = field(default_factory=dict)
    mode: str = "overwrite"
    upsert_keys: Sequence[str] = ()
    upsert_order: Sequence[str] = ()
    """Newest first by these columns when a batch repeats a key."""
    buckets: int = BUCKETS
    """Buckets of a new upserted table."""
    sink: str = TABLE
    sink_options: dict = field(default_factory=dict)
    """Arguments of the sink's own function; see ``deliver``."""
    max_dirty_records: int | None = MAX_DIRTY_RECORDS
    max_dirty_ratio: float | None = MAX_DIRTY_RATIO


@dataclass(frozen=True)
class SyncResult:
    target: str
    version: int
    read_count: int
    write_count: int
    fail_count: int
    elapsed_s: float
    bytes_written: int
    path: str
    error: str | None = None
    """Why the sync failed; then nothing of it is visible."""

    @property
    def records_per_s(self) -> float:
        return self.write_count / self.elapsed_s

    @property
    def bytes_per_s(self) -> float:
        return self.bytes_written / self.elapsed_s


def prepare(spark: SparkSession, spec: SyncSpec) -> DataFrame:
    """Rows in the writer's columns and types, flagged where a field does not fit. Lazy, one pass."""
    rows = map_columns(filter_where(spec.read(spark), spec.where), spec.reader_columns, spec.writer_columns)
    return flag_dirty(rows, list(spec.types.items()))


def deliver(rows: DataFrame, spec: SyncSpec) -> None:
    """Good rows into the sink of ``spec``.

    ``text``, ``csv``, ``orc``: ``path``, ``file_name`` and what ``write_files`` takes. ``partition``: ``path``, ``fields``.
    ``cells``: ``path`` and what ``rows_to_cells`` takes. ``documents``: ``path`` and what ``write_documents`` takes. ``jdbc``:
    ``conn``, ``table`` and what ``append_table`` takes.
    """
    options = dict(spec.sink_options)
    if spec.sink in ("text", "csv", "orc"):
        write_files(rows, file_type=spec.sink, **options)
    elif spec.sink == "partition":
        write_partition_dir(rows, options["path"], *options["fields"])
    elif spec.sink == "cells":
        path = options.pop("path")
        rows_to_cells(rows, **options).write.mode("append").parquet(path)
    elif spec.sink == "documents":
        write_documents(rows, **options)
    elif spec.sink == "jdbc":
        append_table(rows, **options)
    else:
        raise ValueError(f"unknown sink {spec.sink!r}; one of {', '.join(SINKS)}")


def run_sync(spark: SparkSession, spec: SyncSpec, note: str | None = None) -> SyncResult:
    """Write, check, publish.

    The source is read once: good rows, and dirty ones with their reason, go to a new, still
    invisible directory. Counts come from its committed files, not from task-side counters, so a
    task repeated after the loss of an executor is not counted twice. Beyond the error limit the
    directory stays invisible. The good rows of an upsert are then merged into the table's buckets, of which those that
    the batch touches are read and written; repeating a run merges to the same state.

    Another sink gets the good rows from the checked directory, which keeps the rejects and the counters; so no sink sees a
    row of a run that is over its limit. ``note`` is stored with the run, after its rows.
    """
    if spec.sink not in SINKS:
        raise ValueError(f"unknown sink {spec.sink!r}; one of {', '.join(SINKS)}")
    if spec.mode not in MODES:
        raise ValueError(f"unknown mode {spec.mode!r}; one of {', '.join(MODES)}")
    started = time.monotonic()
    version = next_version(spark, spec.target)
    path = version_path(spec.target, version)
    flagged = prepare(spark, spec)
    flagged.write.parquet(path)
    written = spark.read.schema(flagged.schema).parquet(path)
    counts = written.agg(F.count(F.lit(1)).alias("read"), F.count("dirty_reason").alias("dirty")).first()
    read, dirty = counts["read"], counts["dirty"]
    check_error_limit(read, dirty, spec.max_dirty_records, spec.max_dirty_ratio)
    kind = FULL if spec.mode == "overwrite" else PART
    if spec.sink != TABLE:
        deliver(good_rows(written), spec)
    elif spec.mode == "upsert":
        kind, order = MERGED, [F.col(c).desc() for c in spec.upsert_order or spec.writer_columns]
        upsert_buckets(good_rows(written).select(*spec.writer_columns), _table(spec), list(spec.upsert_keys), order, spec.buckets)
    mark(spark, spec.target, version, kind, note or "")
    elapsed = time.monotonic() - started
    return SyncResult(spec.target, version, read, read - dirty, dirty, elapsed, total_bytes(spark, path), path)


def _table(spec: SyncSpec) -> str:
    return f"{spec.target}/table"


def clear_runs(spark: SparkSession, spec: SyncSpec, keep: int = 1) -> int:
    """Remove the directories of runs whose rows are elsewhere: merged ones, and those that a newer whole table has replaced.

    The newest ``keep`` marked ones stay, for their rejects and the note; readers of older ones must have ended. Directories
    without a marker stay too: another run may be writing them. Returns how many are gone.
    """
    marked = [(v, kind) for v in versions(spark, spec.target) if (kind := marker(spark, spec.target, v))]
    whole = max((v for v, kind in marked if kind == FULL), default=0)
    gone = [v for v, kind in marked[: len(marked) - keep] if kind == MERGED or v < whole]
    for version in gone:
        remove(spark, version_path(spec.target, version))
    return len(gone)


def target_rows(spark: SparkSession, spec: SyncSpec) -> DataFrame:
    """The target's rows after its runs so far."""
    merged = spec.mode == "upsert" and spec.sink == TABLE
    rows = read_buckets(spark, _table(spec)) if merged else read_current(spark, spec.target)
    if rows is None:
        return prepare(spark, spec).select(*spec.writer_columns).limit(0)
    return rows.select(*spec.writer_columns)


def batch_sync(
    spark: SparkSession, tables: Sequence[str], targets: Sequence[str], make: Callable[[str, str], SyncSpec], parallel: int = 3, limit_s: float | None = None
) -> list[SyncResult]:
    """One sync per pair of reader and writer table, from a template that builds its spec; one result each, in their order.

    The driver only starts jobs; independent tables overlap on the cluster, each in a scheduler pool of its own, so that under
    fair scheduling a small table need not wait for a large one. A table that fails, or runs for more than ``limit_s``
    seconds and is stopped, has its error in its result and leaves the others alone.
    """
    if len(tables) != len(targets):
        raise ValueError(f"{len(tables)} reader tables for {len(targets)} writer tables")

    def run(source: str, target: str) -> SyncResult:
        started, tag, late, over, result_of = time.monotonic(), f"sync-{uuid.uuid4().hex}", threading.Event(), threading.Event(), target
        for name, value in (("spark.scheduler.pool", target), ("spark.job.interruptOnCancel", "true")):
            spark.sparkContext.setLocalProperty(name, value)
        spark.sparkContext.addJobTag(tag)

        def stop():
            # A sync is a chain of jobs: what of it begins after the limit is stopped as well.
            late.set()
            while not over.is_set():
                spark.sparkContext.cancelJobsWithTag(tag)
                over.wait(1)

        timer = threading.Timer(limit_s if limit_s is not None else threading.TIMEOUT_MAX, stop)
        timer.daemon = True
        timer.start()
        try:
            spec = make(source, target)
            result_of = spec.target
            return run_sync(spark, spec)
        except Exception as error:  # noqa: BLE001 - whatever it is, it belongs to this table's result
            why = f"stopped after {limit_s} seconds" if late.is_set() else f"{type(error).__name__}: {str(error)[:500]}"
            return SyncResult(result_of, 0, 0, 0, 0, time.monotonic() - started, 0, "", why)
        finally:
            over.set()
            timer.cancel()
            spark.sparkContext.removeJobTag(tag)
            for name in ("spark.scheduler.pool", "spark.job.interruptOnCancel"):
                spark.sparkContext.setLocalProperty(name, None)

    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), tables, targets))


def sync_counters(spark: SparkSession, results: Sequence[SyncResult]) -> DataFrame:
    """Counters of finished syncs, one row per target."""
    rows = [
        (r.target.rsplit("/", 1)[-1], r.read_count, r.write_count, r.fail_count, r.elapsed_s, r.records_per_s, r.bytes_per_s) for r in results
    ]
    schema = "target string, read_count bigint, write_count bigint, fail_count bigint, elapsed_s double, records_per_s double, bytes_per_s double"
    return spark.createDataFrame(rows, schema)
