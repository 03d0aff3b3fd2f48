"""Which rows, versions and partitions to drop, and what is left after dropping them.

Deletion on files means deriving the remaining rows, so every operator here is set-based;
there is no loop over batches of ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.operators.common import newest_per_key, ntz, page
from tablesync.operators.select import By, nth_row, rows_after

# Clean-up types of the run log, as (months back) or (newest rows kept).
CLEAR_MONTHS = {1: 1, 2: 3, 3: 6, 4: 12}
CLEAR_KEEP = {5: 1_000, 6: 10_000, 7: 30_000, 8: 100_000}
CLEAR_ALL = 9

DEFAULT_RETENTION_DAYS = 30
MIN_DIRECTORY_DAYS = 3


def _scope(log: DataFrame, job_group: int, job_id: int) -> DataFrame:
    if job_group > 0:
        log = log.where(F.col("job_group") == job_group)
    if job_id > 0:
        log = log.where(F.col("job_id") == job_id)
    return log


def _listed(ids: DataFrame, limit: int | None) -> DataFrame:
    """The ids; only a limit asks for an order, and then the smallest come as a top-k."""
    ids = ids.select("id")
    return ids if limit is None else page(ids, [F.col("id")], size=limit)


def clear_before_time(log: DataFrame, cutoff, job_group: int = 0, job_id: int = 0, limit: int | None = None) -> DataFrame:
    """Ids of runs started at or before ``cutoff``; with a limit the smallest."""
    cutoff = ntz(cutoff) if isinstance(cutoff, str) else cutoff
    return _listed(_scope(log, job_group, job_id).where(F.col("trigger_time") <= cutoff), limit)


def clear_keep_newest(log: DataFrame, keep: int, job_group: int = 0, job_id: int = 0, limit: int | None = None) -> DataFrame:
    """Ids outside the newest ``keep`` runs of the scope; rows without a time are the oldest, and among equal times the smaller ids.

    The last run to keep is found by counting, see ``select``; what stands after it goes by a plain comparison.
    """
    scope = _scope(log, job_group, job_id)
    if keep <= 0:
        return _listed(scope, limit)
    order = [By("trigger_time", descending=True), By("id", descending=True)]
    last = nth_row(scope, order, keep - 1)
    return _listed(scope.where(F.lit(False) if last is None else rows_after(order, last)), limit)


def clear_by_type(log: DataFrame, kind: int, now, job_group: int = 0, job_id: int = 0) -> DataFrame:
    """Ids to drop for clean-up type 1 to 9."""
    if kind in CLEAR_MONTHS:
        # A timestamp shifted by whole months keeps its time of day.
        cutoff = F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL '{CLEAR_MONTHS[kind]}' MONTH")
        return clear_before_time(log, cutoff, job_group, job_id)
    if kind in CLEAR_KEEP:
        return clear_keep_newest(log, CLEAR_KEEP[kind], job_group, job_id)
    if kind == CLEAR_ALL:
        return _scope(log, job_group, job_id).select("id")
    raise ValueError(f"unknown clean-up type {kind}")


def retention_days(log: DataFrame, now, days: int = DEFAULT_RETENTION_DAYS) -> DataFrame:
    """Ids of runs from before midnight ``days`` days ago; nothing when ``days`` is not positive."""
    if days <= 0:
        return log.select("id").where(F.lit(False))
    cutoff = F.date_sub(ntz(now).cast("date"), days).cast("timestamp_ntz")
    return clear_before_time(log, cutoff)


def delete_ids(log: DataFrame, ids: DataFrame) -> DataFrame:
    """What remains after removing the listed ids."""
    return log.join(ids.select("id"), "id", "left_anti")


def cascade_delete(jobs: DataFrame, log: DataFrame, versions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs, runs and source versions left after removing the jobs in ``ids``."""
    gone = ids.select(F.col("id").alias("job_id"))
    return (
        delete_ids(jobs, ids),
        log.join(gone, "job_id", "left_anti"),
        versions.join(gone, "job_id", "left_anti"),
    )


def keep_latest_versions(versions: DataFrame, keep: int = 30) -> DataFrame:
    """Versions to drop: all but the newest ``keep`` of each job.

    Only the newest rows per job are shuffled (at most ``keep`` per job and task); each
    job's oldest kept version then serves as the cutoff for the full table.
    """
    newest = newest_per_key(
        versions.select("job_id", "update_time", "id"), ["job_id"], [F.col("update_time").desc(), F.col("id").desc()], keep
    )
    cutoff = newest.groupBy("job_id").agg(F.min(F.struct("update_time", "id")).alias("_cutoff"))
    return versions.join(cutoff, "job_id").where(F.struct("update_time", "id") < F.col("_cutoff")).drop("_cutoff")


def version_history(versions: DataFrame, job_id: int) -> DataFrame:
    """Versions of one job, newest first."""
    return versions.where(F.col("job_id") == job_id).orderBy(F.col("id").desc())


def expire_date_dirs(directories: DataFrame, today, days: int) -> DataFrame:
    """Dated directories at least ``days`` old; names that are no date stay, and below three days nothing goes."""
    if days < MIN_DIRECTORY_DAYS:
        return directories.where(F.lit(False))
    day = F.try_to_timestamp(F.col("name"), F.lit("yyyy-MM-dd")).cast("date")
    return directories.where(F.datediff(ntz(today).cast("date"), day) >= days)
