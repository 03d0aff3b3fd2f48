"""Queries over the run log: pages, reports, failure handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesync.operators.common import DEEP, in_range, newest_first, ntz, page, upsert
from tablesync.operators.select import By

# Result codes and alarm states of a run.
SUCCESS, FAILED, TIMED_OUT, NOT_REPORTED = 200, 500, 502, 0
ALARM_DEFAULT, ALARM_LOCKED, ALARM_NOT_NEEDED, ALARM_SENT, ALARM_FAILED = 0, -1, 1, 2, 3

STATUS_ALL, STATUS_SUCCESS, STATUS_FAILED, STATUS_RUNNING = 0, 1, 2, 3


def is_success() -> Column:
    return F.col("handle_code") == SUCCESS


def is_failed() -> Column:
    """Failed as the log page sees it: either code is neither open nor a success."""
    return ~F.col("trigger_code").isin(NOT_REPORTED, SUCCESS) | ~F.col("handle_code").isin(NOT_REPORTED, SUCCESS)


def is_running() -> Column:
    """Running as the log page sees it: started, no result yet."""
    return (F.col("trigger_code") == SUCCESS) & (F.col("handle_code") == NOT_REPORTED)


def is_unfinished() -> Column:
    """Running as the reports see it: also counts runs whose start is not yet confirmed."""
    return F.col("trigger_code").isin(NOT_REPORTED, SUCCESS) & (F.col("handle_code") == NOT_REPORTED)


_STATUS = {STATUS_SUCCESS: is_success, STATUS_FAILED: is_failed, STATUS_RUNNING: is_running}


def filter_log(
    log: DataFrame, job_group: int = 0, job_id: int = 0, start=None, end=None, status: int = STATUS_ALL
) -> DataFrame:
    """Run filter of the log page; the group counts only when no job is given, the range is inclusive."""
    if job_id > 0:
        log = log.where(F.col("job_id") == job_id)
    elif job_id == 0 and job_group > 0:
        log = log.where(F.col("job_group") == job_group)
    if start is not None or end is not None:
        log = log.where(in_range("trigger_time", start and ntz(start), end and ntz(end)))
    if status in _STATUS:
        log = log.where(_STATUS[status]())
    return log


def log_page(log: DataFrame, offset: int = 0, size: int = 10, log_id: int | None = None, deep: int = DEEP, **filters) -> DataFrame:
    """One page of runs, newest first; or the single run ``log_id``."""
    if log_id is not None:
        return log.where(F.col("id") == log_id)
    order = [By("trigger_time", descending=True), By("id", descending=True)]
    return page(filter_log(log, **filters), order, offset, size, deep)


def log_count(log: DataFrame, **filters) -> DataFrame:
    return filter_log(log, **filters).agg(F.count(F.lit(1)).alias("total"))


def _counts() -> list[Column]:
    def tally(cond):
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))

    return [
        F.count("handle_code").alias("day_count"),
        tally(is_unfinished()).alias("running_count"),
        tally(is_success()).alias("suc_count"),
    ]


def log_report(log: DataFrame, start, end) -> DataFrame:
    """Counts of a closed time range: all, running, successful."""
    return log.where(in_range("trigger_time", ntz(start), ntz(end))).agg(*_counts())


def log_count_by_day(log: DataFrame, start=None, end=None) -> DataFrame:
    """The same counts per calendar day; partial sums leave each task, so one busy day is no hot spot."""
    runs = filter_log(log, start=start, end=end)
    per_day = runs.groupBy(F.col("trigger_time").cast("date").alias("day")).agg(*_counts())
    return per_day.orderBy("day").select(F.date_format("day", "yyyy-MM-dd").alias("trigger_day"), "day_count", "running_count", "suc_count")


def day_spine(spark, now, days: int) -> DataFrame:
    """The ``days`` calendar days up to and including that of ``now``."""
    return spark.range(days).select(
        F.date_sub(ntz(now).cast("date"), F.col("id").cast("int")).alias("trigger_day")
    )


def daily_report(log: DataFrame) -> DataFrame:
    """Report rows of every day in the log: running, success, and fail as the remainder."""
    per_day = log.groupBy(F.col("trigger_time").cast("date").alias("trigger_day")).agg(*_counts())
    return per_day.select(
        "trigger_day", "running_count", "suc_count",
        (F.col("day_count") - F.col("running_count") - F.col("suc_count")).alias("fail_count"),
    )


def log_daily_report(log: DataFrame, now, days: int = 3) -> DataFrame:
    """Report rows for today and the days before it, zero where nothing ran."""
    today = ntz(now).cast("date").cast("timestamp_ntz")
    recent = log.where(
        (F.col("trigger_time") >= today - F.expr(f"INTERVAL '{days - 1}' DAY"))
        & (F.col("trigger_time") < today + F.expr("INTERVAL '1' DAY"))
    )
    report = day_spine(log.sparkSession, now, days).join(daily_report(recent), "trigger_day", "left")
    counts = ["running_count", "suc_count", "fail_count"]
    return report.select("trigger_day", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])


def log_report_upsert(report: DataFrame, fresh: DataFrame) -> DataFrame:
    """Report table after replacing, or adding, the freshly counted days."""
    return upsert(report, fresh, ["trigger_day"])


def report_range(report: DataFrame, start, end) -> DataFrame:
    return report.where(in_range("trigger_day", ntz(start).cast("date"), ntz(end).cast("date"))).orderBy("trigger_day")


def report_total(report: DataFrame) -> DataFrame:
    return report.agg(*[F.sum(c).cast("bigint").alias(c) for c in ("running_count", "suc_count", "fail_count")])


def chart_info(report: DataFrame, now) -> DataFrame:
    """Rows of the last seven days with their totals; seven zero days when there is none."""
    counts = ["running_count", "suc_count", "fail_count"]
    lo, hi = ntz(now) - F.expr("INTERVAL '7' DAY"), ntz(now)
    rows = report.where(in_range("trigger_day", lo, hi)).select("trigger_day", *counts)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c.replace("count", "total")) for c in counts]
    total = rows.agg(F.struct(F.count(F.lit(1)).alias("days"), *sums)).scalar()
    zeros = day_spine(report.sparkSession, now, 7).where(total["days"] == 0)
    zeros = zeros.select("trigger_day", *[F.lit(0).cast("bigint").alias(c) for c in counts])
    shown = rows.unionByName(zeros).withColumn("_total", total)
    return shown.select(F.date_format("trigger_day", "yyyy-MM-dd").alias("trigger_day"), *counts, "_total.*").drop("days")


def dashboard_info(jobs: DataFrame, report: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: number of jobs, runs, successful runs, and distinct executor addresses."""
    runs = F.col("running_count") + F.col("suc_count") + F.col("fail_count")
    total = report.agg(F.struct(F.coalesce(F.sum(runs), F.lit(0)).alias("runs"), F.coalesce(F.sum("suc_count"), F.lit(0)).alias("successes")))
    address = groups.select(F.explode(F.split("address_list", ",")).alias("address")).where("address <> ''")
    return jobs.agg(F.count(F.lit(1)).alias("job_info_count")).withColumn("_total", total.scalar()).select(
        "job_info_count", F.col("_total.runs").alias("job_log_count"), F.col("_total.successes").alias("job_log_success_count"),
        address.agg(F.count_distinct("address")).scalar().alias("executor_count"),
    )


def open_failures(log: DataFrame) -> DataFrame:
    """Failed runs nobody has looked at."""
    return log.where(~(is_unfinished() | is_success()) & (F.col("alarm_status") == ALARM_DEFAULT))


def fail_candidates(log: DataFrame, limit: int | None = None) -> DataFrame:
    """The same; with a limit the oldest, in order."""
    return open_failures(log) if limit is None else page(open_failures(log), [F.col("id")], size=limit)


def retry_candidates(log: DataFrame) -> DataFrame:
    """The next attempt of each failed run that has retries left: one less, same shard and parameters."""
    left = open_failures(log).where(F.col("executor_fail_retry_count") > 0)
    return left.select(
        F.col("id").alias("failed_log_id"), "job_id",
        (F.col("executor_fail_retry_count") - 1).alias("executor_fail_retry_count"), "executor_sharding_param", "executor_param",
    )


def _with_alarm_email(log: DataFrame, jobs: DataFrame, how: str) -> DataFrame:
    emails = jobs.select(F.col("id").alias("job_id"), "alarm_email")
    return open_failures(log).join(emails, "job_id", how)


def alarm_status_next(log: DataFrame, jobs: DataFrame) -> DataFrame:
    """Next alarm state of each failed run: not needed without an address, else to be sent."""
    has_email = F.length(F.trim(F.coalesce("alarm_email", F.lit("")))) > 0
    return _with_alarm_email(log, jobs, "left").select(
        "id", "job_id", F.when(has_email, ALARM_SENT).otherwise(ALARM_NOT_NEEDED).alias("alarm_status")
    )


def alarm_recipients(log: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per failed run and distinct address of its job."""
    addresses = F.array_distinct(F.split("alarm_email", ","))
    runs = _with_alarm_email(log, jobs, "inner").where(F.length(F.trim("alarm_email")) > 0)
    return runs.select("id", "job_id", F.explode(addresses).alias("email")).where("email <> ''")


def alarm_content(log: DataFrame) -> DataFrame:
    """Text of the alarm of each failed run."""
    text = F.concat(
        F.lit("Alarm Job LogId="), F.col("id").cast("string"),
        F.when(F.col("trigger_code") != SUCCESS, F.concat(F.lit("<br>TriggerMsg=<br>"), F.coalesce("trigger_msg", F.lit("null")))).otherwise(""),
        F.when((F.col("handle_code") > 0) & (F.col("handle_code") != SUCCESS),
               F.concat(F.lit("<br>HandleCode="), F.coalesce("handle_msg", F.lit("null")))).otherwise(""),
    )
    return open_failures(log).select("id", text.alias("content"))


def job_last_status(log: DataFrame) -> DataFrame:
    """Last reported result of each job."""
    done = log.where(F.col("handle_time").isNotNull())
    return done.groupBy("job_id").agg(F.max_by("handle_code", newest_first("handle_time", "id")).alias("last_handle_code"))


def run_duration(log: DataFrame, jobs: DataFrame) -> DataFrame:
    """Seconds from start to result of every finished run, and whether it broke its job's limit."""
    limits = jobs.select(F.col("id").alias("job_id"), F.col("executor_timeout"))
    seconds = F.timestamp_diff("SECOND", F.col("trigger_time"), F.col("handle_time"))
    runs = log.where(F.col("handle_time").isNotNull()).select("id", "job_id", "handle_code", seconds.alias("duration_s"))
    over = (F.col("executor_timeout") > 0) & (F.col("duration_s") > F.col("executor_timeout") * 60)
    return runs.join(limits, "job_id", "left").select(
        "id", "job_id", "duration_s",
        F.coalesce(over, F.lit(False)).alias("over_limit"), (F.col("handle_code") == TIMED_OUT).alias("timed_out"),
    )


def run_duration_stats(log: DataFrame) -> DataFrame:
    """Exact duration quantiles per job: the smallest duration that the share of its runs does not exceed.

    Runs are counted per job and second first, so what is ordered are the distinct durations of a job.
    """
    seconds = F.timestamp_diff("SECOND", F.col("trigger_time"), F.col("handle_time"))
    runs = log.where(F.col("handle_time").isNotNull()).select("job_id", seconds.alias("s"))
    per_second = runs.groupBy("job_id", "s").agg(F.count(F.lit(1)).alias("n"))
    of_job = Window.partitionBy("job_id")
    upto = of_job.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = per_second.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(of_job)})

    def quantile(percent):
        return F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * percent, F.col("s"))).alias(f"p{percent}_s")

    return counted.groupBy("job_id").agg(F.sum("n").alias("runs"), F.min("s").alias("min_s"), F.max("s").alias("max_s"), quantile(50), quantile(95))


def log_lifecycle(events: DataFrame) -> DataFrame:
    """One row per run from its start, process-id and result events; the last of a kind counts."""

    def last(column, kind):
        hit = F.col("kind") == kind
        return F.max_by(F.when(hit, F.col(column)), F.when(hit, F.col("seq")))

    # Text does not fit a hash aggregate's fixed-width buffer: it is fetched by the number of the event that holds it.
    runs = events.groupBy("log_id").agg(
        last("event_time", "trigger").alias("trigger_time"), last("code", "trigger").alias("trigger_code"),
        F.max(F.when(F.col("kind") == "process", F.col("seq"))).alias("seq"),
        last("event_time", "handle").alias("handle_time"),
        F.coalesce(last("code", "handle"), F.lit(NOT_REPORTED)).alias("handle_code"),
    )
    processes = events.where(F.col("kind") == "process").select("log_id", "seq", "process_id")
    return runs.join(processes, ["log_id", "seq"], "left").select("log_id", "trigger_time", "trigger_code", "process_id", "handle_time", "handle_code")


def next_starts(log: DataFrame) -> DataFrame:
    """When each job may be expected next: its last start plus the mean time between its starts so far, null after one run."""
    started = log.groupBy("job_id").agg(F.count(F.lit(1)).alias("runs"), F.min("trigger_time").alias("_first"), F.max("trigger_time").alias("last_start"))
    whole = F.expr("timestampdiff(MICROSECOND, _first, last_start) DIV nullif(runs - 1, 0)")
    return started.withColumn("next_start", F.timestamp_add("MICROSECOND", whole, F.col("last_start"))).select("job_id", "runs", "last_start", "next_start")
