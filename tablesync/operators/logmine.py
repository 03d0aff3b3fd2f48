"""Statistics and task profiles out of run log lines (log_id, line_no, line).

A line is addressed by (log_id, line_no). Where an operator needs the following line it joins on
that address instead of windowing over a log, so one huge log is spread like any other data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.functions.sources import jdbc_host, logged_url, sql_table
from tablesync.operators.common import ntz

# Labels of the statistics lines, in the order they are tried.
STAT_LABELS = {
    "start_time": "任务启动时刻",
    "end_time": "任务结束时刻",
    "total_time": "任务总计耗时",
    "average_flow": "任务平均流量",
    "write_speed": "记录写入速度",
    "read_count": "读出记录总数",
    "fail_count": "读写失败总数",
}

# What marks the lines of read and write tasks.
READ_MARK = "CommonRdbmsReader$Task"
READ_TASK = r"(\d+\-)+reader"
READ_BEGIN = r"(?i)Begin\s+to\s+read\s+record\s+by\s+Sql"
READ_DONE = r"(?i)Finished\s+read\s+record\s+by\s+Sql"
WRITE_MARK = "commit blocks"
WRITE_TASK = r"(\d+\-)+writer"
WRITE_BEGIN = r"(?i)begin\s+to\s+commit\s+blocks"
WRITE_DONE = r"(?i)commit\s+blocks\s+ok"

def parse_run_stats(lines: DataFrame) -> DataFrame:
    """One row per run with its statistics; the value follows the first colon, the last match counts."""
    label = F.lit(None).cast("string")
    for name, text in reversed(STAT_LABELS.items()):
        label = F.when(F.contains("line", F.lit(text)), name).otherwise(label)
    colon = F.instr("line", ":")
    value = F.trim(F.when(colon > 1, F.substring(F.col("line"), colon + 1, F.length("line"))).otherwise(F.col("line")))
    found = lines.select("log_id", "line_no", label.alias("label"), value.alias("value")).where("label IS NOT NULL")

    def last(name):
        hit = F.col("label") == name
        return F.max_by(F.when(hit, F.col("value")), F.when(hit, F.col("line_no")))

    stats = found.groupBy("log_id").agg(*[last(n).alias(n) for n in STAT_LABELS])
    return stats.withColumns({c: F.col(c).try_cast("bigint") for c in ("read_count", "fail_count")})


def parse_units(stats: DataFrame) -> DataFrame:
    """Elapsed seconds, bytes/s and records/s as numbers."""

    def number(column, unit):
        return F.regexp_extract(F.col(column), rf"^([0-9]+(?:\.[0-9]+)?)\s*{unit}$", 1).try_cast("double")

    return stats.select(
        "log_id", number("total_time", "s").alias("total_s"), number("average_flow", "B/s").alias("bytes_per_s"),
        number("write_speed", "rec/s").alias("records_per_s"),
    )


def _epoch(line: Column) -> Column:
    """Epoch seconds of the time a line starts with, 0 where it has none."""
    ts = F.substring(line, 1, 19)
    shaped = F.when(ts.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), ts.try_cast("timestamp_ntz"))
    return F.coalesce(F.timestamp_diff("SECOND", ntz("1970-01-01 00:00:00"), shaped), F.lit(0))


def _spans(lines: DataFrame, mark: str, task: str, begin: str, done: str, now, extra: dict[str, Column]) -> DataFrame:
    """Begin and end of each task; its last begin counts, and ends only after that."""
    text = F.trim("line")
    begins, ends = F.col("line").rlike(begin), F.col("line").rlike(done)
    # Rows that are neither stay until the grouping: a filter on the patterns would run them twice.
    marked = lines.where(F.instr(text, mark) > 1).select("log_id", "line_no", text.alias("line")).select(
        "log_id", "line_no", F.regexp_extract("line", task, 0).alias("task"),
        F.when(begins, "b").when(ends, "e").alias("kind"), _epoch(F.col("line")).alias("at"),
        *[F.when(begins, c).alias(n) for n, c in extra.items()],
    )
    start = F.struct("line_no", "at", *extra)
    per = marked.groupBy("log_id", "task").agg(
        F.max(F.when(F.col("kind") == "b", start)).alias("b"),
        F.max(F.when(F.col("kind") == "e", F.struct("line_no", "at"))).alias("e"),
    ).where("b IS NOT NULL AND task <> ''")
    finished = F.coalesce(F.col("e.line_no") > F.col("b.line_no"), F.lit(False))
    return per.select(
        "log_id", "task", F.when(finished, "D").otherwise("R").alias("stat"), F.col("b.at").alias("wake"),
        F.when(finished, F.col("e.at")).otherwise(F.timestamp_diff("SECOND", ntz("1970-01-01 00:00:00"), ntz(now))).alias("done"),
        F.col("b.line_no").alias("begin_line"), *[F.col(f"b.{n}").alias(n) for n in extra],
    )


def read_task_spans(lines: DataFrame, now) -> DataFrame:
    """One row per read task: state R or D, begin, end (``now`` while running), host and table."""
    extra = {"own_url": logged_url(F.col("line")), "path": sql_table(F.col("line"))}
    spans = _spans(lines, READ_MARK, READ_TASK, READ_BEGIN, READ_DONE, now, extra)
    # The statement breaks the line, so its connection is logged on the next one.
    urls = lines.where(F.contains("line", F.lit("jdbcUrl"))).select(
        "log_id", (F.col("line_no") - 1).alias("begin_line"), logged_url(F.col("line")).alias("next_url")
    )
    url = F.coalesce(F.nullif("next_url", F.lit("")), "own_url")
    found = spans.join(urls, ["log_id", "begin_line"], "left").withColumn("url", url)
    return found.select("log_id", "task", "stat", "wake", "done", jdbc_host(F.col("url")).alias("host"), "path")


def write_task_spans(lines: DataFrame, now) -> DataFrame:
    """One row per write task, from the begin and end of its commit."""
    return _spans(lines, WRITE_MARK, WRITE_TASK, WRITE_BEGIN, WRITE_DONE, now, {}).select("log_id", "task", "stat", "wake", "done")


def _summary(spans: DataFrame, max_cost_s: int | None) -> DataFrame:
    """Sums per log over tasks that take no negative time, nor ``max_cost_s`` or more where that is given."""
    cost = F.col("done") - F.col("wake")
    valid = cost > -1 if max_cost_s is None else (cost > -1) & (cost < max_cost_s)

    def over_valid(agg, value):
        return agg(F.when(valid, value))

    hosts = [F.count_distinct("host").alias("servers")] if "host" in spans.columns else []
    sums = spans.groupBy("log_id").agg(
        F.count_if(valid).alias("tasks"), F.count_if(~valid).alias("left_out"), *hosts, F.coalesce(over_valid(F.sum, cost), F.lit(0)).alias("total_s"),
        over_valid(F.min, F.col("wake")).alias("first_s"), over_valid(F.max, F.col("done")).alias("last_s"), F.max(cost).alias("max_cost"),
    )
    wall = F.coalesce(F.nullif(F.col("last_s") - F.col("first_s"), F.lit(0)), F.lit(1))
    per_second = F.col("tasks") / F.coalesce(F.nullif(F.col("total_s"), F.lit(0)), F.col("wall_s"))
    return sums.withColumn("wall_s", wall).withColumn("_index", per_second)


def task_profile(spans: DataFrame, max_cost_s: int | None = None) -> DataFrame:
    """Cost of each task, its share of the wall time in percent, and its tilt (cost over mean cost).

    ``spans`` is read twice, for the sums per log and for the rows; materialise it first where
    it is derived from log text.
    """
    sums = _summary(spans, max_cost_s).select("log_id", "wall_s", "_index")
    cost = F.col("done") - F.col("wake")
    return spans.join(sums, "log_id").select(
        *spans.columns, cost.alias("cost"), (100 * cost / F.col("wall_s")).alias("share_pct"), (F.col("_index") * cost).alias("tilt")
    )


def profile_summary(spans: DataFrame, max_cost_s: int | None = None) -> DataFrame:
    """Per log: tasks, tasks left out of the sums, servers, total and mean cost, wall time, concurrency and largest tilt."""
    sums = _summary(spans, max_cost_s).where("tasks > 0")
    servers = ["servers"] if "servers" in sums.columns else []
    return sums.select(
        "log_id", "tasks", "left_out", *servers, "total_s", (F.col("total_s") / F.col("tasks")).alias("mean_s"), "wall_s",
        (F.col("total_s") / F.col("wall_s")).alias("concurrency"), (F.col("_index") * F.col("max_cost")).alias("max_tilt"),
    )


def log_tail(lines: DataFrame, from_line: int) -> DataFrame:
    """Lines of each log from ``from_line`` (counted from 1) on."""
    return lines.where(F.col("line_no") >= from_line)


def log_tail_status(lines: DataFrame, runs: DataFrame, from_line: int) -> DataFrame:
    """Per run: last line number, and whether nothing is left to read because the run has ended."""
    last = lines.groupBy(F.col("log_id").alias("id")).agg(F.max("line_no").alias("to_line"))
    state = runs.select("id", "handle_code").join(last, "id", "left").withColumn("to_line", F.coalesce("to_line", F.lit(0)))
    return state.select(
        F.col("id").alias("log_id"), F.lit(from_line).alias("from_line"), "to_line",
        ((F.lit(from_line) > F.col("to_line")) & (F.col("handle_code") > 0)).alias("is_end"),
    )
