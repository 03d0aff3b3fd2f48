"""Registered run-log mining."""

from pyspark.sql import functions as F

from tablesync.operators import logmine
from tablesync.queries.registry import NOW, query
from tablesync.session import materialise, scratch_path
from tablesync.sources.logs import log_lines, write_log_files

_VALUE = "trim(substring(line, instr(line, ':') + 1))"


def _stat(label, name):
    return f"arg_max({_VALUE}, line_no) FILTER (contains(line, '{label}')) AS {name}"


_STATS = "SELECT log_id, " + ", ".join(_stat(text, name) for name, text in logmine.STAT_LABELS.items()) + " FROM run_log_lines GROUP BY log_id"


@query("parse_run_stats", f"""SELECT log_id, start_time, end_time, total_time, average_flow, write_speed,
  TRY_CAST(read_count AS BIGINT) AS read_count, TRY_CAST(fail_count AS BIGINT) AS fail_count FROM ({_STATS})""", "run_log_lines")
def parse_run_stats(t):
    return logmine.parse_run_stats(t.run_log_lines)


@query("parse_units", rf"""SELECT log_id, TRY_CAST(regexp_extract(total_time, '^([0-9.]+)\s*s$', 1) AS DOUBLE) AS total_s,
  TRY_CAST(regexp_extract(average_flow, '^([0-9.]+)\s*B/s$', 1) AS DOUBLE) AS bytes_per_s,
  TRY_CAST(regexp_extract(write_speed, '^([0-9.]+)\s*rec/s$', 1) AS DOUBLE) AS records_per_s FROM ({_STATS})""", "run_log_lines")
def parse_units(t):
    return logmine.parse_units(logmine.parse_run_stats(t.run_log_lines))


def _spans(task, begin, done, extra=""):
    return rf"""SELECT b.log_id, b.task, CASE WHEN e.at IS NOT NULL THEN 'D' ELSE 'R' END AS stat, b.at AS wake,
  coalesce(e.at, CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT)) AS done{extra}
FROM (SELECT log_id, line_no, line, regexp_extract(line, '(\d+\-)+{task}') AS task, CAST(epoch(CAST(substring(line, 1, 19) AS TIMESTAMP)) AS BIGINT) AS at
      FROM task_log WHERE regexp_matches(line, '(?i){begin}')) b
LEFT JOIN (SELECT log_id, regexp_extract(line, '(\d+\-)+{task}') AS task, CAST(epoch(CAST(substring(line, 1, 19) AS TIMESTAMP)) AS BIGINT) AS at
      FROM task_log WHERE regexp_matches(line, '(?i){done}')) e ON e.log_id = b.log_id AND e.task = b.task"""


_READ = _spans("reader", r"begin\s+to\s+read\s+record", r"finished\s+read\s+record",
               r""", lower(regexp_extract(h.line, '//(.*?)\?', 1)) AS host, lower(regexp_extract(b.line, '(?i)from\s+(\w+)(\s+where|\s*$)', 1)) AS path""") \
    + " LEFT JOIN task_log h ON h.log_id = b.log_id AND h.line_no = b.line_no + 1"
_WRITE = _spans("writer", r"begin\s+to\s+commit\s+blocks", r"commit\s+blocks\s+ok")
_SUMS = """SELECT log_id, count(*) FILTER (done - wake > -1) AS tasks, count(*) FILTER (done - wake <= -1) AS left_out, count(DISTINCT host) AS servers,
  CAST(coalesce(sum(done - wake) FILTER (done - wake > -1), 0) AS BIGINT) AS total_s,
  coalesce(nullif(max(done) FILTER (done - wake > -1) - min(wake) FILTER (done - wake > -1), 0), 1) AS wall_s,
  max(done - wake) AS max_cost FROM spans GROUP BY log_id"""


@query("read_task_spans", _READ, "task_log")
def read_task_spans(t):
    return logmine.read_task_spans(t.task_log, NOW)


@query("write_task_spans", _WRITE, "task_log")
def write_task_spans(t):
    return logmine.write_task_spans(t.task_log, NOW)


@query("task_profile", f"""WITH spans AS ({_READ}), sums AS ({_SUMS})
SELECT s.*, done - wake AS cost, round(100 * (done - wake) / wall_s, 8) AS share_pct,
  round((done - wake) * (tasks / coalesce(nullif(total_s, 0), wall_s)), 8) AS tilt FROM spans s JOIN sums USING (log_id)""", "task_log")
def task_profile(t):
    rows = logmine.task_profile(materialise(logmine.read_task_spans(t.task_log, NOW), "spans"))
    return rows.withColumns({c: F.round(c, 8) for c in ("share_pct", "tilt")})


@query("profile_summary", f"""WITH spans AS ({_READ}), sums AS ({_SUMS})
SELECT log_id, tasks, left_out, servers, total_s, round(total_s / tasks, 8) AS mean_s, wall_s, round(total_s / wall_s, 8) AS concurrency,
  round(max_cost * (tasks / coalesce(nullif(total_s, 0), wall_s)), 8) AS max_tilt FROM sums WHERE tasks > 0""", "task_log")
def profile_summary(t):
    rows = logmine.profile_summary(logmine.read_task_spans(t.task_log, NOW))
    return rows.withColumns({c: F.round(c, 8) for c in ("mean_s", "concurrency", "max_tilt")})


@query("log_tail", "SELECT log_id, line_no, line FROM run_log_lines WHERE line_no >= 4", "run_log_lines")
def log_tail(t):
    return logmine.log_tail(t.run_log_lines, 4)


@query("log_tail_status", """SELECT l.id AS log_id, 6 AS from_line, coalesce(r.to_line, 0) AS to_line, 6 > coalesce(r.to_line, 0) AND l.handle_code > 0 AS is_end
FROM job_log l LEFT JOIN (SELECT log_id, max(line_no) AS to_line FROM run_log_lines GROUP BY log_id) r ON r.log_id = l.id""", "job_log run_log_lines")
def log_tail_status(t):
    return logmine.log_tail_status(t.run_log_lines, t.job_log, 6)


def _through_files(t, lines):
    """The lines written as log files and read again."""
    return log_lines(t.spark, write_log_files(lines, scratch_path(t.spark, "log-files")))


_NUMBERED = "SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS line_no, line FROM task_log"


@query("log_files", _NUMBERED, "task_log")
def log_files(t):
    return _through_files(t, t.task_log)


@query("log_file_tail", f"""SELECT n.log_id, n.line_no, n.line, e.to_line FROM ({_NUMBERED}) n
JOIN (SELECT log_id, count(*) AS to_line FROM task_log GROUP BY log_id) e ON e.log_id = n.log_id WHERE n.line_no >= 20""", "task_log")
def log_file_tail(t):
    """What a reader that has seen 19 lines of each log gets next, and up to which line."""
    lines = materialise(_through_files(t, t.task_log), "numbered")
    ends = lines.groupBy("log_id").agg(F.max("line_no").alias("to_line"))
    return logmine.log_tail(lines, 20).join(ends, "log_id")
