"""Registered queries over the run log, each with its SQL twin."""

from tablesync.operators import runs
from tablesync.queries.registry import NOW, query

RANGE = ("2024-01-05 00:00:00", "2024-01-20 23:59:59")
_BETWEEN = f"trigger_time BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'"
_UNFINISHED = "(trigger_code IN (0, 200) AND handle_code = 0)"
_FAIL = f"NOT ({_UNFINISHED} OR handle_code = 200) AND alarm_status = 0"
_DAILY = f"""SELECT CAST(trigger_time AS DATE) AS trigger_day,
  CAST(sum(CASE WHEN {_UNFINISHED} THEN 1 ELSE 0 END) AS BIGINT) AS running_count,
  CAST(sum(CASE WHEN handle_code = 200 THEN 1 ELSE 0 END) AS BIGINT) AS suc_count,
  CAST(count(handle_code) - sum(CASE WHEN {_UNFINISHED} THEN 1 ELSE 0 END) - sum(CASE WHEN handle_code = 200 THEN 1 ELSE 0 END) AS BIGINT) AS fail_count
FROM job_log GROUP BY 1"""
_LOG = ["id", "job_id", "trigger_time", "trigger_code", "handle_code"]


@query("log_page", f"""
SELECT id, job_id, trigger_time, trigger_code, handle_code FROM job_log
WHERE job_group = 2 AND {_BETWEEN} AND (trigger_code NOT IN (0, 200) OR handle_code NOT IN (0, 200))
ORDER BY trigger_time DESC, id DESC LIMIT 20 OFFSET 10""", "job_log")
def log_page(t):
    rows = runs.log_page(t.job_log, 10, 20, job_group=2, start=RANGE[0], end=RANGE[1], status=runs.STATUS_FAILED)
    return rows.select(_LOG)


@query("log_page_deep", """SELECT id, job_id, trigger_time, trigger_code, handle_code FROM job_log
ORDER BY trigger_time DESC, id DESC LIMIT 25 OFFSET 7000""", "job_log")
def log_page_deep(t):
    """A page far down the log, cut out by counting."""
    return runs.log_page(t.job_log, 7000, 25, deep=1000).select(_LOG)


@query("log_page_count", f"""
SELECT count(*) AS total FROM job_log
WHERE job_group = 2 AND {_BETWEEN} AND (trigger_code NOT IN (0, 200) OR handle_code NOT IN (0, 200))""", "job_log")
def log_page_count(t):
    return runs.log_count(t.job_log, job_group=2, start=RANGE[0], end=RANGE[1], status=runs.STATUS_FAILED)


@query("log_status_success", "SELECT id, job_id, trigger_time, trigger_code, handle_code FROM job_log WHERE handle_code = 200", "job_log")
def log_status_success(t):
    return runs.filter_log(t.job_log, status=runs.STATUS_SUCCESS).select(_LOG)


@query("log_status_failed", """SELECT id, job_id, trigger_time, trigger_code, handle_code FROM job_log
WHERE trigger_code NOT IN (0, 200) OR handle_code NOT IN (0, 200)""", "job_log")
def log_status_failed(t):
    return runs.filter_log(t.job_log, status=runs.STATUS_FAILED).select(_LOG)


@query("log_status_running", """SELECT id, job_id, trigger_time, trigger_code, handle_code FROM job_log
WHERE trigger_code = 200 AND handle_code = 0""", "job_log")
def log_status_running(t):
    return runs.filter_log(t.job_log, status=runs.STATUS_RUNNING).select(_LOG)


@query("log_report", f"""SELECT count(handle_code) AS day_count,
  CAST(coalesce(sum(CASE WHEN {_UNFINISHED} THEN 1 ELSE 0 END), 0) AS BIGINT) AS running_count,
  CAST(coalesce(sum(CASE WHEN handle_code = 200 THEN 1 ELSE 0 END), 0) AS BIGINT) AS suc_count
FROM job_log WHERE {_BETWEEN}""", "job_log")
def log_report(t):
    return runs.log_report(t.job_log, *RANGE)


@query("log_count_by_day", f"""SELECT strftime(trigger_time, '%Y-%m-%d') AS trigger_day, count(handle_code) AS day_count,
  CAST(sum(CASE WHEN {_UNFINISHED} THEN 1 ELSE 0 END) AS BIGINT) AS running_count,
  CAST(sum(CASE WHEN handle_code = 200 THEN 1 ELSE 0 END) AS BIGINT) AS suc_count
FROM job_log WHERE {_BETWEEN} GROUP BY 1 ORDER BY 1""", "job_log")
def log_count_by_day(t):
    return runs.log_count_by_day(t.job_log, *RANGE)


@query("log_daily_report", f"""SELECT CAST(d.day AS DATE) AS trigger_day, coalesce(r.running_count, 0) AS running_count,
  coalesce(r.suc_count, 0) AS suc_count, coalesce(r.fail_count, 0) AS fail_count
FROM (VALUES (DATE '2024-01-30'), (DATE '2024-01-29'), (DATE '2024-01-28')) d(day)
LEFT JOIN ({_DAILY}) r ON r.trigger_day = d.day""", "job_log")
def log_daily_report(t):
    return runs.log_daily_report(t.job_log, NOW)


@query("log_report_upsert", f"""
WITH old AS ({_DAILY.replace('FROM job_log', "FROM job_log WHERE trigger_time < TIMESTAMP '2024-01-29 06:00:00'")}),
fresh AS (SELECT * FROM ({_DAILY}) WHERE trigger_day BETWEEN DATE '2024-01-28' AND DATE '2024-01-30')
SELECT * FROM old WHERE trigger_day NOT IN (SELECT trigger_day FROM fresh) UNION ALL SELECT * FROM fresh""", "job_log")
def log_report_upsert(t):
    stale = runs.daily_report(t.job_log.where("trigger_time < TIMESTAMP_NTZ '2024-01-29 06:00:00'"))
    return runs.log_report_upsert(stale, runs.log_daily_report(t.job_log, NOW))


@query("report_range", f"SELECT * FROM ({_DAILY}) WHERE trigger_day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' ORDER BY trigger_day", "job_log")
def report_range(t):
    return runs.report_range(runs.daily_report(t.job_log), *RANGE)


@query("report_total", f"""SELECT CAST(sum(running_count) AS BIGINT) AS running_count, CAST(sum(suc_count) AS BIGINT) AS suc_count,
CAST(sum(fail_count) AS BIGINT) AS fail_count FROM ({_DAILY})""", "job_log")
def report_total(t):
    return runs.report_total(runs.daily_report(t.job_log))


@query("chart_info", f"""SELECT strftime(trigger_day, '%Y-%m-%d') AS trigger_day, running_count, suc_count, fail_count,
  CAST(sum(running_count) OVER () AS BIGINT) AS running_total, CAST(sum(suc_count) OVER () AS BIGINT) AS suc_total,
  CAST(sum(fail_count) OVER () AS BIGINT) AS fail_total
FROM ({_DAILY}) WHERE trigger_day BETWEEN TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND TIMESTAMP '{NOW}'""", "job_log")
def chart_info(t):
    return runs.chart_info(runs.daily_report(t.job_log.where(f"trigger_time >= TIMESTAMP_NTZ '{NOW}' - INTERVAL '8' DAY")), NOW)


@query("dashboard_info", f"""SELECT (SELECT count(*) FROM job_info) AS job_info_count,
  CAST((SELECT sum(running_count + suc_count + fail_count) FROM ({_DAILY})) AS BIGINT) AS job_log_count,
  CAST((SELECT sum(suc_count) FROM ({_DAILY})) AS BIGINT) AS job_log_success_count,
  (SELECT count(DISTINCT a) FROM (SELECT unnest(string_split(address_list, ',')) AS a FROM job_group)) AS executor_count""",
       "job_log job_info job_group")
def dashboard_info(t):
    return runs.dashboard_info(t.job_info, runs.daily_report(t.job_log), t.job_group)


@query("fail_candidates", f"SELECT id, job_id, trigger_time, trigger_code, handle_code FROM job_log WHERE {_FAIL}", "job_log")
def fail_candidates(t):
    return runs.fail_candidates(t.job_log).select(_LOG)


@query("retry_candidates", f"""SELECT id AS failed_log_id, job_id, executor_fail_retry_count - 1 AS executor_fail_retry_count,
  executor_sharding_param, executor_param
FROM job_log WHERE {_FAIL} AND executor_fail_retry_count > 0""", "job_log")
def retry_candidates(t):
    return runs.retry_candidates(t.job_log)


@query("alarm_status_next", f"""SELECT l.id, l.job_id, CASE WHEN trim(coalesce(i.alarm_email, '')) <> '' THEN 2 ELSE 1 END AS alarm_status
FROM (SELECT * FROM job_log WHERE {_FAIL}) l LEFT JOIN job_info i ON i.id = l.job_id""", "job_log job_info")
def alarm_status_next(t):
    return runs.alarm_status_next(t.job_log, t.job_info)


@query("alarm_recipients", f"""SELECT DISTINCT l.id, l.job_id, unnest(string_split(i.alarm_email, ',')) AS email
FROM (SELECT * FROM job_log WHERE {_FAIL}) l JOIN job_info i ON i.id = l.job_id WHERE trim(i.alarm_email) <> ''""", "job_log job_info")
def alarm_recipients(t):
    return runs.alarm_recipients(t.job_log, t.job_info)


@query("alarm_content", f"""SELECT id, 'Alarm Job LogId=' || CAST(id AS VARCHAR)
  || CASE WHEN trigger_code <> 200 THEN '<br>TriggerMsg=<br>' || coalesce(trigger_msg, 'null') ELSE '' END
  || CASE WHEN handle_code > 0 AND handle_code <> 200 THEN '<br>HandleCode=' || coalesce(handle_msg, 'null') ELSE '' END AS content
FROM job_log WHERE {_FAIL}""", "job_log")
def alarm_content(t):
    return runs.alarm_content(t.job_log)


@query("job_last_status", """SELECT job_id, handle_code AS last_handle_code FROM job_log WHERE handle_time IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY handle_time DESC, id DESC) = 1""", "job_log")
def job_last_status(t):
    return runs.job_last_status(t.job_log)


@query("run_duration", """SELECT l.id, l.job_id, date_diff('second', trigger_time, handle_time) AS duration_s,
  coalesce(i.executor_timeout > 0 AND date_diff('second', trigger_time, handle_time) > i.executor_timeout * 60, false) AS over_limit,
  handle_code = 502 AS timed_out
FROM job_log l LEFT JOIN job_info i ON i.id = l.job_id WHERE handle_time IS NOT NULL""", "job_log job_info")
def run_duration(t):
    return runs.run_duration(t.job_log, t.job_info)


@query("run_duration_stats", """SELECT job_id, count(*) AS runs, min(s) AS min_s, max(s) AS max_s, quantile_disc(s, 0.5) AS p50_s, quantile_disc(s, 0.95) AS p95_s
FROM (SELECT job_id, date_diff('second', trigger_time, handle_time) AS s FROM job_log WHERE handle_time IS NOT NULL) GROUP BY job_id""", "job_log")
def run_duration_stats(t):
    return runs.run_duration_stats(t.job_log)


@query("log_lifecycle", """SELECT log_id, max(CASE WHEN kind = 'trigger' THEN event_time END) AS trigger_time,
  max(CASE WHEN kind = 'trigger' THEN code END) AS trigger_code, max(process_id) AS process_id,
  max(CASE WHEN kind = 'handle' THEN event_time END) AS handle_time,
  coalesce(max(CASE WHEN kind = 'handle' THEN code END), 0) AS handle_code
FROM run_events GROUP BY log_id""", "run_events")
def log_lifecycle(t):
    return runs.log_lifecycle(t.run_events)
