"""Registered forecasts of the run history."""

from tablesync.operators import runs
from tablesync.queries.registry import query


@query("next_fire_times", """SELECT job_id, count(*) AS runs, max(trigger_time) AS last_start,
  CASE WHEN count(*) > 1 THEN max(trigger_time) + to_microseconds(date_diff('microsecond', min(trigger_time), max(trigger_time)) // (count(*) - 1)) END AS next_start
FROM job_log GROUP BY job_id""", "job_log")
def next_fire_times(t):
    return runs.next_starts(t.job_log)
