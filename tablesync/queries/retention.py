"""Registered retention queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.operators import retention
from tablesync.queries.registry import NOW, query

_NEWEST = "ORDER BY trigger_time DESC, id DESC"


@query("clear_before_time", """SELECT id FROM job_log
WHERE job_group = 3 AND trigger_time <= TIMESTAMP '2024-01-15 12:00:00'""", "job_log")
def clear_before_time(t):
    return retention.clear_before_time(t.job_log, "2024-01-15 12:00:00", job_group=3)


@query("clear_keep_newest", f"""SELECT id FROM job_log WHERE job_group = 3
AND id NOT IN (SELECT id FROM job_log WHERE job_group = 3 {_NEWEST} LIMIT 500)""", "job_log")
def clear_keep_newest(t):
    return retention.clear_keep_newest(t.job_log, 500, job_group=3)


_MONTHS = {1: 1, 2: 3, 3: 6, 4: 12}
_KEPT = {5: 1_000, 6: 10_000, 7: 30_000, 8: 100_000}


@query("clear_by_type", " UNION ALL ".join(
    [f"SELECT {k} AS kind, id FROM job_log WHERE trigger_time <= TIMESTAMP '2024-02-20 12:00:00' - INTERVAL {m} MONTH" for k, m in _MONTHS.items()]
    + [f"SELECT {k}, id FROM job_log WHERE id NOT IN (SELECT id FROM job_log {_NEWEST} LIMIT {n})" for k, n in _KEPT.items()]
    + ["SELECT 9, id FROM job_log WHERE job_group = 1"]), "job_log")
def clear_by_type(t):
    def ids(kind, **scope):
        return retention.clear_by_type(t.job_log, kind, "2024-02-20 12:00:00", **scope).select(F.lit(kind).alias("kind"), "id")

    return reduce(DataFrame.unionAll, [*[ids(kind) for kind in range(1, 9)], ids(9, job_group=1)])


@query("retention_days", "SELECT id FROM job_log WHERE trigger_time <= TIMESTAMP '2024-01-20 00:00:00'", "job_log")
def retention_days(t):
    return retention.retention_days(t.job_log, NOW, 10)


@query("delete_ids", """SELECT id, job_id, handle_code FROM job_log
WHERE NOT (job_group = 2 AND trigger_time <= TIMESTAMP '2024-01-10 00:00:00')""", "job_log")
def delete_ids(t):
    gone = retention.clear_before_time(t.job_log, "2024-01-10 00:00:00", job_group=2)
    return retention.delete_ids(t.job_log, gone).select("id", "job_id", "handle_code")


_GONE = "job_group = 2"
_LEFT = f"NOT IN (SELECT id FROM job_info WHERE {_GONE})"


@query("cascade_delete", f"""
SELECT 'job_info' AS table_name, count(*) AS remaining, CAST(sum(id) AS BIGINT) AS id_sum FROM job_info WHERE id {_LEFT}
UNION ALL SELECT 'job_log', count(*), CAST(sum(id) AS BIGINT) FROM job_log WHERE job_id {_LEFT}
UNION ALL SELECT 'job_logglue', count(*), CAST(sum(id) AS BIGINT) FROM job_logglue WHERE job_id {_LEFT}""", "job_info job_log job_logglue")
def cascade_delete(t):
    kept = retention.cascade_delete(t.job_info, t.job_log, t.job_logglue, t.job_info.where(_GONE))
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("remaining"), F.sum("id").alias("id_sum"))
        for name, df in zip(("job_info", "job_log", "job_logglue"), kept)
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("keep_latest_versions", """SELECT id, job_id, glue_remark, update_time FROM job_logglue
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY update_time DESC, id DESC) > 5""", "job_logglue")
def keep_latest_versions(t):
    return retention.keep_latest_versions(t.job_logglue, 5)


@query("version_history", "SELECT id, job_id, glue_remark, update_time FROM job_logglue WHERE job_id = 7 ORDER BY id DESC", "job_logglue")
def version_history(t):
    return retention.version_history(t.job_logglue, 7)


@query("expire_date_dirs", """
SELECT name FROM (SELECT DISTINCT strftime(trigger_time, '%Y-%m-%d') AS name FROM job_log
                  UNION SELECT DISTINCT 'job-' || CAST(job_id AS VARCHAR) FROM job_log)
WHERE try_strptime(name, '%Y-%m-%d') <= TIMESTAMP '2024-01-20 00:00:00'""", "job_log")
def expire_date_dirs(t):
    dated = t.job_log.select(F.date_format("trigger_time", "yyyy-MM-dd").alias("name"))
    other = t.job_log.select(F.concat(F.lit("job-"), F.col("job_id").cast("string")).alias("name"))
    names = dated.distinct().unionByName(other.distinct())
    return retention.expire_date_dirs(names, NOW, 10)
