"""Registered scalar functions, each applied to a whole table."""

from pyspark.sql import functions as F

from tablesync.functions import credentials, dates, sources
from tablesync.functions.jobs import job_contents
from tablesync.operators.common import dealt
from tablesync.queries.registry import query

_TYPES = """CASE WHEN starts_with(jdbc_url, 'jdbc:mysql:') OR starts_with(jdbc_url, 'jdbc:log4jdbc:mysql:') THEN 'mysql'
  WHEN starts_with(jdbc_url, 'jdbc:oracle:') THEN 'oracle' WHEN starts_with(jdbc_url, 'jdbc:sqlserver:') THEN 'sqlserver'
  WHEN starts_with(jdbc_url, 'jdbc:postgresql:') THEN 'postgresql' WHEN starts_with(jdbc_url, 'jdbc:clickhouse:') THEN 'clickhouse'
  WHEN starts_with(jdbc_url, 'jdbc:hive2:') THEN 'hive' END"""


@query("sources_by_type", f"SELECT {_TYPES} AS db_type, count(*) AS sources FROM job_datasource GROUP BY 1", "job_datasource")
def sources_by_type(t):
    return sources.sources_by_type(t.job_datasource)


@query("fn_encrypt", """SELECT id, jdbc_username AS restored, CASE WHEN jdbc_username IS NOT NULL THEN 24 END AS cipher_length
  FROM job_datasource""", "job_datasource")
def fn_encrypt(t):
    """Encrypt and decrypt again."""
    cipher = credentials.encrypt(F.col("jdbc_username"), "a seed")
    return t.job_datasource.select("id", credentials.decrypt(cipher, "a seed").alias("restored"), F.length(cipher).alias("cipher_length"))


@query("fn_ensure_encrypted", """SELECT id, jdbc_username AS restored, comments IS NOT NULL AS was_encrypted,
  CASE WHEN jdbc_username IS NOT NULL THEN TRUE END AS encrypted_once FROM job_datasource""", "job_datasource")
def fn_ensure_encrypted(t):
    """Some stored names are encrypted already; afterwards all are, each once."""
    cipher = credentials.encrypt(F.col("jdbc_username"), "a seed")
    stored = F.when(F.col("comments").isNotNull(), cipher).otherwise(F.col("jdbc_username"))
    rows = t.job_datasource.select("id", "comments", cipher.alias("cipher"), credentials.ensure_encrypted(stored, "a seed").alias("ensured"))
    return rows.select(
        "id", credentials.decrypt(F.col("ensured"), "a seed").alias("restored"), F.col("comments").isNotNull().alias("was_encrypted"),
        (F.col("ensured") == F.col("cipher")).alias("encrypted_once"),
    )


@query("fn_mask_json_credentials", """SELECT id, json_extract_string(job_json, '$.job.content[0].reader.parameter.username') AS username,
  json_extract_string(job_json, '$.job.content[0].writer.parameter.password') AS password,
  json_extract_string(job_json, '$.job.content[0].reader.parameter.column[1]') AS second_column,
  CAST(json_extract_string(job_json, '$.job.setting.speed.channel') AS INTEGER) AS channel, TRUE AS hidden FROM job_json""", "job_json")
def fn_mask_json_credentials(t):
    """Encrypt inside the job text, check that the clear text is gone, and decrypt again."""
    jobs = dealt(t.job_json, "id", "job_json")
    masked = jobs.withColumn("masked", credentials.encrypt_job(F.col("job_json"), "a seed"))
    clear = masked.withColumn("clear", credentials.decrypt_job(F.col("masked"), "a seed"))
    content = "$.job.content[0]"
    return clear.select(
        "id", F.get_json_object("clear", f"{content}.reader.parameter.username").alias("username"),
        F.get_json_object("clear", f"{content}.writer.parameter.password").alias("password"),
        F.get_json_object("masked", f"{content}.reader.parameter.column[1]").alias("second_column"),
        F.get_json_object("masked", "$.job.setting.speed.channel").cast("int").alias("channel"),
        (~F.contains("masked", F.lit('"password":"q"'))).alias("hidden"),
    )


@query("fn_json_path", """SELECT id, json_extract_string(job_json, '$.job.content[0].reader.name') AS reader_name,
  array_to_string(CAST(json_extract(job_json, '$.job.content[0].reader.parameter.connection[0].table') AS VARCHAR[]), ',') AS reader_tables,
  array_to_string(CAST(json_extract(job_json, '$.job.content[0].reader.parameter.column') AS VARCHAR[]), ',') AS reader_columns,
  json_extract_string(job_json, '$.job.content[0].writer.name') AS writer_name FROM job_json""", "job_json")
def fn_json_path(t):
    rows = job_contents(t.job_json, "job_json", "id")
    return rows.select("id", "reader_name", F.array_join("reader_tables", ",").alias("reader_tables"),
                       F.array_join("reader_columns", ",").alias("reader_columns"), "writer_name")


@query("fn_date_add", """SELECT event_id, ts + INTERVAL 2 YEAR AS plus_years, ts + INTERVAL 13 MONTH AS plus_months, ts - INTERVAL 45 DAY AS minus_days FROM events""")
def fn_date_add(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id", dates.add_to_date(ts, years=2).alias("plus_years"), dates.add_to_date(ts, months=13).alias("plus_months"),
        dates.add_to_date(ts, days=-45).alias("minus_days"),
    )


@query("fn_date_format", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS as_date, strftime(ts, '%Y-%m-%d %H:%M:%S') AS as_datetime,
  strftime(ts, '%Y%m%d%H%M') AS as_compact FROM events""")
def fn_date_format(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id", dates.format_date(ts, dates.DATE_PATTERN).alias("as_date"), dates.format_date(ts).alias("as_datetime"),
        dates.format_date(ts, "yyyyMMddHHmm").alias("as_compact"),
    )


@query("fn_date_parse", """SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS parsed,
  CAST(NULL AS TIMESTAMP) AS unfit FROM events""")
def fn_date_parse(t):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.date_format("ts", dates.DATETIME_PATTERN))
    return t.events.select("event_id", dates.parse_date(text).alias("parsed"), dates.parse_date(text, "yyyy/MM/dd").alias("unfit"))


@query("error_classes", """SELECT CASE
  WHEN db_type = 'mysql' AND contains(message, 'Unknown database') THEN 'MYSQL_CONN_DB_ERROR'
  WHEN db_type = 'mysql' AND contains(message, 'Communications link failure') THEN 'MYSQL_CONN_IPPORT_ERROR'
  WHEN db_type = 'mysql' AND contains(message, 'Access denied') THEN 'MYSQL_CONN_USERPWD_ERROR'
  WHEN db_type = 'mysql' AND contains(message, 'Table') AND contains(message, 'doesn''t exist') THEN 'MYSQL_QUERY_TABLE_NAME_ERROR'
  WHEN db_type = 'mysql' AND contains(message, 'Unknown column') AND contains(message, 'field list') THEN 'MYSQL_QUERY_COLUMN_ERROR'
  WHEN db_type = 'mysql' AND contains(message, 'where clause') THEN 'MYSQL_QUERY_SQL_ERROR'
  WHEN db_type = 'oracle' AND contains(message, 'ORA-12505') THEN 'ORACLE_CONN_DB_ERROR'
  WHEN db_type = 'oracle' AND contains(message, 'ORA-01017') THEN 'ORACLE_CONN_USERPWD_ERROR'
  WHEN db_type = 'oracle' AND contains(message, 'table or view does not exist') THEN 'ORACLE_QUERY_TABLE_NAME_ERROR'
  WHEN db_type = 'oracle' AND contains(message, 'invalid identifier') THEN 'ORACLE_QUERY_SQL_ERROR'
  WHEN db_type = 'oracle' AND contains(message, 'insufficient privileges') THEN 'ORACLE_QUERY_SELECT_PRI_ERROR'
  WHEN db_type IN ('mysql', 'oracle') THEN 'READ_RECORD_FAIL' ELSE 'SQL_EXECUTE_FAIL' END AS error_class, count(*) AS messages
FROM run_messages GROUP BY 1""", "run_messages")
def error_classes(t):
    return sources.error_classes(t.run_messages)


@query("parse_jdbc_host", """SELECT id, lower(CASE WHEN b LIKE '%@%' THEN substring(b, instr(b, '@') + 1) WHEN b LIKE '%//%' THEN substring(b, instr(b, '//') + 2) ELSE b END) AS host
FROM (SELECT id, string_split(jdbc_url, '?')[1] AS b FROM job_datasource)""", "job_datasource")
def parse_jdbc_host(t):
    return t.job_datasource.select("id", sources.jdbc_host(F.col("jdbc_url")).alias("host"))


@query("parse_sql_table", r"""SELECT log_id, line_no, lower(regexp_extract(line, '(?i)from\s+(\w+)(\s+where|\s*$)', 1)) AS sql_table FROM task_log""", "task_log")
def parse_sql_table(t):
    return t.task_log.select("log_id", "line_no", sources.sql_table(F.col("line")).alias("sql_table"))
