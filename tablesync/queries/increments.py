"""Registered incremental windows and watermarks."""

from pyspark.sql import functions as F

from tablesync.operators import increment as inc
from tablesync.operators.common import upsert
from tablesync.plans.incremental import IncrementState, QuerySource, run_incremental, stored_state
from tablesync.plans.sync import SyncSpec, target_rows
from tablesync.queries.registry import query
from tablesync.session import scratch_path


@query("inc_time_window", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 08:30:15'")
def inc_time_window(t):
    return inc.time_window(t.events, "ts", "2024-01-05 00:00:00", "2024-01-12 08:30:15.987").select("event_id", "ts")


@query("inc_time_formats", """SELECT id, CAST(CAST(floor(epoch(trigger_time)) AS BIGINT) AS VARCHAR) AS as_epoch, strftime(trigger_time, '%Y/%m/%d') AS as_date,
  strftime(trigger_time, '%H:%M:%S') AS as_time, strftime(trigger_time, '%Y/%m/%d %H:%M:%S') AS as_datetime,
  strftime(trigger_time, '%Y-%m-%d') AS as_iso_date, strftime(trigger_time, '%Y-%m-%d %H:%M:%S') AS as_iso FROM job_log""", "job_log")
def inc_time_formats(t):
    names = ["as_epoch", "as_date", "as_time", "as_datetime", "as_iso_date", "as_iso"]
    bounds = [inc.format_bound(F.col("trigger_time"), fmt).alias(n) for n, fmt in zip(names, inc.TIME_FORMATS)]
    return t.job_log.select("id", *bounds)


@query("inc_id_window", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 500 AND o_orderkey < (SELECT max(o_orderkey) FROM orders)")
def inc_id_window(t):
    bound = inc.max_id(t.orders, "o_orderkey").scalar()
    return inc.id_window(t.orders, "o_orderkey", 500, bound).select("o_orderkey", "o_totalprice")


@query("max_id", "SELECT coalesce(max(o_orderkey), 0) AS max_id FROM orders")
def max_id(t):
    return inc.max_id(t.orders, "o_orderkey")


_PARTITION_DAY = "CAST(trigger_time AS DATE) + CAST(run_id % 5 - 2 AS INTEGER)"


@query("inc_partition", f"""SELECT run_id, 'p_day=' || CASE CAST(run_id % 3 AS INTEGER) WHEN 0 THEN strftime({_PARTITION_DAY}, '%Y-%m-%d')
  WHEN 1 THEN strftime({_PARTITION_DAY}, '%Y%m%d') ELSE strftime({_PARTITION_DAY}, '%Y/%m/%d') END AS partition_spec FROM job_partition""", "job_partition")
def inc_partition(t):
    return t.job_partition.select("run_id", inc.partition_spec(F.col("partition_info"), F.col("trigger_time")).alias("partition_spec"))


_DONE = "(SELECT job_id, arg_max(max_id, id) AS max_id, arg_max(trigger_time, id) AS trigger_time FROM job_log WHERE handle_code = 200 GROUP BY job_id)"


@query("advance_watermark", f"""SELECT i.id, i.increment_type, CASE WHEN i.increment_type = 1 AND d.job_id IS NOT NULL THEN d.max_id ELSE i.inc_start_id END AS inc_start_id,
  CASE WHEN i.increment_type = 2 AND d.job_id IS NOT NULL THEN d.trigger_time ELSE i.inc_start_time END AS inc_start_time
FROM job_info i LEFT JOIN {_DONE} d ON d.job_id = i.id""", "job_info job_log")
def advance_watermark(t):
    return inc.advance_watermark(t.job_info, t.job_log).select("id", "increment_type", "inc_start_id", "inc_start_time")


@query("retry_same_window", """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00'""")
def retry_same_window(t):
    def window(end):
        return inc.time_window(t.orders, "o_orderdate", "1996-01-01 00:00:00", end).select("o_orderkey", "o_totalprice")

    # The first run wrote rows but failed to report, so its retry reads the same start again.
    return upsert(window("1997-01-01 00:00:00"), window("1998-01-01 00:00:00"), ["o_orderkey"])


@query("inc_chain", """SELECT id, job_id, coalesce(last_value(CASE WHEN handle_code = 200 THEN trigger_time END IGNORE NULLS)
    OVER (PARTITION BY job_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TIMESTAMP '2024-01-01 00:00:00') AS window_start,
  trigger_time AS window_end, handle_code FROM job_log""", "job_log")
def inc_chain(t):
    return inc.inc_chain(t.job_log, "2024-01-01 00:00:00")


@query("inc_gap_overlap", """SELECT run_id, job_id, previous_end, window_start, CASE WHEN window_start > previous_end THEN 'gap' ELSE 'overlap' END AS kind,
  abs(date_diff('microsecond', previous_end, window_start)) AS micros
FROM (SELECT *, lag(window_end) OVER (PARTITION BY job_id ORDER BY run_id) AS previous_end FROM sync_windows) WHERE window_start <> previous_end""", "sync_windows")
def inc_gap_overlap(t):
    return inc.inc_gap_overlap(t.sync_windows)


@query("inc_run", """SELECT o_orderkey AS id, o_orderstatus AS state, o_totalprice AS amount, o_orderdate AS placed FROM orders
WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00'""")
def inc_run(t):
    """Two runs in a row; the second starts where the first ended and merges by key."""
    spec = SyncSpec(
        lambda spark: t.orders, scratch_path(t.spark, "ods_orders"), ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"],
        ["id", "state", "amount", "placed"], mode="upsert", upsert_keys=["id"], upsert_order=["placed"],
    )
    state = IncrementState(inc.INC_TIME, "o_orderdate", start_time="1995-01-01 00:00:00")
    _, state = run_incremental(t.spark, spec, state, "1997-01-01 00:00:00")
    run_incremental(t.spark, spec, state, "1999-01-01 00:00:00")
    return target_rows(t.spark, spec)


@query("inc_run_id", """SELECT o_orderkey AS id, o_totalprice AS amount FROM orders
WHERE o_orderkey >= 100 AND o_orderkey < (SELECT max(o_orderkey) FROM orders)""")
def inc_run_id(t):
    """An id job; the second run starts at the stored mark and finds nothing new."""
    spec = SyncSpec(lambda spark: t.orders, scratch_path(t.spark, "ods_ids"), ["o_orderkey", "o_totalprice"], ["id", "amount"], mode="append")
    first = IncrementState(inc.INC_ID, "o_orderkey", start_id=100)
    for _ in range(2):
        run_incremental(t.spark, spec, stored_state(t.spark, spec, first), "2024-01-02 00:00:00")
    return target_rows(t.spark, spec)


@query("inc_partition_run", """SELECT event_id AS id, value AS amount, strftime(ts, '%Y%m%d') AS p_day FROM events
WHERE ts >= TIMESTAMP '2024-01-09 00:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00'""")
def inc_partition_run(t):
    """A partition job: each run moves the day before it."""
    rows = t.events.select("event_id", "value", F.date_format("ts", "yyyyMMdd").alias("p_day"))
    spec = SyncSpec(lambda spark: rows, scratch_path(t.spark, "ods_days"), ["event_id", "value", "p_day"], ["id", "amount", "p_day"], mode="append")
    state = IncrementState(inc.INC_PARTITION, "p_day", partition="p_day,-1,yyyyMMdd")
    for now in ("2024-01-10 08:00:00", "2024-01-11 08:00:00"):
        run_incremental(t.spark, spec, state, now)
    return target_rows(t.spark, spec)


@query("inc_run_query", """SELECT o_orderkey AS id, o_totalprice AS amount FROM orders
WHERE o_orderdate >= TIMESTAMP '1995-06-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-06-01 00:00:00' AND o_orderstatus = 'F'""")
def inc_run_query(t):
    """A time job whose rows come from a user's query; the bounds are bound in the format the job asks for."""
    source = QuerySource("""SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = 'F'
        AND o_orderdate >= CAST('${lastTime}' AS TIMESTAMP_NTZ) AND o_orderdate < CAST(${currentTime} AS TIMESTAMP_NTZ)""", {"orders": t.orders})
    spec = SyncSpec(lambda spark: t.orders, scratch_path(t.spark, "ods_query"), ["o_orderkey", "o_totalprice"], ["id", "amount"], mode="append")
    state = IncrementState(inc.INC_TIME, "o_orderdate", start_time="1995-06-01 00:00:00", time_format="yyyy-MM-dd HH:mm:ss")
    for now in ("1997-01-01 00:00:00", "1998-06-01 00:00:00"):
        _, state = run_incremental(t.spark, spec, state, now, source)
    return target_rows(t.spark, spec)
