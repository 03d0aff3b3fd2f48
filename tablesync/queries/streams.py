"""Registered streaming queries: the given tables as file streams, run until nothing is left."""

from pyspark.sql import functions as F

from tablesync.operators.registry import registry_alive
from tablesync.plans.sync import SyncSpec, target_rows
from tablesync.queries.executors import _LATEST
from tablesync.queries.registry import NOW, query
from tablesync.queries.runs import _DAILY, _FAIL
from tablesync.session import scratch_path
from tablesync.sinks.buckets import read_buckets
from tablesync.streaming import streams


def _places(t, label):
    root = scratch_path(t.spark, label)
    return f"{root}/data", f"{root}/checkpoint"


@query("stream_daily_report", _DAILY, "job_log")
def stream_daily_report(t):
    data, checkpoint = _places(t, "daily")
    streams.stream_daily_report(t.streams().job_log, data, checkpoint)
    return streams.read_daily_report(t.spark, data)


@query("stream_report_windows", _DAILY, "job_log")
def stream_report_windows(t):
    data, checkpoint = _places(t, "windows")
    streams.stream_report_windows(t.streams().job_log, data, checkpoint)
    return streams.read_report_windows(t.spark, data)


@query("stream_callback_dedup", "SELECT event_id AS log_id, event_type AS source FROM events")
def stream_callback_dedup(t):
    data, checkpoint = _places(t, "callbacks")
    once = F.struct(F.col("event_id").alias("log_id"), F.col("event_type").alias("source"), F.col("ts").alias("arrived"))
    copies = F.when(F.col("event_type") == "click", F.array(once, once, once)).otherwise(F.array(once))
    streams.stream_callback_dedup(t.streams().events.select(F.inline(copies)), data, checkpoint)
    return streams.read_batches(t.spark, data).select("log_id", "source")


@query("stream_registry_state", f"""SELECT registry_key, registry_value, cpu_usage, update_time,
  update_time > TIMESTAMP '{NOW}' - INTERVAL 3600 SECOND AS alive FROM ({_LATEST})""", "job_registry")
def stream_registry_state(t):
    data, checkpoint = _places(t, "registry")
    streams.stream_registry_state(t.streams().job_registry, data, checkpoint)
    state = read_buckets(t.spark, data).select("registry_key", "registry_value", "cpu_usage", "update_time")
    alive = registry_alive(state, NOW, 3600).select("registry_key", "registry_value", F.lit(True).alias("alive"))
    return state.join(alive, ["registry_key", "registry_value"], "left").withColumn("alive", F.coalesce("alive", F.lit(False)))


@query("stream_fail_alerts", f"SELECT id, job_id, trigger_time, executor_fail_retry_count AS retries_left FROM job_log WHERE {_FAIL}", "job_log")
def stream_fail_alerts(t):
    data, checkpoint = _places(t, "alerts")
    streams.stream_fail_alerts(t.streams().job_log, data, checkpoint)
    return streams.read_batches(t.spark, data).select("id", "job_id", "trigger_time", "retries_left")


def _orders_spec(target):
    return SyncSpec(
        lambda spark: None, target, ["o_orderkey", "o_orderstatus", "o_totalprice"], ["id", "state", "amount"],
        mode="upsert", upsert_keys=["id"], upsert_order=["amount"],
    )


@query("inc_stream", "SELECT o_orderkey AS id, o_orderstatus AS state, o_totalprice AS amount FROM orders")
def inc_stream(t):
    data, checkpoint = _places(t, "orders")
    spec = _orders_spec(data)
    streams.stream_sync(t.streams().orders, spec, checkpoint)
    streams.stream_sync(t.streams().orders, spec, checkpoint)  # nothing new has arrived: the state stays
    return target_rows(t.spark, spec)


@query("stream_sync", """SELECT event_id AS id, ts AS at, value AS amount FROM events WHERE event_id % 9 <> 0""")
def stream_sync(t):
    data, checkpoint = _places(t, "events")
    spec = SyncSpec(
        lambda spark: None, data, ["f_id", "f_ts", "f_value"], ["id", "at", "amount"], types={"id": "long", "at": "date", "amount": "double"},
        mode="upsert", upsert_keys=["id"], upsert_order=["at"], max_dirty_records=None, max_dirty_ratio=0.2,
    )
    streams.stream_sync(t.streams().raw_events, spec, checkpoint)
    return target_rows(t.spark, spec)
