"""Streams against the same computation in batch, over several batches and restarts."""

import pytest
from pyspark.sql import functions as F

from tablesync.operators import registry
from tablesync.operators.mapping import ErrorLimitExceeded
from tablesync.operators.runs import daily_report
from tablesync.plans.sync import SyncSpec, target_rows
from tablesync.session import scratch_path
from tablesync.streaming import streams


@pytest.fixture
def feed(spark):
    """A folder that receives files, and the stream that reads it."""
    path = scratch_path(spark, "feed")

    def add(df):
        df.coalesce(1).write.mode("append").parquet(path)
        return streams.stream_files(spark, path, df.schema)

    return add


def test_daily_report_over_three_arrivals(spark, tables, feed, rows):
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")
    log = tables.job_log
    parts = [log.where("trigger_time < '2024-01-10'"), log.where("trigger_time >= '2024-01-10' AND trigger_time < '2024-01-20 12:00:00'"), log.where("trigger_time >= '2024-01-20 12:00:00'")]
    for part in parts:
        streams.stream_daily_report(feed(part), out, checkpoint)
    assert rows(streams.read_daily_report(spark, out)) == rows(daily_report(log).select("trigger_day", "running_count", "suc_count", "fail_count"))


def test_windows_with_a_state_lose_nothing_that_is_late(spark, tables, feed, rows):
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")
    log = tables.job_log.withColumn("trigger_time", F.when(F.col("id") % 50 != 7, F.col("trigger_time")))
    late = F.col("id") % 5 == 1
    parts = [log.where("trigger_time < '2024-01-10'").where(~late), log.where("trigger_time >= '2024-01-10'").where(~late), log.where(late), log.where(F.col("trigger_time").isNull()).where(~late)]
    ends = []
    for part in parts:
        streams.stream_report_windows(feed(part), out, checkpoint, "36 hours")
        ends.append(spark.read.parquet(f"{out}/days").agg(F.max("batch")).first()[0])
    assert rows(streams.read_report_windows(spark, out)) == rows(daily_report(log).select("trigger_day", "running_count", "suc_count", "fail_count"))
    side = spark.read.parquet(f"{out}/late")
    assert side.where("batch = 2").agg(F.sum("day_count")).first()[0] > 0 and side.where("batch < 2").count() == 0
    counted = spark.read.parquet(f"{out}/days").where(F.col("batch") > ends[1])
    assert 0 < counted.count() <= 3  # only days that are still open are counted again


def test_callbacks_are_taken_once_across_batches(spark, feed):
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")
    calls = spark.range(100).selectExpr("id AS log_id", "TIMESTAMP_NTZ '2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, id) AS arrived")
    streams.stream_callback_dedup(feed(calls.unionAll(calls.where("log_id % 2 = 0"))), out, checkpoint)
    streams.stream_callback_dedup(feed(calls.withColumn("log_id", F.col("log_id") + 50)), out, checkpoint)
    got = streams.read_batches(spark, out)
    assert got.count() == got.select("log_id").distinct().count() == 150


def test_registry_state_keeps_the_newest(spark, tables, feed, rows):
    table, checkpoint = scratch_path(spark, "reg"), scratch_path(spark, "cp")
    beats = tables.job_registry
    for part in (beats.where("id % 2 = 1"), beats.where("id % 2 = 0")):
        streams.stream_registry_state(feed(part), table, checkpoint)
    from tablesync.sinks.buckets import read_buckets

    columns = ["registry_key", "registry_value", "update_time", "id"]
    assert rows(read_buckets(spark, table), *columns) == rows(registry.registry_latest(beats), *columns)


def test_what_a_batch_reads_does_not_grow_with_the_history(spark, monkeypatch):
    out, read = scratch_path(spark, "out"), []
    before = streams.parts_before

    def seen(*args):
        found = before(*args)
        read.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(streams, "parts_before", seen)
    take = streams._once(out, "log_id", [F.col("arrived")], 100)
    for batch in range(50):  # each batch brings 100 new ids and repeats the 30 before them
        calls = spark.range(max(0, batch * 100 - 30), batch * 100 + 100, 1, 1).selectExpr("id AS log_id", "id AS arrived")
        take(calls, batch)
    got = streams.read_batches(spark, out)
    assert got.count() == got.select("log_id").distinct().count() == 5000
    assert max(read[25:]) <= max(read[2:25]) <= 3
    take(spark.range(0, 50, 1, 1).selectExpr("id AS log_id", "id AS arrived"), 50)  # very late repeats
    assert streams.read_batches(spark, out).count() == 5000
    take(spark.range(4970, 5100, 1, 1).selectExpr("id AS log_id", "id AS arrived"), 51)
    take(spark.range(4970, 5100, 1, 1).selectExpr("id AS log_id", "id AS arrived"), 51)  # the batch is repeated after a failure
    assert streams.read_batches(spark, out).count() == 5100


def test_rows_weeks_late_are_neither_lost_nor_repeated(spark, tables, feed, rows):
    out, alerts, checks = scratch_path(spark, "out"), scratch_path(spark, "alerts"), [scratch_path(spark, "cp") for _ in range(2)]
    log = tables.job_log
    for part in (log.where("trigger_time >= '2024-01-25'"), log.where("trigger_time < '2024-01-25'"), log.where("id % 3 = 0").limit(0)):
        source = feed(part)
        streams.stream_daily_report(source, out, checks[0])
        streams.stream_fail_alerts(source, alerts, checks[1])
    from tablesync.operators.runs import open_failures

    assert rows(streams.read_daily_report(spark, out)) == rows(daily_report(log).select("trigger_day", "running_count", "suc_count", "fail_count"))
    assert rows(streams.read_batches(spark, alerts), "id") == rows(open_failures(log), "id")


def test_a_stream_with_rejects_goes_on(spark, feed, rows):
    target, checkpoint, rejects = (scratch_path(spark, n) for n in ("sync", "cp", "rejects"))
    spec = SyncSpec(lambda s: None, target, ["k", "v"], ["id", "amount"], types={"amount": "double"}, mode="upsert", upsert_keys=["id"])
    streams.stream_sync(feed(spark.createDataFrame([(1, "1"), (2, "two")], "k int, v string")), spec, checkpoint, rejects)
    streams.stream_sync(feed(spark.createDataFrame([(2, "20"), (3, "three")], "k int, v string")), spec, checkpoint, rejects)
    assert rows(target_rows(spark, spec)) == [(1, 1.0), (2, 20.0)]
    assert streams.read_batches(spark, rejects).count() == 2


def test_alerts_once(spark, tables, feed):
    out, checkpoint = scratch_path(spark, "alerts"), scratch_path(spark, "cp")
    for _ in range(2):
        streams.stream_fail_alerts(feed(tables.job_log), out, checkpoint)
    got = streams.read_batches(spark, out)
    assert got.count() == got.select("id").distinct().count() > 0


def test_sync_follows_its_source_and_survives_a_refused_batch(spark, feed, rows):
    target, checkpoint = scratch_path(spark, "sync"), scratch_path(spark, "cp")
    spec = SyncSpec(lambda s: None, target, ["k", "v"], ["id", "amount"], types={"amount": "double"}, mode="upsert", upsert_keys=["id"])
    streams.stream_sync(feed(spark.createDataFrame([(1, "1"), (2, "2")], "k int, v string")), spec, checkpoint)
    bad = feed(spark.createDataFrame([(2, "20"), (3, "three")], "k int, v string"))
    with pytest.raises(Exception) as error:
        streams.stream_sync(bad, spec, checkpoint)
    assert ErrorLimitExceeded.__name__ in str(error.value)
    assert rows(target_rows(spark, spec)) == [(1, 1.0), (2, 2.0)]
    from dataclasses import replace

    streams.stream_sync(bad, replace(spec, max_dirty_records=1, max_dirty_ratio=0.5), checkpoint)
    assert rows(target_rows(spark, spec)) == [(1, 1.0), (2, 20.0)]
    with pytest.raises(ValueError):
        streams.stream_sync(bad, replace(spec, mode="append"), checkpoint)
