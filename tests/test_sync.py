"""Mapping, quality gate, publishing and incremental runs."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tablesync.operators import mapping
from tablesync.operators.increment import INC_ID, INC_TIME
from tablesync.plans.incremental import IncrementState, QuerySource, bounds, run_incremental, stored_state
from tablesync.plans.sync import SyncSpec, batch_sync, clear_runs, run_sync, sync_counters, target_rows
from tablesync.session import scratch_path
from tablesync.sinks import buckets
from tablesync.sinks import publish as pub


def test_map_columns_needs_equal_counts(tables):
    with pytest.raises(ValueError):
        mapping.map_columns(tables.orders, ["o_orderkey"], ["a", "b"])


def test_parameters():
    params = mapping.parse_definitions("-DlastTime=2024-01-01 -Dn=5")
    assert mapping.substitute_params("/x/p=${lastTime}/${n}", params) == "/x/p=2024-01-01/5"
    assert mapping.bind_params("a >= ${lastTime} AND b < '${n}' AND c = 'it''s'") == "a >= :lastTime AND b < :n AND c = 'it''s'"
    with pytest.raises(ValueError):
        mapping.bind_params("a LIKE 'x${n}%'")
    with pytest.raises(KeyError):
        mapping.substitute_params("${other}", params)


def test_blank_filter_means_none(tables):
    assert mapping.filter_where(tables.nation, "  ").count() == 25


def test_error_limit_defaults():
    mapping.check_error_limit(100, 0)
    with pytest.raises(mapping.ErrorLimitExceeded):
        mapping.check_error_limit(100, 1)
    mapping.check_error_limit(100, 2, max_records=None)
    with pytest.raises(mapping.ErrorLimitExceeded):
        mapping.check_error_limit(100, 3, max_records=None)


def _raw(spark):
    data = [("1", "2024-01-01 10:00:00", "2.5", "true"), ("2", "yesterday", "x", "true"), ("3", None, None, None), ("4", "2024-01-02", "1e3", "7up")]
    return spark.createDataFrame(data, "id string, at string, amount string, flag string")


_TYPES = [("id", "long"), ("at", "date"), ("amount", "double"), ("flag", "bool")]


def test_dirty_rows_keep_their_text(spark):
    good, rejects = mapping.split_dirty(mapping.flag_dirty(_raw(spark), _TYPES))
    assert [r.id for r in good.orderBy("id").collect()] == [1, 3]
    got = {r.dirty_reason: r.dirty_record for r in rejects.collect()}
    assert set(got) == {"at is not date; amount is not double", "flag is not bool"}
    assert '"amount":"x"' in got["at is not date; amount is not double"]


def test_null_is_not_dirty_and_unknown_type_is_an_error(spark):
    with pytest.raises(ValueError):
        mapping.flag_dirty(_raw(spark), [("id", "integer")])


def _spec(spark, df, **more):
    columns = df.columns
    return SyncSpec(lambda s: df, f"{scratch_path(spark, 'target')}", columns, columns, **more)


def test_over_the_limit_nothing_is_published(spark):
    spec = _spec(spark, _raw(spark), types=dict(_TYPES))
    with pytest.raises(mapping.ErrorLimitExceeded):
        run_sync(spark, spec)
    assert pub.read_current(spark, spec.target) is None
    done = run_sync(spark, replace(spec, max_dirty_records=2, max_dirty_ratio=0.5))
    assert (done.read_count, done.write_count, done.fail_count) == (4, 2, 2)
    assert target_rows(spark, spec).count() == 2
    assert pub.rejected_rows(spark, done.path).count() == 2
    counters = sync_counters(spark, [done]).collect()[0]
    assert counters.read_count == 4 and counters.records_per_s > 0 and counters.bytes_per_s > 0


def test_overwrite_replaces_and_append_adds(spark):
    df = spark.range(5).withColumn("v", F.lit("a"))
    spec = _spec(spark, df)
    run_sync(spark, spec)
    run_sync(spark, spec)
    assert target_rows(spark, spec).count() == 5
    run_sync(spark, replace(spec, mode="append"))
    run_sync(spark, replace(spec, mode="append"))
    assert target_rows(spark, replace(spec, mode="append")).count() == 15


def test_upsert_merges_and_repeats(spark, rows):
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "b2", 2)], "id int, v string, ver int")
    spec = _spec(spark, first, mode="upsert", upsert_keys=["id"], upsert_order=["ver"])
    run_sync(spark, spec)
    assert rows(target_rows(spark, spec)) == [(1, "a", 1), (2, "b2", 2)]
    second = spark.createDataFrame([(2, "late", 0), (3, "c", 0)], "id long, v string, ver int")
    step = replace(spec, read=lambda s: second)
    run_sync(spark, step)
    want = [(1, "a", 1), (2, "late", 0), (3, "c", 0)]
    assert rows(target_rows(spark, spec)) == want
    run_sync(spark, step)  # the repeated batch changes nothing
    assert rows(target_rows(spark, spec)) == want
    assert len(pub.versions(spark, spec.target)) == 3 and clear_runs(spark, spec) == 2
    assert len(pub.versions(spark, spec.target)) == 1
    assert rows(target_rows(spark, spec)) == want
    run_sync(spark, replace(spec, read=lambda s: second.limit(0)))
    assert rows(target_rows(spark, spec)) == want


def _upserted(spark, n, **more):
    root = scratch_path(spark, "buckets")
    table = spark.range(n).selectExpr("id AS k", "'old' AS v")
    buckets.upsert_buckets(table, root, ["k"], [F.col("v")], **more)
    return root


def test_an_upsert_touches_the_buckets_of_its_batch(spark, rows):
    root = _upserted(spark, 1000, buckets=16)
    before = set(spark.read.parquet(f"{root}/data").inputFiles())
    batch = spark.createDataFrame([(5, "new"), (5000, "new")], "k long, v string")
    touched = {r[0] for r in batch.select(buckets.bucket_of(["k"], 16)).collect()}
    assert buckets.upsert_buckets(batch, root, ["k"], [F.col("v")]) == len(touched) < 16
    after = set(spark.read.parquet(f"{root}/data").inputFiles())
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in before ^ after} == touched
    plan = buckets.read_buckets(spark, root, sorted(touched))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [_bucket" in plan
    want = {k: "old" for k in range(1000)} | {5: "new", 5000: "new"}
    assert {r.k: r.v for r in buckets.read_buckets(spark, root).collect()} == want
    assert {r.k for r in buckets.read_buckets(spark, root, [3]).collect()} == {r.k for r in spark.createDataFrame([(k,) for k in want], "k long").where(buckets.bucket_of(["k"], 16) == 3).collect()}


def test_a_merge_that_died_is_seen_whole_and_carried_on(spark, monkeypatch):
    root = _upserted(spark, 100, buckets=8)
    put = buckets._put_in_place
    batch = spark.createDataFrame([(k, "new") for k in range(0, 200, 40)], "k long, v string")
    calls = []

    def dies(session, where):
        calls.append(where)
        if len(calls) == 2:
            raise RuntimeError("the driver is lost")
        return put(session, where)

    monkeypatch.setattr(buckets, "_put_in_place", dies)
    with pytest.raises(RuntimeError):
        buckets.upsert_buckets(batch, root, ["k"], [F.col("v")])
    monkeypatch.setattr(buckets, "_put_in_place", put)
    want = {k: "old" for k in range(100)} | {k: "new" for k in range(0, 200, 40)}
    assert {r.k: r.v for r in buckets.read_buckets(spark, root).collect()} == want
    buckets.upsert_buckets(spark.createDataFrame([(1, "newer")], "k long, v string"), root, ["k"], [F.col("v")])
    assert {r.k: r.v for r in buckets.read_buckets(spark, root).collect()} == want | {1: "newer"}
    assert not pub.path_exists(spark, f"{root}/_PENDING")


def test_a_batch_that_fails_before_it_is_named_leaves_the_table(spark):
    root = _upserted(spark, 10, buckets=4)
    bad = spark.createDataFrame([(1, "new")], "k long, v string").withColumn("v", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        buckets.upsert_buckets(bad, root, ["k"], [F.col("k")])
    assert {r.v for r in buckets.read_buckets(spark, root).collect()} == {"old"}


def test_upsert_with_one_key_holding_most_rows(spark, rows):
    batch = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("k"), F.col("id").alias("ver"))
    spec = _spec(spark, batch, mode="upsert", upsert_keys=["k"], upsert_order=["ver"])
    run_sync(spark, spec)
    want = batch.groupBy("k").agg(F.max("ver"))
    assert rows(target_rows(spark, spec)) == rows(want)


def test_batch_sync_needs_matching_lists(spark):
    with pytest.raises(ValueError):
        batch_sync(spark, ["a", "b"], ["x"], lambda s, t: None)


def test_a_table_that_fails_leaves_the_others(spark):
    folder = scratch_path(spark, "batch")

    def make(source, target):
        if source == "unknown":
            raise KeyError(source)
        rows = _raw(spark) if source == "dirty" else spark.range(7).selectExpr("id", "'x' AS v")
        return SyncSpec(lambda s: rows, f"{folder}/{target}", rows.columns, rows.columns, types=dict(_TYPES) if source == "dirty" else {})

    done = batch_sync(spark, ["good", "dirty", "unknown", "fine"], ["a", "b", "c", "d"], make)
    assert [r.error is None for r in done] == [True, False, False, True]
    assert "ErrorLimitExceeded" in done[1].error and "KeyError" in done[2].error
    assert [r.write_count for r in done] == [7, 0, 0, 7]
    assert sync_counters(spark, done).count() == 4


def test_a_table_over_its_limit_is_stopped(spark):
    folder = scratch_path(spark, "batch")

    def make(source, target):
        rows = spark.range(5) if source != "slow" else spark.range(0, 1 << 30, 1, 4000).where("sha2(string(id), 512) = 'x'")
        return SyncSpec(lambda s: rows, f"{folder}/{target}", ["id"], ["id"])

    done = batch_sync(spark, ["quick", "slow", "after"], ["quick", "slow", "after"], make, parallel=1, limit_s=20)
    assert [r.error for r in done] == [None, "stopped after 20 seconds", None]
    assert [r.write_count for r in done] == [5, 0, 5] and done[1].elapsed_s < 60


def test_time_runs_advance_only_after_success(spark, tables):
    columns = ["o_orderkey", "o_orderstatus", "o_orderdate"]
    spec = SyncSpec(lambda s: tables.orders, scratch_path(spark, "inc"), columns, columns, mode="upsert", upsert_keys=["o_orderkey"], upsert_order=["o_orderdate"])
    state = IncrementState(INC_TIME, "o_orderdate", start_time="1996-01-01 00:00:00")
    broken = replace(spec, types={"o_orderstatus": "long"})
    with pytest.raises(mapping.ErrorLimitExceeded):
        run_incremental(spark, broken, state, "1997-01-01 00:00:00.5")
    _, after = run_incremental(spark, spec, state, "1997-01-01 00:00:00.5")
    assert after.start_time == "1997-01-01 00:00:00"
    _, after = run_incremental(spark, spec, state, "1998-01-01 00:00:00")  # a retry from the old start
    run_incremental(spark, spec, after, "1999-01-01 00:00:00")
    want = tables.orders.where("o_orderdate >= '1996-01-01' AND o_orderdate < '1999-01-01'").count()
    assert target_rows(spark, spec).count() == want


def test_id_run_leaves_the_largest_id_for_later(spark, tables):
    columns = ["o_orderkey", "o_totalprice"]
    spec = SyncSpec(lambda s: tables.orders, scratch_path(spark, "inc-id"), columns, columns, mode="append")
    result, after = run_incremental(spark, spec, IncrementState(INC_ID, "o_orderkey", start_id=0), "2024-01-01 00:00:00")
    assert result.write_count == tables.orders.count() - 1
    result, _ = run_incremental(spark, spec, after, "2024-01-01 00:00:00")
    assert result.write_count == 0


def test_null_keys_are_replaced_like_any_other(spark, rows):
    first = spark.createDataFrame([(None, "old"), (1, "a")], "id int, v string")
    spec = _spec(spark, first, mode="upsert", upsert_keys=["id"], upsert_order=["v"])
    run_sync(spark, spec)
    run_sync(spark, replace(spec, read=lambda s: spark.createDataFrame([(None, "new")], "id int, v string")))
    assert {tuple(r) for r in target_rows(spark, spec).collect()} == {(None, "new"), (1, "a")}


def test_two_writers_never_share_a_directory(spark):
    root = scratch_path(spark, "claims")
    path = pub.version_path(root, pub.next_version(spark, root))
    spark.range(3).write.parquet(path)
    with pytest.raises(Exception, match="already exists"):
        spark.range(3).write.parquet(path)
    assert pub.next_version(spark, root) == 2 and pub.read_current(spark, root) is None


def test_the_mark_is_stored_with_the_version_and_never_goes_back(spark, tables):
    columns = ["o_orderkey", "o_totalprice"]
    spec = SyncSpec(lambda s: tables.orders, scratch_path(spark, "inc-mark"), columns, columns, mode="append")
    first = IncrementState(INC_ID, "o_orderkey", start_id=5)
    assert stored_state(spark, spec, first) == first
    run_incremental(spark, spec, first, "2024-01-01 00:00:00")  # the caller crashes before it saves what was returned
    top = tables.orders.agg(F.max("o_orderkey")).first()[0]
    after = stored_state(spark, spec, first)
    assert after.start_id == top
    empty = replace(spec, read=lambda s: tables.orders.limit(0))
    run_incremental(spark, empty, after, "2024-01-02 00:00:00")
    assert stored_state(spark, spec, first).start_id == top
    broken = replace(spec, types={"o_totalprice": "date"})
    with pytest.raises(Exception):
        run_incremental(spark, broken, first, "2024-01-03 00:00:00")
    assert stored_state(spark, spec, first).start_id == top


def test_bounds_as_a_query_sees_them():
    state = IncrementState(INC_TIME, "t", start_time="2024-01-01 00:00:00")
    assert bounds(state, "2024-01-02 03:04:05") == {"lastTime": "1704067200", "currentTime": "1704164645"}
    assert bounds(replace(state, time_format="yyyy/MM/dd"), "2024-01-02 03:04:05")["currentTime"] == "2024/01/02"
    assert bounds(IncrementState(INC_ID, "id", start_id=3), "2024-01-02 00:00:00", 9) == {"startId": 3, "endId": 9}
    day = IncrementState(3, "p", partition="p,-1,yyyyMMdd")
    assert bounds(day, "2024-01-01 08:00:00") == {"partition": "20231231"}


def test_id_bounds_reach_a_query(spark, rows):
    data = spark.range(10).withColumnRenamed("id", "k")
    spec = SyncSpec(lambda s: data, scratch_path(spark, "inc-query"), ["k"], ["k"], mode="append")
    source = QuerySource("SELECT k FROM {t} WHERE k >= ${startId} AND k < ${endId}", {"t": data})
    run_incremental(spark, spec, IncrementState(INC_ID, "k", start_id=4), "2024-01-01 00:00:00", source)
    assert rows(target_rows(spark, spec)) == [(k,) for k in range(4, 9)]


def test_sinks_see_nothing_of_a_refused_run(spark):
    spec = _spec(spark, _raw(spark), types=dict(_TYPES), sink="documents", sink_options={"path": scratch_path(spark, "docs")})
    with pytest.raises(mapping.ErrorLimitExceeded):
        run_sync(spark, spec)
    assert not pub.path_exists(spark, spec.sink_options["path"])
    done = run_sync(spark, replace(spec, max_dirty_records=None, max_dirty_ratio=None))
    assert (done.read_count, done.write_count, done.fail_count) == (4, 2, 2)
    assert spark.read.json(spec.sink_options["path"]).count() == 2 and pub.rejected_rows(spark, done.path).count() == 2
    with pytest.raises(ValueError):
        run_sync(spark, replace(spec, sink="tape"))


def test_scratch_tables_can_be_dropped(spark):
    from tablesync.session import drop_scratch, materialise

    drop_scratch(spark)
    kept = materialise(spark.range(3), "once")
    assert kept.count() == 3 and drop_scratch(spark) == 1 and drop_scratch(spark) == 0
