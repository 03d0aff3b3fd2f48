"""Run log, retention and dependency rules on small literal frames."""

import random

import pytest
from pyspark.sql import functions as F

from tablesync.operators import catalog, dependencies, retention, runs
from tablesync.operators.increment import inc_chain, inc_gap_overlap, previous_value

# Sample report rows: day, running, success, fail.
REPORT = [
    ("2019-12-07", 0, 0, 0), ("2019-12-10", 77, 52, 23), ("2019-12-11", 9, 2, 11), ("2019-12-13", 9, 48, 74),
    ("2019-12-12", 10, 8, 30), ("2019-12-14", 78, 45, 66), ("2019-12-15", 24, 76, 9), ("2019-12-16", 23, 85, 10),
]


@pytest.fixture
def report(spark):
    return spark.createDataFrame(REPORT, "day string, running_count bigint, suc_count bigint, fail_count bigint").select(
        F.col("day").cast("date").alias("trigger_day"), "running_count", "suc_count", "fail_count")


def test_report_totals_and_range(report):
    assert tuple(runs.report_total(report).collect()[0]) == (230, 316, 223)
    days = [str(r.trigger_day) for r in runs.report_range(report, "2019-12-11 00:00:00", "2019-12-13 00:00:00").collect()]
    assert days == ["2019-12-11", "2019-12-12", "2019-12-13"]


def test_chart_shows_seven_zero_days_when_empty(report):
    full = runs.chart_info(report, "2019-12-16 12:00:00").collect()
    assert len(full) == 7 and {r.suc_total for r in full} == {316}
    empty = runs.chart_info(report, "2024-05-10 12:00:00").collect()
    assert sorted(r.trigger_day for r in empty) == [f"2024-05-{d:02d}" for d in range(4, 11)]
    assert {(r.running_count, r.running_total) for r in empty} == {(0, 0)}


def test_report_of_a_day_without_runs_is_zero(tables):
    rows = runs.log_daily_report(tables.job_log, "2030-01-01 10:00:00").collect()
    assert len(rows) == 3 and all(r.running_count == r.suc_count == r.fail_count == 0 for r in rows)


def test_status_rules_overlap(spark):
    log = spark.createDataFrame([(1, 500, 200), (2, 0, 0), (3, 200, 0), (4, 200, 502)], "id int, trigger_code int, handle_code int")

    def ids(cond):
        return [r.id for r in log.where(cond).orderBy("id").collect()]

    assert ids(runs.is_success()) == [1]
    assert ids(runs.is_failed()) == [1, 4]
    assert ids(runs.is_running()) == [3]
    assert ids(runs.is_unfinished()) == [2, 3]


def test_group_filter_only_without_job(tables):
    log = tables.job_log
    assert runs.filter_log(log, job_group=1, job_id=3).count() == log.where("job_id = 3").count()
    one = runs.log_page(log, log_id=5).collect()
    assert [r.id for r in one] == [5]


def test_keep_newest_when_there_are_fewer(tables):
    assert retention.clear_keep_newest(tables.job_log, 10**6).count() == 0
    with pytest.raises(ValueError):
        retention.clear_by_type(tables.job_log, 10, "2024-01-01 00:00:00")


def test_retention_switches_off(spark, tables):
    assert retention.retention_days(tables.job_log, "2030-01-01 00:00:00", 0).count() == 0
    names = spark.createDataFrame([("2024-01-01",), ("2024-01-09",), ("note",)], "name string")
    assert [r.name for r in retention.expire_date_dirs(names, "2024-01-10 15:00:00", 3).collect()] == ["2024-01-01"]
    assert retention.expire_date_dirs(names, "2024-01-10 15:00:00", 2).count() == 0


def test_versions_to_drop_with_a_hot_job(spark, rows):
    versions = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, id % 50, 7) AS job_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(id % 11) AS update_time")
    kept = {}
    for r in versions.collect():
        kept.setdefault(r.job_id, []).append((r.update_time, r.id))
    want = sorted((i,) for v in kept.values() for _, i in sorted(v, reverse=True)[5:])
    assert sorted(tuple(r) for r in retention.keep_latest_versions(versions, 5).select("id").collect()) == want


def test_child_list_entries(spark):
    jobs = spark.createDataFrame([(1, "2,,x, 3,+4,,"), (2, None), (3, " "), (4, "0,-1,99999999999,99999999999999999999")], "id int, child_jobid string")
    got = [(r.parent_id, r.position, r.entry, r.child_id) for r in dependencies.child_edges(jobs).orderBy("parent_id", "position").collect()]
    assert got == [(1, 1, "2", 2), (1, 2, "", None), (1, 3, "x", None), (1, 4, " 3", None), (1, 5, "+4", 4),
                   (4, 1, "0", None), (4, 2, "-1", None), (4, 3, "99999999999", 99999999999), (4, 4, "99999999999999999999", None)]


def test_closure_ends_on_cycles_and_finds_smallest_depth(spark, rows):
    jobs = spark.createDataFrame([(1, "2,3"), (2, "4"), (3, "4,1"), (4, "5"), (5, "2,6"), (6, "7"), (7, "77"), (8, "1")], "id int, child_jobid string")
    want = [(2, 1), (3, 1), (4, 2), (5, 3), (6, 4), (7, 5)]
    assert rows(dependencies.dependency_closure(jobs, 1)) == want
    assert rows(dependencies.dependency_closure(jobs, 7)) == []


def test_closure_of_all_jobs_in_few_rounds(spark, monkeypatch):
    rng = random.Random(4)
    lists = {i: [i + 1] for i in range(1, 40)} | {i: rng.sample(range(50, 90), 2) for i in range(50, 90)} | {95: [95], 96: [97], 97: [96], 98: [1000], 40: []}
    jobs = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in lists.items()], "id long, child_jobid string")
    want = {}
    for root in lists:
        frontier, depth = [root], 0
        while frontier:
            depth += 1
            frontier = sorted({c for p in frontier for c in lists.get(p, []) if c in lists and (root, c) not in want})
            want |= {(root, c): depth for c in frontier}
    written = []
    monkeypatch.setattr(dependencies, "scratch_path", lambda s, label, make=dependencies.scratch_path: written.append(make(s, label)) or written[-1])
    closure = dependencies.dependency_closure_all(jobs)
    assert {(r.ancestor, r.descendant): r.depth for r in closure.collect()} == want and closure.count() == len(want)
    assert len(written) <= 8  # the longest way has 39 steps
    mutual = {}
    for a, b in want:
        if (b, a) in want and (a, a) in want:
            mutual.setdefault(a, set()).add(b)
    got = {r.id: (r.cycle, r.jobs) for r in dependencies.dependency_cycles(closure).collect()}
    assert got == {a: (min(m), len(m)) for a, m in mutual.items()} and got[96] == (96, 2) and got[95] == (95, 1) and 5 not in got


def test_callback_message_is_appended_whole(spark):
    log = spark.createDataFrame([(1, 9, 0, "a" * 20_000, None), (2, 9, 200, "kept", None)], "id int, job_id int, handle_code int, handle_msg string, handle_time timestamp_ntz")
    calls = spark.createDataFrame([(1, 1, 500, "b"), (1, 2, 200, "c"), (2, 1, 500, "d")], "log_id int, arrival int, code int, msg string")
    got = {r.id: r for r in dependencies.callback_apply(log, calls, F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")).collect()}
    assert got[1].handle_code == 500 and got[1].handle_msg == "a" * 20_000 + "<br>b"
    assert got[2].handle_code == 200 and got[2].handle_msg == "kept" and got[2].handle_time is None


def test_messages_a_column_would_not_hold(spark):
    df = spark.createDataFrame([("x" * 50_000,), ("x" * 50_001,), (None,)], "m string").select(dependencies.over_column_size(F.col("m"), 50_000).alias("over"))
    assert sorted(r.over for r in df.collect()) == [False, False, True]


def test_quantiles_are_exact(spark):
    log = spark.range(30_000).selectExpr("id % 2 AS job_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS trigger_time", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS handle_time")
    got = {r.job_id: (r.runs, r.p50_s, r.p95_s) for r in runs.run_duration_stats(log).collect()}
    assert got == {0: (15_000, 14_998, 28_498), 1: (15_000, 14_999, 28_499)}


def test_keep_newest_among_ties_and_missing_times(spark):
    data = [(i, 1, 1, f"2024-01-0{1 + i % 3} 00:00:0{i % 2}" if i % 7 else None) for i in range(60)]
    log = spark.createDataFrame(data, "id int, job_id int, job_group int, t string").selectExpr("id", "job_id", "job_group", "CAST(t AS TIMESTAMP_NTZ) AS trigger_time")
    newest = [r[0] for r in sorted(data, key=lambda r: (r[3] or "", r[0]), reverse=True)]
    for keep in (0, 1, 17, 20, 50, 55, 59, 60, 90):
        assert sorted(r.id for r in retention.clear_keep_newest(log, keep).collect()) == sorted(newest[keep:])


def test_repeated_triggers(spark, rows):
    triggers = spark.createDataFrame([(1,), (1,), (1,), (2,)], "log_id int")
    assert rows(dependencies.duplicate_triggers(triggers)) == [(1, 2)]
    assert dependencies.accepted_triggers(triggers).count() == 2


@pytest.mark.parametrize("bits", [0, 2, 5, 20])
def test_previous_value_across_buckets(spark, bits):
    df = spark.range(400).selectExpr("id", "IF(id % 3 = 0, id % 4, 9) AS job_id", "IF(id % 5 = 1, id * 10, NULL) AS v")
    want, last = {}, {}
    for r in df.orderBy("id").collect():
        want[r.id] = last.get(r.job_id)
        if r.v is not None:
            last[r.job_id] = r.v
    got = {r.id: r.prev for r in previous_value(df, "job_id", "id", F.col("v"), "prev", bits).collect()}
    assert got == want


def test_previous_value_over_sparse_ids(spark):
    df = spark.range(1500).selectExpr("abs(xxhash64(id)) AS id", "IF(id % 4 = 0, id % 3, 9) AS job_id", "IF(id % 5 = 1, id, NULL) AS v")
    want, last = {}, {}
    for r in df.orderBy("id").collect():
        want[r.id] = last.get(r.job_id)
        if r.v is not None:
            last[r.job_id] = r.v
    assert {r.id: r.prev for r in previous_value(df, "job_id", "id", F.col("v"), "prev").collect()} == want


def test_chain_and_audit_do_not_depend_on_the_bucket_width(tables, rows):
    assert rows(inc_chain(tables.job_log, "2024-01-01 00:00:00", 4)) == rows(inc_chain(tables.job_log, "2024-01-01 00:00:00"))
    assert rows(inc_gap_overlap(tables.sync_windows, 3)) == rows(inc_gap_overlap(tables.sync_windows))


def test_generic_page_ignores_blanks(tables):
    rows = catalog.generic_page(tables.job_datasource, {"current": 1, "size": 1000, "status": "", "datasourceName": None}).collect()
    assert len(rows) == tables.job_datasource.count()
    assert catalog.snake_case("datasourceGroup") == "datasource_group"
