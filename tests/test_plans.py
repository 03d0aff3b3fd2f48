"""Physical plans: what reaches the scan, and what must not appear at any scale."""

import pytest

from tablesync.operators import retention, runs
from tablesync.operators.common import newest_per_key
from tablesync.queries import QUERIES

def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_window_reaches_the_scan(spark, sf_dir):
    plan = _plan(QUERIES["inc_time_window"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in plan and "LessThan(ts,2024-01-12T08:30:15)" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_report_window_reaches_the_scan(tables):
    plan = _plan(runs.log_daily_report(tables.job_log, "2024-01-30 23:58:00"))
    assert "GreaterThanOrEqual(ts,2024-01-28T00:00)" in plan and "LessThan(ts,2024-01-31T00:00)" in plan


def test_two_columns_are_read_for_two_columns(spark, sf_dir):
    plan = _plan(QUERIES["clear_before_time"](spark, sf_dir))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan


def test_newest_per_key_is_limited_before_the_shuffle(tables):
    from pyspark.sql import functions as F

    plan = _plan(newest_per_key(tables.job_log, ["job_id"], [F.col("id").desc()], 3))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("WindowGroupLimit", plan.index("Exchange")) > plan.index("Exchange")


def test_version_cutoff_is_limited_before_the_shuffle(tables):
    assert "WindowGroupLimit" in _plan(retention.keep_latest_versions(tables.job_logglue, 5))


def test_page_is_a_top_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in _plan(QUERIES["log_page"](spark, sf_dir))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_global_window(name, spark, sf_dir):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "- Window [" in line:
            shuffle = next((below for below in lines[i:] if "Exchange" in below), "")
            assert "SinglePartition" not in shuffle
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", ["registry_latest", "job_last_status", "log_lifecycle", "run_duration_stats", "advance_watermark", "log_count_by_day"])
def test_newest_rows_need_no_sorted_input(name, spark, sf_dir):
    assert "SortAggregate" not in _plan(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("view", ["cells", "callbacks", "run_events", "run_log_lines", "task_log"])
def test_a_view_scans_its_table_once(view, tables):
    assert _plan(getattr(tables, view)).count("FileScan") == 1


@pytest.mark.parametrize("name", ["clear_before_time", "clear_by_type", "clear_keep_newest", "retention_days", "fail_candidates"])
def test_lists_are_not_sorted(name, spark, sf_dir):
    assert "rangepartitioning" not in _plan(QUERIES[name](spark, sf_dir))


def test_profiles_do_not_multiply_rows(spark, sf_dir):
    assert "Expand" not in _plan(QUERIES["profile_table"](spark, sf_dir)) and "Expand" not in _plan(QUERIES["candidate_keys"](spark, sf_dir))
