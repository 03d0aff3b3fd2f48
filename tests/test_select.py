"""Places in an order found by counting."""

import random

import pytest
from pyspark.sql import functions as F

from tablesync.operators import catalog, retention, runs, select
from tablesync.operators.select import By

SCHEMA = "id long, t string, k int"


@pytest.fixture
def log(spark):
    """A third of all rows without a time, a third in one second, the others spread."""

    def make(size):
        rng = random.Random(size)
        data = [(i, None if i % 3 == 0 else "2024-01-05 10:00:00.5" if i % 3 == 1 else f"2024-01-{rng.randint(1, 28):02} 0{rng.randint(0, 9)}:00:00", rng.choice([None, 1, 2])) for i in range(size)]
        rng.shuffle(data)
        return spark.createDataFrame(data, SCHEMA).selectExpr("id", "CAST(t AS TIMESTAMP_NTZ) AS trigger_time", "k", "1 AS job_group", "1 AS job_id")

    return make


@pytest.mark.parametrize("small, parts", [(1, 2), (5, 4), (50_000, 4096)])
@pytest.mark.parametrize("descending", [True, False])
def test_every_place(log, monkeypatch, small, parts, descending):
    monkeypatch.setattr(select, "SMALL", small)
    monkeypatch.setattr(select, "PARTS", parts)
    frame = log(60)
    order = [By("trigger_time", descending), By("k"), By("id", not descending)]
    want = [tuple(r) for r in frame.orderBy(*[by.order() for by in order]).select("trigger_time", "k", "id").collect()]
    for n in (0, 1, 19, 20, 33, 40, 59):
        found = select.nth_row(frame, order, n)
        assert found == want[n]
        assert frame.where(select.rows_before(order, found)).count() == n
        assert frame.where(select.rows_after(order, found)).count() == 59 - n
    assert select.nth_row(frame, order, 60) is None


def test_pages_join_up(log, monkeypatch):
    monkeypatch.setattr(select, "SMALL", 7)
    frame = log(300)
    want = [r.id for r in frame.orderBy(F.desc("trigger_time"), F.desc("id")).collect()]
    found = [[r.id for r in runs.log_page(frame, at, 90, deep=0).collect()] for at in range(0, 400, 90)]
    assert sum(found, []) == want


def test_keep_newest_with_a_third_untimed_and_a_third_in_one_second(log, monkeypatch):
    monkeypatch.setattr(select, "SMALL", 10)
    frame = log(300)
    newest = [r.id for r in frame.orderBy(F.desc("trigger_time"), F.desc("id")).collect()]
    for keep in (50, 150, 250, 299, 300):
        assert sorted(r.id for r in retention.clear_keep_newest(frame, keep).collect()) == sorted(newest[keep:])


def test_numbers_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(select, "SMALL", 1)
    values = [-(1 << 63), (1 << 63) - 1, 0, 5, 6, (1 << 62) + 1, (1 << 62) + 2, -7]
    frame = spark.createDataFrame([(v,) for v in values], "id long")
    assert [select.nth_row(frame, [By("id")], n)[0] for n in range(len(values))] == sorted(values)
    with pytest.raises(ValueError):
        select.nth_row(spark.createDataFrame([("a",)], "id string"), [By("id")], 0)


def test_a_deep_page_sorts_its_own_rows(log):
    frame = log(300)
    plan = runs.log_page(frame, 200, 20, deep=0)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "TakeOrderedAndProject(limit=20" in plan and "Offset" not in plan
    plan = retention.clear_keep_newest(frame, 200)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Join" not in plan


def test_text_orders_are_sorted(spark):
    rows = spark.createDataFrame([(f"n{i:03}", i) for i in range(100)], "name string, id int")
    page = catalog.generic_page(rows, {"current": 9, "size": 10, "descs": "name"})
    assert [r.id for r in page.collect()] == list(range(19, 9, -1))
