"""File, cell, document and generated sources, and their sinks."""

import pytest
from pyspark.sql import functions as F

from tablesync.session import scratch_path
from tablesync.sinks import cells as cell_sink
from tablesync.sinks.files import write_console, write_documents, write_files, write_mode, write_partition_dir
from tablesync.sources import cells, documents, files, generated, tables as table_source


def test_delimited_by_position_with_header_and_constant(spark, tmp_path):
    (tmp_path / "a.txt").write_text("no\u0001name\u0001score\n1\u0001x\u00012.5\nbad\u0001\u00013\n", encoding="utf-8")
    columns = [{"index": 2, "type": "double"}, {"index": 0, "type": "long", "name": "no"}, {"value": "v1", "type": "string", "name": "tag"}]
    got = files.read_file(spark, str(tmp_path), "text", columns, sep="\u0001", skip_header=True).collect()
    assert {tuple(r) for r in got} == {(2.5, 1, "v1"), (3.0, None, "v1")}
    assert got[0].asDict().keys() == {"_c2", "no", "tag"}


@pytest.mark.parametrize("header", [False, True])
def test_text_lines_carry_quotes_commas_and_empty_text(spark, rows, header):
    data = [(1, 'say "hi"', ""), (2, "a,b", None), (3, '"', "\\"), (None, " lead", "trail "), (5, "#x", '"q"')]
    df = spark.createDataFrame(data, "n int, a string, b string")
    path = write_files(df, scratch_path(spark, "lines"), "t", "text", sep="\u0001", header=header)
    columns = [{"index": i, "type": ty, "name": n} for i, (n, ty) in enumerate([("n", "long"), ("a", "string"), ("b", "string")])]
    back = files.read_file(spark, path, "text", columns, sep="\u0001", skip_header=header)
    assert rows(back) == sorted(data, key=repr)
    for bad in ("x\u0001y", "x\ny", "\\N"):
        with pytest.raises(Exception):
            write_files(spark.createDataFrame([(bad,)], "a string"), scratch_path(spark, "lines"), "t", "text", sep="\u0001")


@pytest.mark.parametrize("kind", ["seq", "rc", "xls"])
def test_unreadable_types_are_named(spark, kind):
    with pytest.raises(ValueError):
        files.read_file(spark, "/nowhere", kind, [])


def test_non_conflict_refuses_existing_files(spark):
    path, df = scratch_path(spark, "nc"), spark.range(3)
    write_files(df, path, "t", "orc", mode="nonConflict")
    with pytest.raises(Exception):
        write_files(df, path, "t", "orc", mode="nonConflict")
    write_files(df, path, "t", "orc", mode="append")
    assert spark.read.orc(f"{path}/t").count() == 6
    with pytest.raises(ValueError):
        write_mode("upsert")
    with pytest.raises(ValueError):
        write_files(df, path, "t", "rc")


def test_partition_rerun_replaces_its_own_days(spark, rows):
    path = scratch_path(spark, "days")
    write_partition_dir(spark.createDataFrame([(1, "d1"), (2, "d2")], "v int, day string"), path, "day")
    write_partition_dir(spark.createDataFrame([(3, "d2")], "v int, day string"), path, "day")
    assert rows(spark.read.parquet(path)) == [(1, "d1"), (3, "d2")]
    one = files.read_partition(spark, path, "day=d2", "v int", day="d2")
    assert rows(one) == [(3, "d2")]


def test_multi_table_needs_one_shape(spark):
    with pytest.raises(ValueError):
        table_source.read_multi([spark.range(1), spark.range(1).withColumn("x", F.lit(1))])


_CELLS = [("r1", "cf", "a", 1, "old"), ("r1", "cf", "a", 2, "new"), ("r1", "cf", "a", 3, None), ("r1", "cf", "b", 1, "b"), ("r2", "cf", "b", 5, "z")]


def _cells(spark):
    return spark.createDataFrame(_CELLS, "rowkey string, family string, qualifier string, ver int, value string")


def test_latest_cell_may_be_null(spark, rows):
    assert rows(cells.scan_latest(_cells(spark), ["cf:a", "cf:b"])) == [("r1", None, "b"), ("r2", None, "z")]


def test_versions_are_bounded_per_cell(spark, rows):
    assert rows(cells.scan_versions(_cells(spark), ["cf:a"], 2), "ver") == [(2,), (3,)]


def test_row_key_range_needs_both_ends(spark):
    assert cells.rowkey_range(_cells(spark), "r1", "").count() == 5
    assert cells.rowkey_range(_cells(spark), "r1", "r2").count() == 4
    binary = _cells(spark).withColumn("rowkey", F.col("rowkey").cast("binary"))
    assert cells.rowkey_range(binary, "7231", "7232", binary=True).count() == 4
    with pytest.raises(ValueError):
        cells.split_column("cf")


def test_rows_become_cells(spark, rows):
    df = spark.createDataFrame([(1, "x", None, 9), (2, "y", "w", 8)], "id int, a string, b string, at int")
    layout = '[{"index": 0}, {"value": "-"}, {"index": 1}]'
    made = cell_sink.rows_to_cells(df, layout, [(2, "cf:a"), (3, "cf:b")], version="at")
    assert rows(made) == [("1-x", "cf", "a", 9, "x"), ("2-y", "cf", "a", 8, "y"), ("2-y", "cf", "b", 8, "w")]
    empty = cell_sink.rows_to_cells(df, layout, [(3, "cf:b")], null_mode="empty")
    assert rows(empty, "value", "ver") == [("", 1), ("w", 1)]
    with pytest.raises(ValueError):
        cell_sink.null_cells(made, "drop")


def test_documents_round_trip(spark):
    path = scratch_path(spark, "docs")
    write_documents(spark.createDataFrame([(1, "x"), (2, None)], "a int, b string"), path, ["id:long", "name:string"])
    assert {tuple(r) for r in documents.read_documents(spark, path, ["name:string", "id:long"]).collect()} == {("x", 1), (None, 2)}


def test_generated_rows(spark, rows):
    constants = [{"name": "n", "type": "long", "value": "10"}, {"name": "s", "type": "string", "value": "hello"}]
    df = generated.generate(spark, 10, 5, constants)
    assert df.count() == 50 and df.rdd.getNumPartitions() == 5 and df.distinct().count() == 1
    spec = [
        {"name": "l", "type": "long", "random": "2,10"}, {"name": "d", "type": "double", "random": "1,2"}, {"name": "b", "type": "bool", "random": "1,1"},
        {"name": "t", "type": "date", "random": "2014-07-07 00:00:00,2014-07-08 00:00:00"}, {"name": "s", "type": "string", "random": "0,200"},
        {"name": "y", "type": "bytes", "random": "3,3"},
    ]
    made = generated.generate(spark, 500, 3, spec, seed=1)
    assert rows(made) == rows(generated.generate(spark, 500, 3, spec, seed=1))
    low, high, small, big, longest, width, days = made.selectExpr(
        "min(l)", "max(l)", "min(d)", "max(d)", "max(length(s))", "max(length(y))", "count(distinct date(t))").collect()[0]
    assert (low, high, width) == (2, 10, 3) and 1 <= small < big < 2 and 150 < longest <= 200 and days in (1, 2)


def test_console_prints(spark, capsys):
    write_console(spark.range(2))
    assert "id" in capsys.readouterr().out
